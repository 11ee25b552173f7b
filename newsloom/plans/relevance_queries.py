"""Registered queries of editorial relevance, event validation and small rules, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import relevance as R
from newsloom.functions import text as X
from newsloom.plans.link_queries import CLUBS, rows, sql_rows
from newsloom.plans.news_queries import NEWS, news, pick, pick_sql
from newsloom.plans.registry import norm_sql, query, table
from newsloom.sources import tables

TERMS = [
    ("football", "player", "Isak"), ("hockey", "player", "Nylander"), ("football", "coach", "tränaren"), ("hockey", "coach", "ny tränare"), ("football", "domestic", "Allsvenskan"), ("hockey", "domestic", "Modo"),
    ("football", "club", "Liverpool"), ("football", "league", "Premier League"), ("hockey", "league", "NHL"), ("football", "staff_organization", "Heerenveen"), ("hockey", "staff_competition", "serien"),
]
PLAYERS = ["Erik Karlsson", "Karl Karlsson", "Damian Andersson", "Bo Ek"]
TEXTS = ["Karlsson scores", "Erik Karlsson and Karlsson", "Andersson nätar", "Ek wins", "AIK derby", "nothing"]


@query(
    NEWS + ", " + sql_rows("k", "sport, kind, term", TERMS) + f""", s AS (SELECT doc_id, sport, {norm_sql("title || ' ' || source || ' ' || array_to_string(tags, ' ')")} AS said, {norm_sql("title || ' ' || array_to_string(tags, ' ')")} AS shown FROM news),
 m AS (SELECT doc_id, kind FROM s JOIN k USING (sport) WHERE contains(' ' || said || ' ', ' ' || {norm_sql('term')} || ' ') UNION SELECT doc_id, 'domestic' FROM s WHERE doc_id % 3 = 0 AND contains(' ' || shown || ' ', ' aik ')),
 g AS (SELECT doc_id, list(DISTINCT kind) AS kinds FROM m GROUP BY 1)
 SELECT s.doc_id AS id, CASE WHEN list_has_any(coalesce(kinds, []), ['player', 'coach', 'domestic']) THEN 1 WHEN kinds IS NOT NULL THEN 2 ELSE 3 END AS tier,
 concat_ws(',', """ + ", ".join(f"CASE WHEN list_contains(kinds, '{k}') THEN '{r}' END" for k, r in R.REASONS) + ") AS reasons FROM s LEFT JOIN g USING (doc_id)"
)
def x33_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.struct(F.lit("t").alias("entity_id"), F.lit("team").alias("type"), F.lit("AIK").alias("name"), (F.col("doc_id") % 3 == 0).alias("is_swedish"))
    articles = news(spark, sf_dir).select(F.col("doc_id").alias("id"), "sport", "title", "source", "tags", F.array(hit).alias("hits"))
    found = R.relevance(articles, rows(spark, TERMS, "sport string, kind string, term string"))
    return found.select("id", "tier", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH d AS (SELECT doc_id, lower({pick_sql(TEXTS, 'doc_id')}) AS said, lower({pick_sql(PLAYERS, 'doc_id // 7')}) AS name, lower({pick_sql(PLAYERS, 'doc_id // 7 + 1')}) AS other FROM documents)
 SELECT doc_id, contains(said, name) OR (length(string_split(name, ' ')[2]) >= 4 AND list_contains(string_split(regexp_replace(said, 'ä', 'a', 'g'), ' '), string_split(name, ' ')[2])
 AND NOT (string_split(other, ' ')[2] = string_split(name, ' ')[2] AND contains(said, other))) AS supported FROM d"""
)
def x34_supported_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    hit = lambda i: F.struct(F.lit(f"p{i}").alias("entity_id"), F.lit("player").alias("type"), pick(PLAYERS, F.floor(k / 7) + i).alias("name"))
    made = table(spark, sf_dir, "documents").select("doc_id", X.normalize(pick(TEXTS, k)).alias("said"), hit(0).alias("hit"), F.array(hit(0), hit(1)).alias("hits"))
    return made.select("doc_id", R.supported(F.col("hit"), F.col("hits"), F.col("said")).alias("supported"))


KINDS = ["news_click", " news_dwell ", "click", "", "push_open", "news_impression"]


@query(
    f"""SELECT event_id, trim({pick_sql(KINDS, 'event_id')}) IN ('news_impression', 'news_click', 'push_open', 'news_dwell') AND NOT (event_id % 7 = 0) AND NOT (event_id % 5 = 0) AND NOT (event_id % 11 = 0) AS valid FROM events"""
)
def p24_event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    long = F.when(k % 7 == 0, F.repeat(F.lit("x"), 2049)).otherwise(F.repeat(F.lit("x"), 2048))
    ok = R.event_valid(pick(KINDS, k), long, F.when(k % 2 == 0, F.lit("")), F.lit(None).cast("string"), F.when(k % 5 == 0, "staff").when(k % 2 == 0, "team"), F.when(k % 11 == 0, "bandy").otherwise(" hockey "))
    return table(spark, sf_dir, "events").select("event_id", ok.alias("valid"))


@query(
    NEWS + rf""" SELECT doc_id, CASE WHEN h AND NOT f THEN 'hockey' WHEN f AND NOT h THEN 'football' WHEN regexp_matches(title, '(?i)\b({R.HOCKEY_ITSELF})\b') THEN 'hockey' ELSE 'football' END AS sport FROM (SELECT *,
 regexp_matches(title, '(?i)\b({R.SECOND_HOCKEY})\b') AS h,
 regexp_matches(title, '(?i)\b({R.SECOND_FOOTBALL})\b') AS f FROM news)"""
)
def p28_second_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("doc_id", R.second_sport(F.col("title")).alias("sport"))


PAPER = ["https://o.se/sport/kff-vinner", "https://o.se/sport/resultat/kff", "https://o.se/nyheter/kff", "https://o.se/sport/hockey"]


@query(f"SELECT c_custkey, contains(s, '{R.PAPER_SPORT}') AND NOT regexp_matches(s, '{'|'.join(R.PAPER_BLOCKED)}') AND regexp_matches(s, '{'|'.join(R.PAPER_CLUB)}') AS relevant FROM (SELECT c_custkey, lower({pick_sql(['Kalmar FF', 'Other'], 'c_custkey // 4')} || ' ' || {pick_sql(PAPER, 'c_custkey')}) AS s FROM customer)")
def p29_local_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", R.local_paper_item(pick(["Kalmar FF", "Other"], F.floor(k / 4)), pick(PAPER, k)).alias("relevant"))


LABELS = ['["A  b", "", "c"]', "a||b | c", "x|y| ", "p • q", "one,  two", " alone ", "", "[broken, list"]


@query(
    f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'A b;c' WHEN 1 THEN 'a;b | c' WHEN 2 THEN 'x;y' WHEN 3 THEN 'p;q' WHEN 4 THEN 'one;two' WHEN 5 THEN 'alone' WHEN 6 THEN '' ELSE '[broken;list' END AS labels,
 'football-team-' || CASE WHEN {norm_sql(pick_sql(CLUBS, 'c_custkey'))} = '' THEN 'unknown' ELSE replace({norm_sql(pick_sql(CLUBS, 'c_custkey'))}, ' ', '-') END AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE least(greatest(c_acctbal / 10000, 0.5), 0.95) END AS threshold,
 CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 18.0 WHEN 1 THEN 16.0 WHEN 2 THEN 14.0 ELSE 12.0 END WHEN c_custkey % 3 = 1 THEN least(10.0, greatest(1.0, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 1000 END, 6.0))) ELSE 0.0 END AS favorite,
 lower(trim(regexp_replace(translate({pick_sql(CLUBS, 'c_custkey')} || '. É-x', 'ÅÄÖåäöÉéÜü', 'AAOaaoEeUu'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'))) AS name FROM customer"""
)
def x06_x42_x47_q09_c07_small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("c_custkey"), lambda x: F.lit(float(x))
    threshold = R.similarity_threshold(F.when(k % 4 == 0, d("nan")).otherwise(F.col("c_acctbal") / 10000))
    favorite = R.trusted_favorite(k % 3 == 0, pick(["player", "team", "league", "staff", "other"], k), k % 3 == 1, F.when(k % 2 == 0, F.col("c_acctbal") / 1000))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(R.label_list(pick(LABELS, k)), ";").alias("labels"), R.fallback_entity_id(F.lit("football"), F.lit("team"), pick(CLUBS, k)).alias("entity_id"),
        F.when(F.isnan(threshold), -1.0).otherwise(threshold).alias("threshold"), favorite.alias("favorite"), R.catalog_name(F.concat(pick(CLUBS, k), F.lit(". É-x"))).alias("name"),
    )


@query("SELECT c_custkey, NOT (c_custkey % 3 = 0) AND c_custkey % 2 = 0 AS enabled FROM customer")
def s19_disable_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    subscriptions = c.select("c_custkey", k.alias("endpoint"), (k % 2 == 0).alias("enabled"))
    results = c.select(k.alias("endpoint"), F.when(k % 6 == 0, 404).when(k % 3 == 0, 410).otherwise(500).alias("status"))
    return tables.without_gone(subscriptions, results.unionByName(results)).select("c_custkey", "enabled")


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def a15_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.counters(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("reason")))


@query(
    "WITH " + sql_rows("s", "sport, organization, competition", [("football", "Ajax", "Eredivisie"), ("hockey", " ", "KHL")]) + """, p AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'football' ELSE 'hockey' END AS sport, n_name AS club, r_name AS league, s_suppkey % 3 = 0 AS domestic FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT DISTINCT * FROM (SELECT sport, 'club' AS kind, club AS term FROM p WHERE NOT domestic UNION ALL SELECT sport, 'club', unnest([club || ' IF', club || ' FC']) FROM p WHERE NOT domestic AND sport = 'football' UNION ALL SELECT sport, 'league', league FROM p WHERE NOT domestic
 UNION ALL SELECT sport, 'staff_organization', organization FROM s WHERE trim(organization) <> '' UNION ALL SELECT sport, 'staff_competition', competition FROM s)"""
)
def j32_related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    placed = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    players = s.join(placed, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("s_suppkey") % 2 == 0, "football").otherwise("hockey").alias("sport"), F.col("n_name").alias("club"), F.col("r_name").alias("league"), (F.col("s_suppkey") % 3 == 0).alias("domestic"))
    teams = n.select(F.lit("football").alias("sport"), F.upper("n_name").alias("name"), F.array(F.concat("n_name", F.lit(" IF")), F.concat("n_name", F.lit(" FC"))).alias("aliases"))
    return R.related_terms(players, teams, rows(spark, [("football", "Ajax", "Eredivisie"), ("hockey", " ", "KHL")], "sport string, organization string, competition string"))
