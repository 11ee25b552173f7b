"""Registered queries by name, and the DuckDB SQL each is checked against.

The queries apply the operators to the driver's tables: `documents` stand for articles (the first sentence is the title, the
id sets a time, the language a sport), `pages` for web pages, `events` for the event log, and the order tables for
entities and their hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import classify, scoring
from newsloom.functions import text as X
from newsloom.operators import graph, rank, relational
from newsloom.sources import feeds
from newsloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def now() -> Column:
    """The clock of the queries: fixed, so that results don't depend on when they run."""
    return F.lit("2024-01-08 00:00:00").cast("timestamp")




def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, sport, title, url, source, published_at, ordinal, tags, priority."""
    title = F.get(F.split("text", r"[.!?][ \t]|\n"), F.lit(0))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "football").otherwise("hockey").alias("sport"), title.alias("title"),
        F.concat(F.lit("https://Example.org/"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("/?q="), F.col("doc_id").cast("string")).alias("url"),
        "source", F.timestamp_micros(F.lit(1704067200000000) + F.pmod(F.col("doc_id") * 7919, F.lit(10080)) * 60000000).alias("published_at"),
        F.col("doc_id").alias("ordinal"), F.slice(X.tokens(F.lower("title")), 1, 3).alias("tags"), F.pmod(F.col("doc_id"), F.lit(100)).cast("int").alias("priority"),
    )


A = r"""WITH art AS (SELECT doc_id, doc_id AS id, CASE WHEN lang = 'en' THEN 'football' ELSE 'hockey' END AS sport, string_split_regex(text, '[.!?][ \t]|\n')[1] AS title,
 'https://Example.org/' || source || '/' || (doc_id // 2)::VARCHAR || '/?q=' || doc_id::VARCHAR AS url, source,
 TIMESTAMP '2024-01-01' + to_minutes(((doc_id * 7919) % 10080)::BIGINT) AS published_at, doc_id AS ordinal, (doc_id % 100)::INT AS priority FROM documents)"""
FROM, TO = (t.replace("'", "''") for t in (X.ACCENTED, X.PLAIN))


def fold_sql(c: str) -> str:
    return rf"regexp_replace(translate(coalesce({c}, ''), '{FROM}', '{TO}'), '[\x{{0300}}-\x{{036f}}]', '', 'g')"


def norm_sql(c: str, keep: str = "") -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({fold_sql(c)}), '[^\p{{L}}\p{{N}}\s{keep}]', ' ', 'g'), '\s+', ' ', 'g'))"


# Scalar functions -----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, md5({fold_sql('text')}) AS folded, md5({norm_sql('text')}) AS normalized, md5(trim(lower({fold_sql('text')}))) AS kept,
 md5({norm_sql('text', "''-")}) AS policy, md5(trim(regexp_replace(lower({fold_sql('text')}), '\\s+', ' ', 'g'))) AS browse FROM documents"""
)
def x01_x05_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(X.fold(t)).alias("folded"), F.md5(X.normalize(t)).alias("normalized"), F.md5(X.normalize_keep(t)).alias("kept"),
        F.md5(X.normalize_policy(t)).alias("policy"), F.md5(X.normalize_browse(t)).alias("browse"),
    )


@query(
    A + f""" SELECT doc_id, trim(regexp_replace({norm_sql("p")}, '^({'|'.join(X.STORY_PREFIXES)})\\s+', '')) AS story,
 {norm_sql("regexp_replace(lower(" + fold_sql("p") + "), '^\\s*(" + '|'.join(X.DUPLICATE_PREFIXES) + ")\\b\\s*[:!-]*\\s*', '')")} AS duplicate
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'JUST NU: ' WHEN doc_id % 3 = 1 THEN 'Breaking - ' ELSE '' END || title AS p FROM art)"""
)
def x07_x08_title_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.pmod("doc_id", F.lit(3))
    p = F.concat(F.when(m == 0, "JUST NU: ").when(m == 1, "Breaking - ").otherwise(""), "title")
    return articles(spark, sf_dir).select("doc_id", X.story_title(p).alias("story"), X.duplicate_title(p).alias("duplicate"))


@query(
    A + rf""" SELECT doc_id, regexp_replace(regexp_replace(lower({fold_sql('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS ascii_slug,
 regexp_replace(regexp_replace(lower({fold_sql('title')}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS unicode_slug FROM art"""
)
def x09_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("doc_id", X.slug(F.col("title")).alias("ascii_slug"), X.unicode_slug(F.col("title")).alias("unicode_slug"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def x10_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


@query(
    f"""SELECT doc_id, list_contains(string_split(n, ' '), 'the') AS token, contains(n, 'of the') AS phrase, contains(' ' || n || ' ', ' la ') AS padded
 FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents)"""
)
def x11_x12_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", X.contains_term(n, F.lit("the")).alias("token"), X.contains_term(n, F.lit("of the")).alias("phrase"), X.contains_phrase(n, F.lit("la")).alias("padded"))


def _gram_sql(c: str, pad: str) -> str:
    return f"CASE WHEN {c} = '' THEN [] ELSE list_distinct(list_transform(range(1, length('{pad}' || {c} || '{pad}') - 1), lambda i: substring('{pad}' || {c} || '{pad}', i, 3))) END"


def _jac_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    A + f""", n AS (SELECT doc_id, {norm_sql('title')} AS t FROM art), g AS (SELECT doc_id, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w, {_gram_sql('t', '  ')} AS g2, {_gram_sql('t', ' ')} AS g1 FROM n)
 SELECT a.doc_id, round({_jac_sql('a.w', 'b.w')}, 9) AS words, round(greatest({_jac_sql('a.w', 'b.w')}, {_jac_sql('a.g2', 'b.g2')}), 9) AS wide, round(greatest({_jac_sql('a.w', 'b.w')}, {_jac_sql('a.g1', 'b.g1')}), 9) AS narrow
 FROM g a JOIN g b ON b.doc_id = a.doc_id + 1"""
)
def x13_x17_title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("doc_id", X.normalize(F.col("title")).alias("t"))
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    t, u = F.col("t"), F.col("u")
    words = X.jaccard(F.array_distinct(X.tokens(t)), F.array_distinct(X.tokens(u)))
    return rows.join(nxt, "doc_id").select("doc_id", F.round(words, 9).alias("words"), F.round(X.title_similarity(t, u), 9).alias("wide"), F.round(X.title_similarity(t, u, True), 9).alias("narrow"))


@query(
    A + f""" SELECT doc_id, CASE WHEN n ~ '\\b(red card|rott kort|utvisning|matchstraff)\\b' THEN 'red_card' WHEN regexp_matches(n, '(^| )(en|de)( |$)') THEN 'has' ELSE 'none' END AS kind,
 regexp_matches(n, '\\b[uj](\\d{{1,2}}|lag)\\b|\\bj-lag\\b|\\bjunior\\b') AS junior FROM (SELECT doc_id, {norm_sql('title')} AS n FROM art)""".replace("n ~ '", "regexp_matches(n, '").replace("\\b' THEN", "\\b') THEN")
)
def p14_x19_title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("doc_id", X.normalize(F.col("title")).alias("n"))
    rules = [*classify.CANONICAL_EVENTS[:1], ("has", "(^| )(en|de)( |$)")]
    return rows.select("doc_id", F.coalesce(classify.first_rule(F.col("n"), rules), F.lit("none")).alias("kind"), classify.junior_team(F.col("n")).alias("junior"))


@query(
    """SELECT c_custkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT c_custkey, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2) AS a
 FROM (SELECT c_custkey, (c_custkey % 180 - 90)::DOUBLE AS lat1, (c_custkey % 360 - 180)::DOUBLE AS lng1, c_nationkey::DOUBLE AS lat2, (c_nationkey * 3)::DOUBLE AS lng2 FROM customer))"""
)
def x22_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    km = X.haversine_km(d(k % 180 - 90), d(k % 360 - 180), d(n), d(n * 3))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(km, 6).alias("km"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w),
 f AS (SELECT doc_id, min(i) AS i, arg_min(x, i) AS x FROM e GROUP BY doc_id, lower(x)), g AS (SELECT doc_id, md5(array_to_string(list(x ORDER BY i), ' ')) AS tags FROM f GROUP BY doc_id) SELECT doc_id, coalesce(tags, md5('')) AS tags FROM documents LEFT JOIN g USING (doc_id)"""
)
def x26_distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(X.distinct_ignoring_case(words), " ")).alias("tags"))


@query(
    """SELECT event_id, CASE WHEN m < 2 THEN 'live' WHEN m < 60 THEN floor(m)::BIGINT::VARCHAR || ' min' ELSE floor(m / 60)::BIGINT::VARCHAR || ' h' END AS label
 FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7 AS m FROM events)"""
)
def x36_time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rank.age_minutes(F.lit("2024-02-01").cast("timestamp"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", X.time_ago(m).alias("label"))


@query(
    A + r""" SELECT doc_id, round(greatest(0.0, 120 - 30 * h) - CASE WHEN regexp_matches(lower(title), '\b(live)\b') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(lower(title), '\b(the)\b') THEN 8 ELSE 0 END + least(8, floor(length(title) / 25)), 6) AS score
 FROM (SELECT doc_id, title, (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 3.6e9 AS h FROM art)"""
)
def x37_top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = rank.top_score(rank.age_minutes(now(), F.col("published_at")) / 60, F.col("title"), ["live"], ["the"])
    return articles(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"))


@query("SELECT c_custkey, least(greatest(CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) ELSE ceil(c_acctbal) END, 0), 5000)::BIGINT AS clamped, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment END), '') AS segment FROM customer")
def q08_x40_clamp_and_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.clamp_int(F.col("c_acctbal"), 0, 5000, 0).alias("clamped"), X.blank_to_null(segment).alias("segment"))


@query(
    f"""SELECT n_nationkey, CASE WHEN n = 'france' THEN 140 WHEN starts_with(n, 'i') THEN 110 WHEN contains(n, 'i') THEN 90 END AS score
 FROM (SELECT n_nationkey, {norm_sql('n_name')} AS n FROM nation)"""
)
def x30_browse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.normalize_browse(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(n == "france", 140).otherwise(X.match_score(n, F.lit("i"))).alias("score"))


# Sources --------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g'))) AS cleaned FROM pages"""
)
def s06_clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(feeds.clean(F.col("html"), numeric=False)).alias("cleaned"))


@query(
    r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1), 1) - 1 AS k FROM pages)
 SELECT url AS page, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS link, min(k)::BIGINT AS ordinal FROM a GROUP BY ALL"""
)
def s07_listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.listing_links(table(spark, sf_dir, "pages")).select("page", "link", F.col("ordinal").cast("long").alias("ordinal"))


@query(A + " SELECT doc_id, sport, published_at FROM art WHERE sport = 'football' ORDER BY published_at DESC, doc_id LIMIT 200")
def s13_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where("sport = 'football'").orderBy(F.col("published_at").desc(), "doc_id").limit(200).select("doc_id", "sport", "published_at")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def s16_s20_upsert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changes = rows.where("c_custkey % 5 = 0")
    new = changes.withColumn("ordinal", F.lit(1)).unionByName(changes.withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("ordinal", F.lit(2)))
    return relational.merge_delete(relational.merge_upsert(rows, new, ["c_custkey"], "ordinal"), rows.where("c_custkey % 7 = 0"), ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')")
def s15_j07_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def s18_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = rows.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X"))
    return relational.merge_update_when(rows, changes, ["o_orderkey"], "o_orderstatus", F.col("o_orderstatus") == "O")


# Filters --------------------------------------------------------------------------------------------------------------


@query(A + " SELECT doc_id FROM art WHERE (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 3.6e9 <= 12")
def p02_p16_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.within_hours(articles(spark, sf_dir), now(), 12, missing=True).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {norm_sql('text', chr(39) * 2 + '-')} AS n FROM documents) WHERE NOT (contains(n, 'queaux') OR contains(n, 'ingth') OR contains(n, 'golf'))")
def p03_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.evaluated(table(spark, sf_dir, "documents").select("doc_id", "text"), {"n": X.normalize_policy(F.col("text"))})
    return rows.where(~classify.substring_any(F.col("n"), ["queaux", "ingth", "golf"])).select("doc_id")


@query(A + " SELECT source, doc_id FROM art QUALIFY row_number() OVER (PARTITION BY source ORDER BY ordinal) <= 80")
def p07_cap_per_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(articles(spark, sf_dir), ["source"], 80, F.col("ordinal")).select("source", "doc_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_type IN ('click', 'view') AND value IS NOT NULL AND value BETWEEN 0 AND 1e6) AS valid FROM events GROUP BY 1")
def p24_event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type").isin("click", "view") & F.col("value").isNotNull() & F.col("value").between(0, 1e6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def p30_limit_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(table(spark, sf_dir, "events").where("event_type = 'click'"), ["user_id"], 5, F.col("ts"), F.col("event_id")).select("user_id", "event_id")


# Joins ----------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name AS team_name, r_name AS league_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j02_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("team_id"), F.lit(None).cast("string").alias("league_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("team_id"), F.concat(F.lit("r"), "n_regionkey").alias("league_id"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("team_id"), F.lit(None).cast("string").alias("league_id"))
    out = relational.two_hop(r.unionByName(n).unionByName(c)).where("id LIKE 'c%'")
    return out.select(F.expr("substring(id, 2)").cast("long").alias("c_custkey"), "team_name", "league_name")


@query(
    f"""WITH t AS (SELECT item_id, {norm_sql('text')} AS term FROM benchmark), d AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents)
 SELECT doc_id, item_id FROM d JOIN t ON term <> '' AND contains(' ' || n || ' ', ' ' || term || ' ')"""
)
def j04_phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term"))
    return relational.phrase_join(table(spark, sf_dir, "documents").select("doc_id", "text"), terms).select("doc_id", "item_id").distinct()


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase')")
def j08_hide_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query(
    A + f""", k AS (SELECT doc_id, sport, published_at, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', '') AS u FROM art)
 SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.u = b.u AND a.sport = b.sport AND a.doc_id < b.doc_id AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 21600000000"""
)
def j17_url_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_urls(articles(spark, sf_dir))


# Articles that came out close together: eight ids share a time and minutes within it, and two outlets tell the same.
CLOSE = f"""{A}, close AS (SELECT doc_id, sport, u, minute, duplicate, list_distinct(list_filter(string_split(duplicate, ' '), lambda x: x <> '')) AS w, {_gram_sql('duplicate', '  ')} AS g FROM (SELECT doc_id, sport,
  'https://example.org/' || (doc_id // 2)::VARCHAR AS u, (doc_id // 8) * 600 + (doc_id % 8) * 60 AS minute,
  {norm_sql("regexp_replace(lower(" + fold_sql('title') + "), '^\\s*(" + '|'.join(X.DUPLICATE_PREFIXES) + ")\\b\\s*[:!-]*\\s*', '')")} AS duplicate FROM art)),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.u = b.u THEN 'canonical-url' ELSE 'title-similarity' END AS kind FROM close a JOIN close b ON a.sport = b.sport AND a.doc_id < b.doc_id 
  WHERE CASE WHEN abs(a.minute - b.minute) > 360 THEN FALSE WHEN a.u = b.u THEN TRUE ELSE greatest({_jac_sql('a.w', 'b.w')}, {_jac_sql('a.g', 'b.g')}) >= 0.5 END)"""


def close_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    at = F.timestamp_micros(F.lit(1704067200000000) + (F.floor(k / 8) * 600 + F.pmod(k, F.lit(8)) * 60) * 60000000)
    url = F.concat(F.lit("https://Example.org/"), F.floor(k / 2).cast("string"), F.lit("/?q="), k.cast("string"))
    return articles(spark, sf_dir).withColumns({"published_at": at, "url": url})


@query(CLOSE + " SELECT a, b, kind FROM pairs")
def j17_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_pairs(close_articles(spark, sf_dir), threshold=0.5)


@query(
    CLOSE + """, reach AS (SELECT node, min(least(node, other)) AS low FROM (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY node)
 SELECT node AS id, CASE WHEN node IN (SELECT a FROM pairs WHERE kind = 'canonical-url' UNION SELECT b FROM pairs WHERE kind = 'canonical-url') THEN TRUE ELSE FALSE END AS by_url FROM reach"""
)
def a03_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.materialized(graph.similar_pairs(close_articles(spark, sf_dir), threshold=0.5))
    groups, urls = graph.groups_of(pairs), pairs.where("kind = 'canonical-url'")
    own = urls.select(F.col("a").alias("id")).unionByName(urls.select(F.col("b").alias("id"))).distinct().withColumn("by_url", F.lit(True))
    return groups.select("id").join(own, "id", "left").select("id", F.coalesce("by_url", F.lit(False)).alias("by_url"))


@query("SELECT n_name, n_nationkey FROM nation GROUP BY ALL HAVING count(*) = 1")
def j22_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unique_lookup(table(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query(
    """WITH p AS (SELECT c_custkey, (c_custkey % 120 - 60)::DOUBLE AS lat, (c_custkey % 300 - 150)::DOUBLE AS lng FROM customer),
 s AS (SELECT s_suppkey, (s_suppkey % 120 - 60)::DOUBLE AS la, (s_suppkey % 300 - 150)::DOUBLE AS ln FROM supplier),
 d AS (SELECT c_custkey, s_suppkey, power(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * power(sin(radians(ln - lng) / 2), 2) AS a FROM p, s),
 k AS (SELECT c_custkey, s_suppkey, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM d)
 SELECT c_custkey, arg_min(s_suppkey, (km, s_suppkey)) AS s_suppkey, round(min(km), 6) AS km FROM k WHERE km <= 500 GROUP BY 1"""
)
def j24_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, key: (
        (F.col(key) % 120 - 60).cast("double").alias("lat"), (F.col(key) % 300 - 150).cast("double").alias("lng"))
    points = table(spark, sf_dir, "customer").select("c_custkey", *at(0, "c_custkey"))
    places = table(spark, sf_dir, "supplier").select("s_suppkey", *at(0, "s_suppkey"))
    return relational.nearest(points, places, "c_custkey", "s_suppkey", 500).withColumn("km", F.round("km", 6))


# Aggregations ---------------------------------------------------------------------------------------------------------


@query(
    A + """ SELECT source, stage, count(*) AS n FROM (SELECT source, CASE WHEN trim(title) = '' THEN 'title' WHEN (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 3.6e9 > 48 THEN 'age' WHEN sport <> 'football' THEN 'sport' ELSE 'kept' END AS stage FROM art) GROUP BY ALL"""
)
def a01_ingest_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [("title", F.trim("title") != ""), ("age", rank.age_minutes(now(), F.col("published_at")) <= 48 * 60), ("sport", F.col("sport") == "football")]
    return relational.funnel(articles(spark, sf_dir), stages, ["source"])


@query("SELECT user_id, array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') AS kinds FROM events GROUP BY 1")
def a02_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id <> b.doc_id)
 SELECT x AS node, min(least(x, y)) AS component FROM e GROUP BY x"""
)
def a03_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    heads = d.groupBy("h").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return graph.connected_components(d.join(heads, "h").select("a", F.col("doc_id").alias("b")))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
 SELECT user_id, min(ts) AS cluster_start, count(*) AS members, count(DISTINCT event_type) AS sources, arg_max(event_id, (ts, -event_id)) AS representative, least(8, 2 * (count(DISTINCT event_type) - 1)) AS intensity
 FROM c GROUP BY user_id, k HAVING count(*) > 1"""
)
def a05_event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.event_clusters(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


@query("SELECT event_type, max(ts) AS latest FROM events GROUP BY GROUPING SETS ((), (event_type))")
def a10_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.max("ts").alias("latest"))


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 HAVING count(*) > 3")
def a12_a16_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).where("n > 3")


# Windows, orders, sets ------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS ten, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day
 FROM (SELECT event_id, user_id, epoch(ts)::BIGINT AS s FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))"""
)
def w11_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.trailing_counts(table(spark, sf_dir, "events"), "user_id", "ts", {"ten": 600, "day": 86400}).select("event_id", "ten", "day")


@query(
    A + """ SELECT doc_id, CASE WHEN m <= 30 THEN 0 WHEN m <= 90 THEN 1 WHEN m <= 180 THEN 2 WHEN m <= 360 THEN 3 ELSE 4 END AS bucket, CASE WHEN m <= 180 THEN 'fresh' WHEN m <= 360 THEN 'fallback' WHEN m <= 4320 THEN 'backfill' END AS slice
 FROM (SELECT doc_id, (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 6e7 AS m FROM art)"""
)
def w13_w14_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("published_at")
    return articles(spark, sf_dir).select("doc_id", rank.freshness_bucket(now(), p).alias("bucket"), rank.freshness_slice(now(), p).alias("slice"))


@query(A + f" SELECT source, doc_id FROM (SELECT *, {norm_sql('title')} AS n FROM art) QUALIFY row_number() OVER (PARTITION BY source, n ORDER BY published_at DESC, doc_id) = 1")
def w03_source_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumn("n", X.normalize(F.col("title")))
    return relational.first_of(rows, ["source", "n"], F.col("published_at").desc(), F.col("doc_id")).select("source", "doc_id")


@query(A + " SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY priority DESC, published_at DESC, doc_id) AS position FROM art QUALIFY position <= 20")
def k01_k07_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumn("score", F.col("priority"))
    return rank.top_k(rows, ["source"], 20, *rank.score_order()).select("source", "doc_id", F.col("position").cast("long").alias("position"))


@query(A + " SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY priority % 7 = 0 DESC, doc_id) AS position FROM art")
def k05_favorites_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.ordered(articles(spark, sf_dir).withColumn("favorite_match", F.col("priority") % 7 == 0), ["source"], F.col("doc_id"))
    return rank.favorites_first(rows, ["source"]).select("source", "doc_id", F.col("position").cast("long").alias("position"))


@query(
    A + """, f AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 6e7 AS m FROM art), p AS (SELECT * FROM f QUALIFY (m <= 90)::INT = max((m <= 90)::INT) OVER (PARTITION BY source)),
 t AS (SELECT * FROM p QUALIFY (epoch_us(max(published_at) OVER (PARTITION BY source)) - epoch_us(published_at)) / 6e7 <= 20)
 SELECT source, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY priority % 10 = 0 DESC, priority % 7 = 0 DESC, priority DESC, published_at DESC, doc_id) = 1"""
)
def k08_top_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumns({"special": F.col("priority") % 10 == 0, "favorite_match": F.col("priority") % 7 == 0, "score": F.col("priority")})
    return rank.top_highlight(rows, ["source"], now()).select("source", "doc_id")


@query("SELECT user_id, event_id FROM (SELECT *, 0 AS part FROM events WHERE event_type = 'purchase' UNION ALL SELECT *, 1 FROM events WHERE event_type = 'click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1")
def u01_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return relational.union_first([e.where("event_type = 'purchase'"), e.where("event_type = 'click'")], ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def u06_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_position_wins(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def u04_u05_except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").subtract(table(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey"))


# Scoring and streaming forms ------------------------------------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "array<struct<entity_id:string,sport:string,type:string,name:string,is_swedish:boolean,is_abroad_core:boolean>>"
    rows = articles(spark, sf_dir).withColumns({
        "entity_hits": F.array().cast(none), "editorial": F.lit(None).cast("struct<category:string,status:string,breaking:boolean>"),
        "duplicate_count": F.pmod("doc_id", F.lit(6)), "event_intensity": F.pmod("doc_id", F.lit(3)),
    })
    return scoring.score_articles(rows, now())


@query(
    A + """, s AS (SELECT doc_id, sport, source, priority, (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 3.6e9 AS h FROM art)
 SELECT doc_id, CASE WHEN h <= 1 THEN 18 WHEN h <= 3 THEN 14 WHEN h <= 6 THEN 11 WHEN h <= 12 THEN 8 WHEN h <= 24 THEN 5 WHEN h <= 48 THEN 2 ELSE 0 END AS recency,
 CASE WHEN priority >= 90 THEN 18 WHEN priority >= 80 THEN 12 WHEN priority >= 50 THEN 6 ELSE 0 END AS priority_score, (doc_id % 3)::BIGINT AS intensity,
 CASE WHEN priority >= 80 THEN 6 WHEN priority >= 50 THEN 3 ELSE 0 END AS core_identity, CASE WHEN h >= 72 THEN 8 WHEN h >= 36 THEN 4 ELSE 0 END AS staleness_penalty, least(12, 3 * (doc_id % 6))::BIGINT AS duplicate_penalty,
 CASE WHEN sport = 'football' THEN 16 ELSE 0 END AS foreign_football_penalty FROM s"""
)
def c01_c17_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "recency", "priority_score", F.col("intensity").cast("long").alias("intensity"), "core_identity", "staleness_penalty", F.col("duplicate_penalty").cast("long").alias("duplicate_penalty"), "foreign_football_penalty")


@query()
def c20_ranked_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: score, floor, order, balance sources, twenty for each sport."""
    kept = rank.score_floor(scored(spark, sf_dir), {"football": (-100.0, -100.0), "hockey": (-100.0, -100.0)})
    few = rank.top_k(kept, ["sport"], 30, *rank.score_order()).select("sport", "doc_id", "source", "score", "published_at", "position")
    return rank.balance_sources(few, ["sport"]).where("position <= 20")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS rows FROM events GROUP BY ALL")
def m10_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.tumbling_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c20_ranked_feed(spark, sf_dir)
