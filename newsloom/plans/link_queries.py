"""Registered queries of stories, entity search, links, favourites and feed documents, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import linking, relational, search, stories
from newsloom.plans.news_queries import NAMES, NEWS, TYPES, news, pick, pick_sql, quoted
from newsloom.plans.registry import _gram_sql, _jac_sql, norm_sql, query, table
from newsloom.sources import feeds

CLUBS = ["Malmö FF", "IFK Göteborg", "AIK", "Djurgårdens IF", "Leeds United", "Real Madrid CF", "Östersunds FK", "Modo Hockey", "BK Häcken", "Inter Milan", "FC Barcelona", "Hammarby", ""]
PROFILES = ["Aftonbladet", "BBC Sport", "Kalmar FF", "Sport", "NHL", "Expressen Sport"]
PROFILE_ALIASES = {"bbc": "BBC Sport", "tidningen": "Aftonbladet"}
OUTLETS = ["Aftonbladet", "BBC", "bbc sport online", "Barometern – Kalmar FF", "Expressen Sport", "SVT Sport", "nhl.com", "Tidningen", "Blog", "", "Sportbladet / Aftonbladet"]
REGIONS = [("kalmar", "Kalmar", 56.66, 16.36, ["kalmar", "kalmar ff", "öland"]), ("malmo", "Malmö", 55.60, 13.00, ["malmö", "mff", "malmö ff", "skåne"]), ("vasby", "Väsby", 59.52, 17.91, ["väsby", "öland"])]
CITY_ALIASES = {"nybro": "kalmar", "lund": "malmo", "sollentuna": "vasby"}


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def sql_rows(name: str, columns: str, values: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, v)) + ")" for v in values) + ")"


# Stories ---------------------------------------------------------------------------------------------------------------

STORY = norm_sql("title")


@query(
    NEWS + f""", s AS (SELECT doc_id, sport, published_at, [(doc_id % 50)::VARCHAR, 'x' || (doc_id * 3 % 70)::VARCHAR] AS e, trim(regexp_replace({STORY}, '^({'|'.join(X.STORY_PREFIXES)})\\s+', '')) AS t FROM news),
 g AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w, {_gram_sql('t', '  ')} AS g FROM s),
 p AS (SELECT a.doc_id AS id, b.doc_id AS other, greatest({_jac_sql('a.w', 'b.w')}, {_jac_sql('a.g', 'b.g')}) AS similarity FROM g a JOIN g b ON a.sport = b.sport AND a.doc_id <> b.doc_id
 AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 10800000000 AND list_has_any(a.e, b.e))
 SELECT id, other, round(similarity, 9) AS similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS position FROM p WHERE similarity >= 0.1 QUALIFY position <= 3"""
)
def j19_k13_story_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    base = news(spark, sf_dir).select(k.alias("id"), "sport", "title", "published_at", F.array((k % 50).cast("string"), F.concat(F.lit("x"), (k * 3 % 70).cast("string"))).alias("entity_ids"), k.alias("ordinal"))
    return stories.story_candidates(base, base).select("id", "other", F.round("similarity", 9).alias("similarity"), F.col("position").cast("long").alias("position"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(k % 4 < 3).select(k.cast("string").alias("item"), F.concat(F.lit("s"), F.floor(k / 8).cast("string")).alias("story"))


MEMBERS = "WITH m AS (SELECT doc_id::VARCHAR AS item, 's' || (doc_id // 8)::VARCHAR AS story FROM documents WHERE doc_id % 4 < 3)"


@query(
    MEMBERS + """, own AS (SELECT DISTINCT story FROM m WHERE item::BIGINT % 11 = 0) SELECT story, array_to_string(list(item ORDER BY item), ' ') AS items FROM m WHERE story IN (SELECT story FROM own) GROUP BY story"""
)
def j10_a11_story_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    found = stories.story_index(m, m.where(F.col("item").cast("long") % 11 == 0))
    return stories.story_members(found).select("story", F.array_join("items", " ").alias("items"))


@query(
    MEMBERS + """, k AS (SELECT doc_id, coalesce(story, doc_id::VARCHAR) AS key FROM documents LEFT JOIN m ON item = doc_id::VARCHAR) SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 10 = 0)"""
)
def j08_hide_read_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item"))
    return stories.hide_read(items, items.where("doc_id % 10 = 0").select("item"), members(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id, array_to_string(list_distinct(list_filter([doc_id::VARCHAR, CASE WHEN doc_id % 3 = 0 THEN 's1' END, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END, 'z', ''], lambda x: x IS NOT NULL AND x <> '')).list_sort(), ' ') AS keys FROM documents")
def x41_read_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    keys = stories.read_keys(k, F.when(k % 3 == 0, "s1"), F.array(F.when(k % 2 == 0, k.cast("string")), F.lit("z"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(keys), " ").alias("keys"))


@query(
    """WITH l AS (SELECT user_id, event_id % 400 AS item FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 400) <= 20), s AS (SELECT DISTINCT user_id, event_id % 400 AS item FROM events WHERE event_type = 'click')
 SELECT DISTINCT l.user_id AS device, l.item FROM l JOIN documents ON doc_id = l.item ANTI JOIN s ON l.user_id = s.user_id AND l.item = s.item"""
)
def j09_pushed_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), (F.col("event_id") % 400).alias("item"), F.col("ts").alias("sent_at"), "event_type")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"))
    return stories.pushed_unread(e.where("event_type = 'view'"), e.where("event_type = 'click'"), docs, latest=20).select("device", "item")


# Search ----------------------------------------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as leagues, nations as teams and suppliers as players, each known by what it belongs to as well."""
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    make = lambda df, mark, key, kind, name, alias: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.lit("football").alias("sport"), F.lit(kind).alias("type"), F.col(name).alias("name"), X.slug(F.col(name)).alias("slug"), alias.alias("aliases"), F.col(key).cast("long").alias("ordinal"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        make(t("region"), "l", "r_regionkey", "league", "r_name", F.array().cast("array<string>")).unionByName(make(n, "t", "n_nationkey", "team", "n_name", F.array("r_name")))
        .unionByName(make(s, "p", "s_suppkey", "player", "s_name", F.array("n_name")))
    )


CATALOG = """WITH c AS (SELECT 'l' || r_regionkey AS id, 'league' AS type, r_name AS name, []::VARCHAR[] AS aliases FROM region UNION ALL SELECT 't' || n_nationkey, 'team', n_name, [r_name] FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'p' || s_suppkey, 'player', s_name, [n_name] FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 s AS (SELECT *, list_filter(list_transform([name] || aliases, lambda x: CASE WHEN lower(x) = '{q}' THEN 140 WHEN starts_with(lower(x), '{q}') THEN 110 WHEN contains(lower(x), '{q}') THEN 90 END), lambda x: x IS NOT NULL)[1] AS score FROM c)"""


@query(
    CATALOG.format(q="ia") + """, b AS (SELECT * FROM s WHERE score > 0 QUALIFY score >= greatest(90, max(score) OVER (PARTITION BY type) - 20)), o AS (SELECT *, CASE type WHEN 'league' THEN 1 WHEN 'team' THEN 2 ELSE 3 END AS rank FROM b)
 SELECT id, type, score, row_number() OVER (ORDER BY rank, score DESC, name, id) AS position FROM o QUALIFY position <= 30"""
)
def f06_w17_u02_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.suggestions(catalog(spark, sf_dir), "football", "IA")
    return found.select("id", "type", F.col("score").cast("int").alias("score"), F.col("position").cast("long").alias("position"))


@query(CATALOG.format(q="america") + " SELECT id, name, score FROM s WHERE score > 0 AND type = 'team' ORDER BY score DESC, name, id LIMIT 30")
def s21_search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_entities(catalog(spark, sf_dir), "football", " America ", kind="team").select("id", "name", F.col("score").cast("int").alias("score"))


@query(
    """WITH a AS (SELECT 't' || n_nationkey AS entity_id, n_name || ' FC.' AS alias, CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE lower(n_name) END AS normalized FROM nation UNION ALL SELECT 'gone', 'x', 'x')
 SELECT entity_id, n_name AS name, alias, CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, '_', ' ')) || ' fc' ELSE lower(n_name) END AS normalized, (length(n_name) + CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS length FROM a JOIN nation ON entity_id = 't' || n_nationkey"""
)
def j03_alias_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("entity_id"), F.concat("n_name", F.lit(" FC.")).alias("alias"), F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.lower("n_name")).alias("normalized"))
    aliases = n.unionByName(rows(spark, [("gone", "x", "x")], "entity_id string, alias string, normalized string"))
    return search.alias_records(aliases, catalog(spark, sf_dir), "football").select("entity_id", "name", "alias", "normalized", F.col("length").cast("long").alias("length"))


@query("SELECT o_custkey AS id, min(o_orderkey) AS ordinal, (SELECT array_to_string(list(DISTINCT p ORDER BY p), ' ') FROM (SELECT o_orderpriority AS p FROM orders i WHERE i.o_custkey = o.o_custkey)) AS aliases FROM orders o GROUP BY o_custkey")
def u09_merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("football").alias("sport"), F.lit("team").alias("type"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.array("o_orderpriority", F.lit("")).alias("aliases"))
    return search.merge_aliases(o).select("id", "ordinal", F.array_join(F.sort_array("aliases"), " ").alias("aliases"))


@query(
    """WITH r AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 4 = 0 THEN '123e4567-e89b-42d3-a456-42661417400' || (c_custkey % 10) ELSE 'x' END AS given, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN lower(n_name) ELSE ' ' || n_name || ' ' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT request, CASE WHEN request % 4 = 0 THEN given ELSE 't' || n_nationkey END AS entity_id FROM r LEFT JOIN nation ON lower(trim(name)) = lower(n_name)"""
)
def j33_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = c.select(
        k.alias("request"), F.when(k % 4 == 0, F.concat(F.lit("123e4567-e89b-42d3-a456-42661417400"), (k % 10).cast("string"))).otherwise("x").alias("given"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 3 == 0, F.lower("n_name")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("name"),
        F.lit("football").alias("sport"), F.lit("team").alias("type"),
    )
    return search.resolve_names(asked, catalog(spark, sf_dir)).select("request", "entity_id")


# Links -----------------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT l_orderkey AS item, l_partkey AS entity_id, min(l_linenumber) AS ordinal FROM lineitem GROUP BY ALL)
 SELECT item, array_to_string(list(entity_id ORDER BY ordinal, entity_id), ' ') AS ids, coalesce(array_to_string(list(p_name ORDER BY ordinal, entity_id) FILTER (p_name IS NOT NULL), ' '), '') AS names FROM l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = entity_id GROUP BY item"""
)
def j01_item_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("ordinal"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    found = linking.item_entities(links, parts)
    return found.select("item", F.array_join(F.transform("entity_ids", lambda x: x.cast("string")), " ").alias("ids"), F.array_join(F.transform("entities", lambda x: x["name"]), " ").alias("names"))


CATALOG_ROWS = [(f"e{k}", "football" if k % 2 else "hockey", TYPES[k], n, [n.split()[-1]] if k != 5 else ["Isak"], k) for k, n in enumerate(NAMES)]


@query(
    NEWS + ", " + sql_rows("c", "entity_id, sport, type, name, aliases, ordinal", CATALOG_ROWS) + f""", a AS (SELECT doc_id, sport, {norm_sql("title || ' ' || coalesce(summary, '')")} AS n FROM news),
 t AS (SELECT *, unnest(list_distinct([name] || aliases)) AS alias FROM c), f AS (SELECT DISTINCT doc_id, t.entity_id, t.type, t.name, t.ordinal FROM a JOIN t ON a.sport = t.sport AND {norm_sql('alias')} <> '' AND contains(' ' || n || ' ', ' ' || {norm_sql('alias')} || ' ')),
 h AS (SELECT doc_id, 'own' AS entity_id, {pick_sql(TYPES, 'doc_id')} AS type, upper({pick_sql(NAMES, 'doc_id')}) AS name FROM news WHERE doc_id % 3 = 0)
 SELECT doc_id AS id, entity_id, 'linked' AS origin FROM h UNION ALL SELECT f.doc_id, f.entity_id, 'detected' FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND h.type = f.type AND lower(h.name) = lower(f.name))"""
)
def j05_enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    base = news(spark, sf_dir)
    own = base.where(k % 3 == 0).select(k.alias("id"), F.lit("own").alias("entity_id"), pick(TYPES, k).alias("type"), F.upper(pick(NAMES, k)).alias("name"))
    known = rows(spark, CATALOG_ROWS, "entity_id string, sport string, type string, name string, aliases array<string>, ordinal int")
    said = base.select(k.alias("id"), "sport", F.concat("title", F.lit(" "), X.text(F.col("summary"))).alias("text"))
    return linking.enrich_hits(said, own, known).select("id", "entity_id", "origin")


@query("SELECT o_orderkey AS item, l_partkey AS entity_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0")
def j06_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    inserted = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://a.se/"), "o_orderkey").alias("url"))
    parsed = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("https://a.se/"), "l_orderkey").alias("url")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("entity_id"), F.lit("a").alias("alias"), F.lit("exact").alias("match_type"))).alias("detected"))
    return linking.new_links(inserted, parsed).select("item", "entity_id")


@query(
    f"""WITH n AS (SELECT c_custkey, list_filter(string_split({norm_sql(pick_sql(CLUBS, 'c_custkey'))}, ' '), lambda x: x <> '') AS w FROM customer), s AS (SELECT *, list_filter(w, lambda x: list_contains({quoted(linking.CLUB_WORDS)}, x)) AS club, list_filter(w, lambda x: NOT list_contains({quoted(linking.CLUB_WORDS)}, x)) AS core FROM n),
 a AS (SELECT *, array_to_string(list_transform(core, lambda x: x[1]), '') || array_to_string(club, '') AS code, array_to_string(list_transform(w, lambda x: x[1]), '') AS initials FROM s)
 SELECT c_custkey, CASE WHEN len(w) < 2 THEN '' WHEN len(club) > 0 AND len(core) > 0 THEN concat_ws(' ', CASE WHEN length(code) BETWEEN 2 AND 8 THEN code END, CASE WHEN length(core[1]) >= 4 THEN core[1] END)
 ELSE concat_ws(' ', CASE WHEN length(initials) BETWEEN 2 AND 5 THEN initials END, CASE WHEN length(w[1]) >= 5 THEN w[1] END) END AS aliases,
 array_to_string(list_transform(list_filter(w, lambda x: length(x) >= 4 AND NOT ends_with(x, 's')), lambda x: x || 's'), ' ') AS possessive FROM a"""
)
def x29_derived_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(CLUBS, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(linking.derived_aliases(name), " ").alias("aliases"), F.array_join(linking.possessives(X.tokens(X.normalize(name))), " ").alias("possessive"))


@query(
    NEWS + f""" SELECT doc_id, {' OR '.join(f"contains(' ' || {norm_sql('title')} || ' ', '{w}') OR len(list_filter(tags, lambda g: contains(' ' || {norm_sql('g')} || ' ', '{w}'))) > 0" for w in (' aik ',))} AS one,
 contains({norm_sql('title')}, 'team n') OR len(list_filter(tags, lambda g: contains({norm_sql('g')}, 'team n'))) > 0 AS several FROM news"""
)
def x31_token_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.normalize(F.col("title"))
    return news(spark, sf_dir).select("doc_id", linking.token_matches(t, F.col("tags"), F.lit("AIK")).alias("one"), linking.token_matches(t, F.col("tags"), F.lit("Team n")).alias("several"))


FOLLOWED = [("f1", "team", "AIK", ["derbyt"], 1), ("f2", "player", "Alexander Isak", ["isak"], 2), ("f3", "league", "Premier League", [], 3), ("f4", "team", "Malmö FF", ["malmo", "mff"], 4), ("f5", "staff", "Nylander", ["modo"], 5)]


@query(
    NEWS + ", " + sql_rows("f", "entity_id, type, name, tokens, ordinal", FOLLOWED) + f""", t AS (SELECT *, unnest(list_distinct([name] || tokens)) AS term FROM f), p AS (SELECT doc_id, unnest([title] || tags) AS said FROM news),
 m AS (SELECT doc_id, entity_id, type, name, ordinal, max({norm_sql('term')} = {norm_sql('name')}) AS exact FROM p JOIN t ON contains(' ' || {norm_sql('said')} || ' ', ' ' || {norm_sql('term')} || ' ') GROUP BY ALL),
 s AS (SELECT *, CASE type WHEN 'player' THEN 300 WHEN 'team' THEN 200 WHEN 'staff' THEN 150 ELSE 100 END AS priority, CASE WHEN exact THEN 50 ELSE 0 END + least(length(name), 25) AS extra FROM m)
 SELECT doc_id AS item, entity_id, priority + extra AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority + extra DESC, priority DESC, length(name) DESC, ordinal) = 1"""
)
def x32_token_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = rows(spark, FOLLOWED, "entity_id string, type string, name string, tokens array<string>, ordinal int")
    found = linking.token_favorites(news(spark, sf_dir).select(F.col("doc_id").alias("item"), "title", "tags"), followed)
    return found.select("item", "entity_id", F.col("score").cast("long").alias("score"))


@query(
    f"""WITH p AS (SELECT c_custkey, list_filter(list_transform(string_split('team:' || n_name || ', ,player:a:' || c_mktsegment || ',' || c_mktsegment || ',Åre,x' || (c_custkey % 3) || ',y,z', ','), lambda v: trim(v)), lambda v: v <> '') AS l FROM customer JOIN nation ON c_nationkey = n_nationkey),
 n AS (SELECT c_custkey, list_transform(l, lambda v: {norm_sql("CASE WHEN contains(v, ':') THEN regexp_replace(v, '^[^:]*:', '') ELSE v END")}) AS l FROM p)
 SELECT c_custkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:5], '|') AS favorites FROM n"""
)
def q10_favorite_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    values = F.array(F.concat(F.lit("team:"), "n_name", F.lit(", ,player:a:"), "c_mktsegment"), F.lit(None).cast("string"), F.concat("c_mktsegment", F.lit(",Åre,x"), (F.col("c_custkey") % 3).cast("string"), F.lit(",y,z")))
    return c.select("c_custkey", F.array_join(linking.favorite_params(values), "|").alias("favorites"))


@query(
    "WITH " + sql_rows("p", "key, ordinal", [(k, i) for i, k in enumerate(PROFILES)]) + ", " + sql_rows("a", "alias, target", list(PROFILE_ALIASES.items())) + f""", s AS (SELECT DISTINCT {pick_sql(OUTLETS, 'c_custkey')} AS source FROM customer),
 n AS (SELECT source, lower(trim(coalesce(target, source))) AS name FROM s LEFT JOIN a ON lower(trim(source)) = alias),
 m AS (SELECT source, key FROM n JOIN p ON contains(name, lower(key)) QUALIFY row_number() OVER (PARTITION BY source ORDER BY (name = lower(key)) DESC, ordinal) = 1)
 SELECT source, coalesce(key, 'default') AS key FROM n LEFT JOIN m USING (source)"""
)
def j25_source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").select(pick(OUTLETS, F.col("c_custkey")).alias("source"))
    profiles, aliases = rows(spark, [(k, i) for i, k in enumerate(PROFILES)], "key string, ordinal int"), rows(spark, list(PROFILE_ALIASES.items()), "alias string, key string")
    return linking.source_profiles(sources, profiles, aliases, "default")


def regions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return rows(spark, REGIONS, "key string, city string, lat double, lng double, terms array<string>"), rows(spark, list(CITY_ALIASES.items()), "alias string, key string")


REGION_SQL = sql_rows("r", "key, city, lat, lng, terms", REGIONS) + ", " + sql_rows("ca", "alias, key", list(CITY_ALIASES.items()))
CITIES = ["Kalmar", "MALMÖ", "nybro", "Lund", "Paris", ""]


@query(
    "WITH " + REGION_SQL + f""", q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {pick_sql(CITIES, 'c_custkey // 3')} END AS debug_city, CASE WHEN c_custkey % 2 = 0 THEN 55.4 + (c_custkey % 40) * 0.1 END AS lat, 13.0 + (c_custkey % 50) * 0.1 AS lng, {pick_sql(CITIES, 'c_custkey // 5')} AS ip_city FROM customer),
 k AS (SELECT c_custkey, key, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT c_custkey, key, power(sin(radians(r.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(r.lat)) * power(sin(radians(r.lng - q.lng) / 2), 2) AS a FROM q, r WHERE q.lat IS NOT NULL)),
 n AS (SELECT c_custkey, arg_min(key, (km, key)) AS near FROM k WHERE km <= 50 GROUP BY 1),
 c AS (SELECT {norm_sql('city')} AS name, key FROM r UNION ALL SELECT alias, key FROM ca)
 SELECT q.c_custkey, coalesce(d.key, near, i.key) AS region, CASE WHEN d.key IS NOT NULL THEN 'debug' WHEN near IS NOT NULL THEN 'coords' WHEN i.key IS NOT NULL THEN 'ip' ELSE 'none' END AS location_source
 FROM q LEFT JOIN n USING (c_custkey) LEFT JOIN c d ON d.name = {norm_sql('debug_city')} LEFT JOIN c i ON i.name = {norm_sql('ip_city')}"""
)
def x23_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(
        k.alias("request"), F.when(k % 3 == 0, pick(CITIES, F.floor(k / 3))).alias("debug_city"), F.when(k % 2 == 0, 55.4 + (k % 40) * 0.1).alias("lat"), (13.0 + (k % 50) * 0.1).alias("lng"), pick(CITIES, F.floor(k / 5)).alias("ip_city"),
    )
    return linking.resolve_regions(asked, *regions(spark)).select(F.col("request").alias("c_custkey"), "region", "location_source")


@query(
    "WITH " + REGION_SQL + f""", t AS (SELECT c_custkey, {norm_sql(pick_sql(CLUBS, 'c_custkey'))} AS a, {norm_sql(pick_sql(CITIES, 'c_custkey'))} AS b FROM customer), x AS (SELECT key, unnest(list_transform([city] || terms, lambda v: {norm_sql('v')})) AS term FROM r)
 SELECT c_custkey, min(key) AS region FROM t JOIN x ON term <> '' AND (term = a OR term = b) GROUP BY c_custkey HAVING count(DISTINCT key) = 1"""
)
def j23_team_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    teams = table(spark, sf_dir, "customer").select(k.alias("id"), pick(CLUBS, k).alias("name"), F.array(pick(CITIES, k)).alias("aliases"))
    return linking.team_regions(teams, regions(spark)[0]).select(F.col("team").alias("c_custkey"), "region")


@query(NEWS + f" SELECT doc_id, contains(' ' || {norm_sql('title')} || ' ', ' malmo ff ') OR contains(' ' || {norm_sql('title')} || ' ', ' kalmar ') AS local, doc_id % 5 <> 0 OR doc_id % 4 = 1 OR (doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0)) OR doc_id % 11 = 0 AS eligible FROM news")
def x24_p15_local_and_regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    local = linking.local_match(X.normalize(F.col("title")), F.array(F.lit("Malmö FF"), F.lit("kalmar"), F.lit(" ")))
    policy = F.struct(F.when(k % 5 == 0, "regional").otherwise("global").alias("scope"), (k % 4).alias("region"), (k % 2 == 0).alias("favorite_eligible"), F.array((k % 3).cast("string")).alias("entity_ids"), F.array((k % 7).cast("string")).alias("tokens"))
    eligible = linking.regional_eligible(policy, F.lit(1), F.array(F.lit("0")), F.array(F.lit("0")), k % 11 == 0)
    return news(spark, sf_dir).select("doc_id", local.alias("local"), eligible.alias("eligible"))


@query(
    """WITH t AS (SELECT r_regionkey AS k, array_to_string(list(n_name ORDER BY n_name), ' ') AS teams FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), p AS (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS players FROM customer GROUP BY 1)
 SELECT 'l' || k AS id, teams, 0::BIGINT AS players FROM t UNION ALL SELECT 't' || k, '', players FROM p"""
)
def j31_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    teams = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("team").alias("type"), none.alias("team_id"), F.concat(F.lit("l"), "n_regionkey").alias("league_id"))
    players = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.lit("player").alias("type"), F.concat(F.lit("t"), "c_nationkey").alias("team_id"), none.alias("league_id"))
    return linking.adjacency(teams.unionByName(players)).select("id", F.array_join("teams", " ").alias("teams"), F.size("players").cast("long").alias("players"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'r' || (n_nationkey % 5) ELSE 'old' END AS league_id FROM nation")
def j30_assign_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    leagues = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    lists = n.where("n_nationkey % 3 = 0").join(table(spark, sf_dir, "region"), F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(F.lower("r_name").alias("league"), F.col("n_name").alias("team"))
    teams = n.select("n_nationkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("league_id"))
    return linking.assign_leagues(teams, lists, leagues).select("n_nationkey", "league_id")


@query("SELECT user_id AS device, array_to_string(list(DISTINCT event_type ORDER BY event_type), ' ') AS ids, array_to_string(list(DISTINCT upper(event_type) ORDER BY upper(event_type)) FILTER (event_type <> 'error'), ' ') AS names FROM events GROUP BY 1")
def a09_follower_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = e.where("event_type <> 'error'").select(F.col("event_type").alias("id")).distinct().withColumn("name", F.upper("id"))
    found = linking.follower_lists(e.select(F.col("user_id").alias("device"), F.col("event_type").alias("entity_id")), known)
    return found.select("device", F.array_join("entity_ids", " ").alias("ids"), F.array_join("names", " ").alias("names"))


@query(
    """WITH x AS (SELECT DISTINCT user_id, event_id % 9 AS e FROM events WHERE event_type = 'signup' AND event_id % 9 < 2), n AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1), a AS (SELECT user_id, event_id, event_id % 9 AS e FROM events WHERE event_type = 'click'),
 f AS (SELECT user_id, e, min(event_id) AS first FROM a WHERE (user_id, e) NOT IN (SELECT (user_id, e) FROM x) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f)
 SELECT a.event_id, o.place IS NULL OR o.place + coalesce(n.n, 0) <= 5 AS accepted FROM a LEFT JOIN o ON o.user_id = a.user_id AND o.e = a.e LEFT JOIN n ON n.user_id = a.user_id"""
)
def p30_a06_accept_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.lit("football").alias("sport"), (F.col("event_id") % 9).alias("entity_id"), F.col("event_id").alias("ordinal"), "event_type")
    there = e.where("event_type = 'signup' AND entity_id < 2").drop("ordinal", "event_type")
    return linking.accept_favorites(there, e.where("event_type = 'click'").drop("event_type")).select(F.col("ordinal").alias("event_id"), "accepted")


@query("SELECT o_orderkey AS id, o_totalprice AS score, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, '-') AS status, coalesce(o_orderkey % 4 <> 0, FALSE) AS favorite_match FROM orders")
def j11_j34_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ranked = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    accepted = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(-1.0).alias("score"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("favorite_match"))
    return linking.with_defaults(ranked, accepted, {"status": "-", "favorite_match": False})


# Feed documents --------------------------------------------------------------------------------------------------------


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of one item for each article: RSS by turns with Atom, with marks, references, categories and dates of all kinds."""
    k, at = F.col("doc_id"), F.col("published_at")
    title = F.concat(F.lit("<title><![CDATA["), F.replace("title", F.lit("å"), F.lit("&#229;")), F.lit("  &amp; <b>more</b>]]></title>"))
    rss = F.concat(
        F.lit("<rss><channel><title>c</title><item>"), title, F.lit("<link>https://a.se/"), k.cast("string"), F.lit("?a=1&amp;b=2</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"),
        F.lit("<category>SHL</category><category><![CDATA[shl]]></category><dc:subject>Mål</dc:subject><description>One &lt;i&gt;two</description><content:encoded>Three</content:encoded><source url='x'>Paper</source></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed><entry>"), title, F.lit('<link rel="self" href="https://a.se/self"/><link rel="alternate" href="https://a.se/'), k.cast("string"), F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('+02:00</updated><category term="NHL" label="nhl"/><summary>Four</summary><author><name>Writer</name><email>w@a.se</email></author></entry><entry><title></title></entry></feed>'),
    )
    return news(spark, sf_dir).select(k.cast("string").alias("feed"), F.when(k % 2 == 0, rss).otherwise(atom).alias("content"))


@query(
    NEWS + """ SELECT doc_id::VARCHAR AS feed, trim(title || ' & more') AS title, 'https://a.se/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '?a=1&b=2' ELSE '' END AS url, published_at - to_hours(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END) AS published_at,
 CASE WHEN doc_id % 2 = 0 THEN 'Paper' ELSE 'Writer' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'SHL,Mål' ELSE 'NHL' END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'One <i>two Three' ELSE 'Four' END AS summary FROM news"""
)
def s01_s05_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.feed_items(feed_documents(spark, sf_dir))
    return found.select("feed", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "source", F.array_join("tags", ",").alias("tags"), "summary")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-01-02 10:00:00' + to_minutes(c_custkey % 50) WHEN 1 THEN TIMESTAMP '2024-02-01 12:00:00' + to_days((c_custkey % 20)::INT) END AS at FROM customer")
def s08_listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    minutes = F.lpad((k % 50).cast("string"), 2, "0")
    html = F.when(k % 3 == 0, F.concat(F.lit('<time datetime="2024-01-02T10:'), minutes, F.lit(':00Z">x</time>'))).when(k % 3 == 1, F.concat(F.lit("<p>on "), F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (k % 20).cast("int")), "yyyy-MM-dd"), F.lit(" at</p>"))).otherwise("<p>no date</p>")
    return table(spark, sf_dir, "customer").select("c_custkey", feeds.listing_date(html).cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey AS k, max(o_totalprice) AS v FROM orders GROUP BY ALL HAVING o_orderkey % 3 <> 0")
def s15_merge_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    source = o.withColumn("ordinal", F.lit(1)).unionByName(o.select("k", F.lit(-1.0).alias("v"), F.lit(2).alias("ordinal")))
    return relational.merge_insert_ignore(o.where("k % 3 = 0"), source, ["k"], "ordinal").select("k", "v")


CATALOG = f"""SELECT 'player' AS type, sport, name, aliases, abroad FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'football' ELSE 'hockey' END AS sport, c_mktsegment || ' ' || c_name AS name, [c_mktsegment || ' ' || c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Åke ' || c_custkey END] AS aliases,
  NOT (c_custkey % 2 = 0 AND c_nationkey % 3 < 2) AS abroad FROM customer)
 UNION ALL SELECT 'staff', CASE WHEN s_suppkey % 2 = 0 THEN 'football' ELSE 'hockey' END, s_name, [s_name, s_name, 'Tränare ' || s_suppkey], TRUE FROM supplier WHERE s_suppkey % 4 > 0
 UNION ALL SELECT 'league', CASE WHEN r_regionkey % 2 = 0 THEN 'football' ELSE 'hockey' END, r_name, [r_name], FALSE FROM region WHERE r_regionkey % 2 = 0
 UNION ALL SELECT 'team', CASE WHEN n_nationkey % 2 = 0 THEN 'football' ELSE 'hockey' END, n_name, [n_name], FALSE FROM nation WHERE n_regionkey % 2 = 0"""
ALIAS = norm_sql("x")


@query(
    f"""SELECT 'catalog-' || sport || '-' || type || '-' || replace({norm_sql("name")}, ' ', '-') AS entity_id, sport, type, name, abroad AS is_abroad_core,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(aliases, lambda x: x IS NOT NULL), lambda x: {ALIAS}), lambda x: x <> ''))), '|') AS aliases,
 CASE type WHEN 'player' THEN 0.96 WHEN 'staff' THEN 0.97 WHEN 'league' THEN 0.94 ELSE 0.93 END::DOUBLE AS confidence FROM ({CATALOG})"""
)
def u10_core_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    sport = lambda k: F.when(F.col(k) % 2 == 0, "football").otherwise("hockey").alias("sport")
    country = lambda k: F.when(F.col(k) % 2 == 0, "Sverige").otherwise("Norge").alias("country")
    k, league = F.col("c_custkey"), F.element_at(F.array(F.lit("Allsvenskan"), F.lit("Superettan"), F.lit("Serie A")), F.col("c_nationkey") % 3 + 1)
    players = table(spark, sf_dir, "customer").select(sport("c_custkey"), F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"), F.when(k % 3 == 0, F.concat(F.lit("Åke "), k.cast("string"))).alias("nickname"), league.alias("league"))
    s = F.col("s_suppkey")
    staff = table(spark, sf_dir, "supplier").select(sport("s_suppkey"), F.col("s_name").alias("name"), F.array("s_name", F.concat(F.lit("Tränare "), s.cast("string"))).alias("aliases"), (s % 4 > 0).alias("active"))
    leagues = table(spark, sf_dir, "region").select(sport("r_regionkey"), F.col("r_name").alias("name"), country("r_regionkey"))
    teams = table(spark, sf_dir, "nation").select(sport("n_nationkey"), F.col("n_name").alias("name"), country("n_regionkey"))
    out = linking.core_catalog(players, staff, leagues, teams)
    return out.select("entity_id", "sport", "type", "name", "is_abroad_core", F.array_join(F.sort_array("aliases"), "|").alias("aliases"), "confidence")
