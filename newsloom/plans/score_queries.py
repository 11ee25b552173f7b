"""The registered query of all score components over articles with entities, assessments and favourites, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import editorial as E
from newsloom.functions import scoring as S
from newsloom.operators import dedupe, rank
from newsloom.plans.news_queries import NAMES, NEWS, TYPES, news, pick, pick_sql
from newsloom.plans.registry import fold_sql, now, query

OUTLETS = ["Aftonbladet", "The Hockey Writers", "BBC Sport", "Local Post", "Fan site", "HockeyNews"]
FAVORITES = [
    {"entity_id": "e0", "sport": "football", "type": "player", "label": "William Nylander"}, {"entity_id": "none", "sport": "football", "type": "team", "label": "arsenal"},
    {"entity_id": "e2", "sport": "football", "type": "league", "label": "Premier League"},
]


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    hit = lambda i, swedish, abroad: F.struct(F.concat(F.lit("e"), F.pmod(k + i, F.lit(8)).cast("string")).alias("entity_id"), F.col("sport").alias("sport"), pick(TYPES, k + i).alias("type"), pick(NAMES, k + i).alias("name"), swedish.alias("is_swedish"), abroad.alias("is_abroad_core"))
    hits = F.array(hit(0, k % 2 == 0, k % 3 == 0), hit(3, k % 5 == 0, F.lit(False)))
    a = F.struct(pick(E.CATEGORIES, k).alias("category"), pick(E.STATUSES, F.floor(k / 3)).alias("status"), (k % 9 == 0).alias("breaking"))
    title = F.when(k % 50 == 1, "Today in hockey history: NHL").when(k % 40 == 2, "Top 10 ranking, guide and analysis").otherwise(F.col("title"))
    return news(spark, sf_dir).withColumns({
        "title": title, "source": pick(OUTLETS, k), "priority": F.pmod(k, F.lit(100)).cast("int"), "entity_hits": F.when(k % 4 == 0, F.slice(hits, 1, 0)).otherwise(hits), "editorial": F.when(k % 3 == 0, a),
        "local_score": F.lit(0.0), "duplicate_count": F.pmod(k, F.lit(6)), "event_intensity": F.pmod(k, F.lit(3)),
    })


def word(c: str, words: list[str]) -> str:
    return "regexp_matches(" + c + r", '\b(" + "|".join(w.replace(".", r"\.") for w in words) + r")\b')"


def kept(c: str) -> str:
    return f"trim(lower({fold_sql(c)}))"


def step(value: str, bounds: list[tuple[float, int]], otherwise: int = 0, op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN {w}" for b, w in bounds) + f" ELSE {otherwise} END"


def one(condition: str, weight: float) -> str:
    return f"CASE WHEN {condition} THEN {weight} ELSE 0 END"


def total_of(expression: str) -> str:
    """Of the hits."""
    return f"coalesce(list_sum(list_transform(hits, lambda h: {expression})), 0)"


def any_hit(condition: str) -> str:
    return f"len(list_filter(hits, lambda h: {condition})) > 0"


def hit_sql(i: int, swedish: str, abroad: str) -> str:
    return "{" + f"'id': 'e' || ((doc_id + {i}) % 8), 'type': {pick_sql(TYPES, f'doc_id + {i}')}, 'name': {pick_sql(NAMES, f'doc_id + {i}')}, 'swedish': {swedish}, 'abroad': {abroad}" + "}"


LEAGUE_HIT = "h.type = 'league' AND {}"
FIT = f"(CASE WHEN football THEN {one(word('tt', S.FOOTBALL_LEAGUES), 5)} + {one(word('st', S.FOOTBALL_FIT_SOURCES), 3)} ELSE {one(word('tt', S.HOCKEY_LEAGUES), 5)} + {one(word('st', S.HOCKEY_FIT_SOURCES), 3)} END)"
GUESS = f"CASE WHEN {word('st', S.SOURCES_HIGH)} THEN 10 WHEN {word('st', S.SOURCES_STRONG)} THEN 7 WHEN {word('st', S.SOURCES_LOW)} THEN -2 ELSE 0 END"
OWN = "CASE WHEN h.type = 'player' THEN 10 WHEN h.type IN ('coach', 'staff') THEN 8 WHEN h.type = 'team' THEN 6 ELSE 5 END"
FOOTBALL_WORDS, HOCKEY_WORDS = ["allsvenskan", "superettan", "svensk", "svenska", "sverige"], ["svensk", "svenska", "sverige", "tre kronor", "shl", "hockeyallsvenskan"]

SCORES = NEWS + f""", a AS (SELECT doc_id, sport, sport = 'football' AS football, published_at, CASE WHEN doc_id % 50 = 1 THEN 'Today in hockey history: NHL' WHEN doc_id % 40 = 2 THEN 'Top 10 ranking, guide and analysis' ELSE title END AS title, tags,
  {pick_sql(OUTLETS, 'doc_id')} AS source, doc_id % 100 AS priority, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [{hit_sql(0, 'doc_id % 2 = 0', 'doc_id % 3 = 0')}, {hit_sql(3, 'doc_id % 5 = 0', 'FALSE')}] END AS hits,
  {pick_sql(E.CATEGORIES, 'doc_id')} AS category, doc_id % 3 = 0 AND (doc_id % 9 = 0 OR {pick_sql(E.STATUSES, 'doc_id // 3')} = 'confirmed') AS allowed, doc_id % 9 = 0 AS breaking, greatest(0, (epoch_us(TIMESTAMP '2024-01-08') - epoch_us(published_at)) / 3.6e9) AS hours FROM news),
 t AS (SELECT *, {kept("title || ' ' || array_to_string(tags, ' ')")} AS tt, {kept('source')} AS st, {kept("title || ' ' || source || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(list_transform(hits, lambda h: h.name), ' ')")} AS everything, {kept('title')} AS kt FROM a),
 b AS (SELECT *, {step('hours', S.RECENCY_HOURS, op='<=')} AS recency, {one('allowed', 5)} AS urgency, {total_of(one("h.swedish AND h.type = 'player'", 8))} AS swedish_player, {total_of(one('h.abroad', 14))} AS swedish_abroad,
  {total_of(one(LEAGUE_HIT.format(word('h.name', S.SWEDISH_LEAGUES)), 12))} AS swedish_league,
  CASE WHEN football THEN {one(any_hit("h.id = 'e0'"), 18)} + {one(any_hit("h.type = 'team' AND lower(h.name) = 'arsenal'"), 16)} + CASE WHEN {any_hit("h.id = 'e2'")} THEN 14 WHEN {any_hit('h.swedish')} THEN 10 ELSE 0 END ELSE 0 END AS favorite_affinity,
  CASE WHEN allowed THEN {one("category = 'management'", 18)} + {one("category IN ('transfer', 'departure', 'contract')", 18)} + {one("category = 'match-event'", 16)} + {one("breaking OR category IN ('live', 'discipline')", 12)} ELSE 0 END AS big_news,
  {total_of(f"CASE WHEN h.abroad THEN 16 WHEN h.type = 'league' AND {word('lower(h.name)', S.SWEDISH_LEAGUES)} THEN 12 WHEN h.swedish THEN {OWN} ELSE 0 END")} + {step('priority', [(80, 6), (50, 3)])}
  + {one(word('tt', ['allsvenskan', 'superettan', 'svensk fotboll']), 12)} + {one(word('tt', ['shl', 'hockeyallsvenskan']), 12)} + {one(word('tt', ['sverige', 'svensk', 'svenska', 'tre kronor']), 8)} AS core_identity,
  {step('priority', S.PRIORITY_STEPS)} AS priority_score, doc_id % 3 AS intensity, {one(f"NOT football AND {word('kt', ['today in hockey history'])} AND {word('st', ['the hockey writers'])}", 24)} AS daily_feature FROM t),
 c AS (SELECT *, swedish_player + swedish_abroad + swedish_league + core_identity + favorite_affinity + big_news + intensity AS strength,
  {any_hit('h.swedish OR h.abroad')} OR CASE WHEN football THEN {any_hit(LEAGUE_HIT.format(word('h.name', ['allsvenskan', 'superettan'])))} OR {word('everything', FOOTBALL_WORDS)} ELSE {any_hit(LEAGUE_HIT.format(word('h.name', ['shl', 'hockeyallsvenskan', 'tre kronor'])))} OR {word('everything', HOCKEY_WORDS)} END AS swedish,
  NOT football AND daily_feature = 0 AND ({word('everything', S.NHL_TERMS)} OR {any_hit(LEAGUE_HIT.format(word('h.name', ['nhl'])))}) AS nhl, favorite_affinity > 0 OR big_news > 0 AS boosted FROM b),
 m AS (SELECT *, CASE WHEN boosted OR daily_feature > 0 THEN 1.0 WHEN football AND NOT swedish THEN {step('strength', [(28, 0.12), (16, 0.08)], 0.05)} WHEN football THEN {step('strength', [(28, 1.0), (16, 0.6)], 0.3)} WHEN nhl AND NOT swedish THEN {step('strength', [(28, 0.55), (16, 0.35)], 0.15)} ELSE {step('strength', [(28, 1.0), (16, 0.8)], 0.55)} END::DOUBLE AS mult FROM c),
 p AS (SELECT *, floor(({GUESS}) * mult + 0.5) AS source_authority, floor({FIT} * mult + 0.5) AS source_league_fit, floor({one(word('tt', S.COUNTRY_TERMS), 4)} * mult + 0.5) AS source_country_fit,
  CASE WHEN {word('tt', ['today in hockey history'])} THEN 0 ELSE {' + '.join('(' + one(word('tt', words), w) + ')' for w, words in S.EVERGREEN.items())} END AS evergreen_penalty, CASE WHEN big_news > 0 THEN {step('hours', [(48, 8), (24, 4)])} ELSE {step('hours', [(72, 8), (36, 4)])} END AS staleness_penalty,
  least(12, 3 * (doc_id % 6)) AS duplicate_penalty, CASE WHEN football AND NOT boosted AND NOT (strength >= 16 AND swedish) AND NOT {word('everything', FOOTBALL_WORDS)} THEN {step('strength', [(16, 12)], 16)} ELSE 0 END AS foreign_football_penalty,
  CASE WHEN nhl AND NOT boosted AND daily_feature = 0 AND NOT swedish THEN {step('strength', [(24, 8), (16, 12)], 18)} ELSE 0 END AS nhl_penalty,
  CASE WHEN {any_hit("h.type = 'player' AND h.swedish AND NOT h.abroad")} AND NOT ({any_hit("h.type = 'player' AND h.swedish AND h.abroad")}) THEN least(core_identity, 12) ELSE core_identity END AS core_contribution FROM m),
 s AS (SELECT *, (recency + urgency + swedish_player + swedish_abroad + swedish_league + favorite_affinity + source_authority + source_league_fit + source_country_fit + big_news + intensity + priority_score + core_contribution + daily_feature
  - evergreen_penalty - staleness_penalty - duplicate_penalty - foreign_football_penalty - nhl_penalty)::DOUBLE AS score FROM p)"""
COMPONENTS = [
    "recency", "urgency", "swedish_player", "swedish_abroad", "swedish_league", "favorite_affinity", "big_news", "core_identity", "priority_score", "daily_feature", "source_authority",
    "source_league_fit", "source_country_fit", "evergreen_penalty", "staleness_penalty", "foreign_football_penalty", "nhl_penalty", "core_contribution",
]


@query(SCORES + " SELECT doc_id, " + ", ".join(f"({c})::BIGINT AS {c}" for c in COMPONENTS) + ", score FROM s")
def c02_c20_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_articles(scored_news(spark, sf_dir), now(), FAVORITES).select("doc_id", *[F.col(c).cast("long").alias(c) for c in COMPONENTS], "score")


@query(SCORES + " SELECT doc_id, sport, score, row_number() OVER (PARTITION BY sport ORDER BY score DESC, published_at DESC, doc_id) AS position FROM s WHERE score >= CASE WHEN sport = 'football' THEN CASE WHEN allowed THEN -2 ELSE 0 END ELSE CASE WHEN allowed THEN -3 ELSE 2 END END QUALIFY position <= 200")
def f04_p17_k01_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.score_articles(scored_news(spark, sf_dir).withColumn("ordinal", F.col("doc_id")), now(), FAVORITES)
    few = rank.top_k(rank.score_floor(scored, {"football": (0.0, -2.0), "hockey": (2.0, -3.0)}), ["sport"], 200, *rank.score_order())
    return few.select("doc_id", "sport", "score", F.col("position").cast("long").alias("position"))


KINDS = [*dedupe.CATEGORY_WORTH, "other"]
#: The same articles without hits, priority and intensity, as a source's worth sees them.
BARE = SCORES.replace("doc_id % 4 = 0 THEN []", "TRUE THEN []").replace("doc_id % 100 AS priority", "0 AS priority").replace("doc_id % 3 AS intensity", "0 AS intensity")


def worth_sql(worth: dict[str, float]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in worth.items()) + " ELSE 0.0 END"


@query(
    BARE + f""", w AS (SELECT *, {pick_sql(KINDS, 'doc_id // 2')} AS kind, (doc_id % 10)::DOUBLE / 10 AS authority FROM p), q AS (SELECT *, greatest(0.0, authority + {worth_sql(dedupe.CATEGORY_WORTH)}) AS quality FROM w)
 SELECT doc_id, round(quality, 6) AS quality, round(greatest(0.0, quality + source_league_fit * 0.025 + source_country_fit * 0.02 + CASE WHEN doc_id % 5 = doc_id % 3 THEN {worth_sql(dedupe.OWN_ENTITY_WORTH)} ELSE 0.0 END), 6) AS preference FROM q"""
)
def c21_source_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    entity = lambda n: F.array(F.concat(F.lit("e"), F.pmod(k, F.lit(n)).cast("string")))
    items = scored_news(spark, sf_dir).withColumns({"profile_authority": F.pmod(k, F.lit(10)).cast("double") / 10, "profile_category": pick(KINDS, F.floor(k / 2)), "policy_entity_ids": entity(5), "entities": entity(3)})
    return dedupe.with_source_worth(items, now()).select("doc_id", F.round("quality", 6).alias("quality"), F.round("preference", 6).alias("preference"))
