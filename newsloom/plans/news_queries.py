"""Registered queries of the news rules: scope, sport, editorial and linking, each with DuckDB SQL.

The articles are `documents` with a headline put before them that the rules have something to say about; `customer`,
`nation` and `region` stand for entities and their hierarchy, `events` for the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import classify
from newsloom.functions import editorial as E
from newsloom.functions import policy as P
from newsloom.functions import text as X
from newsloom.functions.scoring import evaluated
from newsloom.operators import linking, rank, relational, search, stories
from newsloom.plans.registry import norm_sql, query, table

HEADLINES = [
    "Allsvenskan: AIK vinner derbyt", "Damallsvenskan startar i kväll", "Golf: Masters avgörs", "NHL: Nylander gör mål i overtime", "Here we go: Isak klar för Liverpool",
    "Tränaren får sparken efter förlusten", "Rött kort och matchstraff", "Starting XI and team news", "Rehab och skada för mittfältaren", "Just nu: sändning pågår",
    "Analys: fem punkter", "Nova Selin klar för AIK fotboll", "Damian Andersson nätar igen", "U17-damer möter Norge", "Women's Super League report", "Premier League: Arsenal draw",
    "fotboll och hockey på samma dag", "puck, puck och powerplay, ingen fotboll", "Lincoln City sign a striker", "The Imps casino bonus", "SC Heerenveen wint", "Innebandy-VM i fokus",
    "Hockeyallsvenskan: Modo leder", "Tre Kronor samlas", "Veckans mål: topp 10", "Succéstarten för Malmö FF", "Formel 1: tävling", "Serie A och la liga", "Kalmar HC lämnar serien",
    "Ny tränare tar över", "Live: avspark klockan sju", "Uppgifter: skrällvärvning", "J20-laget vidare", "Handboll: segern", "A quiet day", "",
]
SOURCES = ["The Stacey West", "FeanOnline", "HockeyNews", "Fotbollskanalen", "Kalmar FF", "Local Post"]
URLS = ["https://a.se/fotboll/lincoln-city-win", "https://a.se/hockey/nhl-x", "https://a.se/news/heerenveen-2", "https://a.se/shl/", "https://a.se", "https://a.se/sport/academy-u19"]
NAMES = ["William Nylander", "AIK", "Premier League", "Arsenal", "Hockeyallsvenskan", "Alexander Isak", "Modo Hockey", "Coach"]
TYPES = ["player", "team", "league", "team", "league", "player", "team", "staff"]


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))


def pick_sql(values: list[str], k: str) -> str:
    return f"{quoted(values)}[({k}) % {len(values)} + 1]"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, summary (the whole text), url, source, tags, sport, published_at."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick(HEADLINES, k).alias("title"), F.col("text").alias("summary"), pick(URLS, k).alias("url"), pick(SOURCES, F.floor(k / 7)).alias("source"),
        F.when(k % 3 == 0, F.array(pick(HEADLINES, k * 5 + 1), F.lit("sport"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(k % 2 == 0, "football").otherwise("hockey").alias("sport"), F.timestamp_micros(F.lit(1704067200000000) + F.pmod(k * 7919, F.lit(10080)) * 60000000).alias("published_at"),
    )


NEWS = f"""WITH news AS (SELECT doc_id, {pick_sql(HEADLINES, 'doc_id')} AS title, text AS summary, {pick_sql(URLS, 'doc_id')} AS url, {pick_sql(SOURCES, 'doc_id // 7')} AS source,
 CASE WHEN doc_id % 3 = 0 THEN [{pick_sql(HEADLINES, 'doc_id * 5 + 1')}, 'sport'] ELSE [] END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'football' ELSE 'hockey' END AS sport,
 TIMESTAMP '2024-01-01' + to_minutes(((doc_id * 7919) % 10080)::BIGINT) AS published_at FROM documents)"""


def has_sql(c: str, terms: list[str]) -> str:
    """One of the terms stands anywhere in a text."""
    return f"len(list_filter({quoted(terms)}, lambda t: contains({c}, t))) > 0"


def term_sql(c: str, terms: list[str]) -> str:
    """One word as a whole word, several as a substring, of a normalised text."""
    named = sorted({P.plain(t) for t in terms})
    one, more = [t for t in named if " " not in t], [t for t in named if " " in t]
    found = f"list_has_any(string_split({c}, ' '), {quoted(one)})"
    return f"({found} OR {has_sql(c, more)})" if more else f"({found})"


def re_sql(c: str, pattern: str) -> str:
    return "regexp_matches(" + c + ", '" + pattern.replace("'", "''") + "')"


def scope_sql(kept: str) -> str:
    return f"({has_sql(kept, [t.lower() for t in P.OTHER_SCOPE])} OR {re_sql(kept, P.OTHER_SCOPE_WORDS)} OR ({re_sql(kept, P.VERIFIED_CONTEXT)} AND regexp_matches(kept, '(^|[^a-z0-9])nova[ -]+selin($|[^a-z0-9])')))".replace("(kept, '(^", f"({kept}, '(^")


KEEP = "''-"
ALL_TEXT = "array_to_string(list_filter([title, url, summary] || tags || [source, sport], lambda x: x IS NOT NULL AND x <> ''), ' ')"


# Ingest and read policies ----------------------------------------------------------------------------------------------


@query(
    NEWS + f""", n AS (SELECT doc_id, {norm_sql(ALL_TEXT, KEEP)} AS kept, {norm_sql("title || ' ' || coalesce(summary, '')", KEEP)} AS said FROM news)
 SELECT doc_id, {scope_sql('kept')} AS other_scope, {scope_sql('said')} OR {has_sql('said', [P.plain(t, "'-") for t in P.OTHER_SPORTS])} AS irrelevant FROM n"""
)
def p03_p05_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    scope = ~P.in_scope(c("title"), c("url"), c("summary"), c("tags"), c("source"), c("sport"))
    return news(spark, sf_dir).select("doc_id", scope.alias("other_scope"), P.irrelevant(F.concat("title", F.lit(" "), X.text(c("summary")))).alias("irrelevant"))


@query(
    NEWS + rf""", n AS (SELECT doc_id, source, {norm_sql('title', KEEP)} AS t, {norm_sql("array_to_string(tags, ' ')", KEEP)} AS g, {norm_sql("CASE regexp_replace(url, '^https://[^/]*', '') WHEN '' THEN '/' ELSE regexp_replace(url, '^https://[^/]*', '') END", KEEP)} AS p FROM news),
 a AS (SELECT *, t || ' ' || '' || ' ' || g || ' ' || p AS everything, t || ' ' || replace(p, '-', ' ') AS identity FROM n)
 SELECT doc_id, CASE WHEN source NOT IN ('The Stacey West', 'FeanOnline') THEN TRUE
  WHEN {scope_sql('everything')} OR {re_sql('everything', P.CLUB_MIXED)} OR {re_sql('everything', P.CLUB_COMMERCIAL)} THEN FALSE
  WHEN source = 'The Stacey West' THEN {re_sql('identity', P.CLUB_SOURCES['The Stacey West'])} ELSE {re_sql('identity', P.CLUB_SOURCES['FeanOnline'])} END AS eligible FROM a"""
)
def p06_club_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return news(spark, sf_dir).select("doc_id", P.club_eligible(c("source"), c("title"), c("url"), F.lit(None).cast("string"), c("tags")).alias("eligible"))


def counts_sql(sport: str) -> str:
    """How many of the listed terms, written twice or not, a text has."""
    terms = [P.plain(t) for t in P.DIRECT_SIGNALS[sport]]
    return "(" + " + ".join(f"(contains(' ' || said || ' ', ' {t} '))::INT" if " " not in t else f"(contains(said, '{t}'))::INT" for t in terms) + ")"


SPORT = NEWS + f""", s AS (SELECT *, {norm_sql("title || ' ' || coalesce(summary, '') || ' ' || array_to_string(tags, ' ') || ' '")} AS said FROM news),
 f AS (SELECT *, said <> '' AND NOT {term_sql('said', P.EXCLUDED_SPORTS)} AND {term_sql('said', P.CONTENT_SIGNALS)} AS content, {counts_sql('football')} AS fn, {counts_sql('hockey')} AS hn FROM s),
 d AS (SELECT *, CASE WHEN said = '' OR {term_sql('said', P.EXCLUDED_SPORTS)} THEN NULL WHEN {term_sql('said', [t for x in P.LEAGUES['football'].values() for t in x])} THEN 'football'
  WHEN {term_sql('said', [t for x in P.LEAGUES['hockey'].values() for t in x])} THEN 'hockey' WHEN fn > 0 AND hn = 0 THEN 'football' WHEN hn > 0 AND fn = 0 THEN 'hockey'
  WHEN fn >= 2 AND fn > hn THEN 'football' WHEN hn >= 2 AND hn > fn THEN 'hockey' END AS detected FROM f)"""
LEAGUE = "CASE " + " ".join(
    f"WHEN sport {'=' if s == 'hockey' else '<>'} 'hockey' AND {term_sql('said', terms)} THEN '{name}'" for s in ("hockey", "football") for name, terms in P.LEAGUES[s].items()
) + " END"


def said(rows: DataFrame) -> DataFrame:
    """With the verification text, whether it has sport content, and its sport, each worked out once."""
    out = evaluated(rows, {"said": P.verification_text(F.col("title"), F.col("summary"), F.col("tags"))})
    return evaluated(out, {"content": P.has_sport_content(F.col("said")), "detected": P.sport_of(F.col("said"))})


@query(SPORT + f" SELECT doc_id, content, detected, {LEAGUE} AS league FROM d")
def p08_p10_sport_and_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(news(spark, sf_dir)).select("doc_id", "content", "detected", P.league_of(F.col("said"), F.col("sport")).alias("league"))


@query(
    SPORT + """ SELECT doc_id, NOT (doc_id % 4 = 0) OR content AS verified, CASE WHEN detected <> sport THEN 'blocked' WHEN detected IS NOT NULL OR content OR doc_id % 5 = 0 THEN 'ok' ELSE 'blocked' END AS status,
 CASE WHEN detected <> sport THEN 'sport_mismatch' WHEN detected IS NOT NULL OR content OR doc_id % 5 = 0 THEN NULL ELSE 'no_sport_signal' END AS reason FROM d"""
)
def p11_p12_sport_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, k = F.col("content"), F.col("doc_id")
    done = P.sport_resolution(F.col("detected"), content, F.col("sport"), k % 5 == 0)
    return said(news(spark, sf_dir)).select("doc_id", P.source_verified(k % 4 == 0, content).alias("verified"), done.alias("r")).select("doc_id", "verified", "r.status", "r.reason")


def guard_sql(sport: str) -> str:
    named = lambda s: f"({has_sql('lower(trim(source))', P.SOURCE_TERMS[s])} OR {has_sql('lower(trim(url))', P.URL_TERMS[s])})"
    return f"(NOT {named(P.OTHER[sport])} AND CASE WHEN content THEN detected IS NULL OR detected = '{sport}' ELSE doc_id % 5 = 0 AND {named(sport)} END)"


@query(SPORT + f" SELECT doc_id, CASE WHEN sport = 'football' THEN {guard_sql('football')} ELSE {guard_sql('hockey')} END AS consistent FROM d")
def p13_sport_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, trusted = F.col, F.col("doc_id") % 5 == 0
    kept = {s: P.sport_consistent(c("content"), c("detected"), c("source"), c("url"), s, trusted) for s in ("football", "hockey")}
    return said(news(spark, sf_dir)).select("doc_id", F.when(c("sport") == "football", kept["football"]).otherwise(kept["hockey"]).alias("consistent"))


@query(
    NEWS + f""", h AS (SELECT doc_id, array_to_string(list_filter([title, url, summary, source, 'Feed'] || tags, lambda x: x IS NOT NULL AND x <> ''), ' ') AS said, {pick_sql(NAMES, 'doc_id')} AS name, {pick_sql(TYPES, 'doc_id')} AS kind FROM news)
 SELECT doc_id, md5(said) AS said, CASE WHEN kind = 'player' THEN 100 WHEN kind IN ('team', 'league') AND {has_sql('lower(name)', P.DOMESTIC)} OR {has_sql('lower(said)', P.DOMESTIC)} THEN 80 WHEN kind IN ('team', 'league') THEN 50 ELSE 0 END AS priority FROM h"""
)
def x25_x28_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("doc_id")
    rows = news(spark, sf_dir).select("doc_id", P.detection_text(c("title"), c("url"), c("summary"), c("source"), F.lit("Feed"), c("tags")).alias("said"))
    hits = F.array(F.struct(pick(TYPES, k).alias("type"), pick(NAMES, k).alias("name")))
    return rows.select("doc_id", F.md5("said").alias("said"), P.ingest_priority(c("said"), hits).alias("priority"))


# Editorial assessments -------------------------------------------------------------------------------------------------

CUE = E.CANDIDATE_WORDS
CANDIDATE_SQL = "regexp_matches({0}, '(?i)(^|[^\\p{{L}}\\p{{N}}])(" + CUE.replace("{L}", "{{L}}") + ")($|[^\\p{{L}}\\p{{N}}])')"


@query(NEWS + " SELECT doc_id, " + CANDIDATE_SQL.format("title || ' ' || coalesce(summary, '') || ' ' || array_to_string(tags, ' ')") + " AS candidate FROM news")
def p18_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("doc_id", E.candidate(F.col("title"), F.col("summary"), F.col("tags")).alias("candidate"))


def assessed(rows: DataFrame) -> DataFrame:
    """With an assessment of each kind by turns, some for another title, version or without evidence."""
    k = F.col("doc_id")
    a = F.struct(
        F.when(k % 11 == 0, 2).otherwise(1).alias("version"), F.when(k % 13 == 0, "other").otherwise(F.col("title")).alias("title"), pick([*E.CATEGORIES, "odd"], k).alias("category"),
        pick(E.STATUSES, F.floor(k / 3)).alias("status"), F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(pick(E.BADGES, F.floor(k / 2))).alias("badge"), (k % 6 == 0).alias("breaking"),
        F.when(k % 17 == 0, " ").otherwise("evidence").alias("evidence"), F.lit("2024-01-01 00:00:00").alias("assessed_at"), F.lit("m").alias("model"),
    )
    made = evaluated(rows, {"a": F.when(k % 7 != 0, a)})
    return evaluated(made, {"a": F.when(E.valid(F.col("a"), F.col("title")), F.col("a"))})


def in_sql(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


ASSESSED = NEWS + rf""", b AS (SELECT *, {pick_sql([*E.CATEGORIES, 'odd'], 'doc_id')} AS category, {pick_sql(E.STATUSES, 'doc_id // 3')} AS status, CASE WHEN doc_id % 4 <> 0 THEN {pick_sql(E.BADGES, 'doc_id // 2')} END AS badge, doc_id % 6 = 0 AS breaking,
 doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 13 <> 0 OR title = 'other') AND {pick_sql([*E.CATEGORIES, 'odd'], 'doc_id')} <> 'odd' AND doc_id % 17 <> 0 AS ok FROM news),
 e AS (SELECT *, NOT regexp_matches(lower(title), '\b({E.LOOKING_BACK_WORDS})\b') AS live_success FROM b),
 p AS (SELECT *, ok AND ((status = 'reported' AND badge IS NOT DISTINCT FROM 'HERE_WE_GO' AND category = 'transfer') OR (status = 'confirmed' AND (breaking OR category IN ({in_sql(E.PRIORITY_CATEGORIES)}) OR (category = 'success' AND live_success)))) AS priority FROM e)"""
LABEL = "CASE WHEN NOT ok OR badge IS NULL THEN NULL WHEN badge = 'HERE_WE_GO' THEN CASE WHEN status IN ('confirmed', 'reported') AND category = 'transfer' THEN '{}' END WHEN status <> 'confirmed' OR (category = 'success' AND NOT live_success) THEN NULL {} END".format(
    E.REPORTED_LABEL,
    " ".join(f"WHEN badge = '{b}' AND category IN ({', '.join(repr(c) for c in cats)}){' AND breaking' if b == 'BREAKING' else ''} THEN '{label}'" for b, (label, _, cats) in E.BADGE_RULES.items()),
)


@query(
    ASSESSED + f""" SELECT doc_id, ok, priority, priority AND status = 'confirmed' AND (breaking OR category IN ({in_sql(E.VIP_CATEGORIES)}) OR (category = 'success' AND live_success)) AS vip,
 CASE WHEN priority THEN 12 ELSE 0 END AS urgency, {LABEL} AS label FROM p"""
)
def p19_p20_x35_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = F.col("a"), F.col("title")
    return assessed(news(spark, sf_dir)).select("doc_id", a.isNotNull().alias("ok"), E.priority(a, t).alias("priority"), E.vip(a, t).alias("vip"), E.urgency(a, t).alias("urgency"), E.badge(a, t)["label"].alias("label"))


@query(
    ASSESSED + f""", n AS (SELECT *, {norm_sql("title || ' ' || array_to_string(tags, ' ')")} AS said, {norm_sql('title')} AS plain, {CANDIDATE_SQL.format("title || '  ' || array_to_string(tags, ' ')")} AS open FROM p),
 v AS (SELECT *, CASE WHEN ok THEN CASE WHEN status IN ('denied', 'unclear') OR category = 'other' THEN NULL WHEN category IN ('departure', 'contract') THEN 'transfer' ELSE category END WHEN open THEN NULL """
    + " ".join(f"WHEN {re_sql('said', p)} THEN '{name}'" for name, p in E.EVENT_CATEGORIES)
    + """ END AS category_ FROM n) SELECT doc_id, category_ AS category, CASE WHEN ok AND category_ = 'match-event' THEN 'goal' WHEN ok THEN category_ WHEN open THEN NULL """
    + " ".join(f"WHEN {re_sql('plain', p)} THEN '{name}'" for name, p in [*classify.CANONICAL_EVENTS, *classify.TITLE_EVENTS])
    + " END AS event FROM v"
)
def x19_x21_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t, g = F.col("a"), F.col("title"), F.col("tags")
    return assessed(news(spark, sf_dir)).select("doc_id", E.event_category(a, t, g).alias("category"), E.canonical_event(a, t, g).alias("event"))


def answers() -> Column:
    """Model answers as JSON, some with a key too many, an unknown value or evidence that isn't there."""
    k = F.col("doc_id")
    text = F.concat(
        F.lit('{"category": "'), pick([*E.CATEGORIES, "odd"], k), F.lit('", "status": "'), pick(E.STATUSES, k), F.lit('", "badge": '), F.when(k % 4 == 0, "null").otherwise('"LIVE"'),
        F.lit(', "breaking": '), F.when(k % 5 == 0, '"yes"').otherwise("false"), F.lit(', "evidence": "'), F.when(k % 3 == 0, "nowhere at all").otherwise(F.substring("title", 1, 9)), F.lit('"'),
        F.when(k % 8 == 0, ', "more": 1').otherwise(""), F.lit("}"),
    )
    return F.when(k % 19 != 0, text).otherwise("no json")


@query(
    NEWS + f""" SELECT doc_id, CASE WHEN doc_id % 19 <> 0 AND doc_id % 8 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND {pick_sql([*E.CATEGORIES, 'odd'], 'doc_id')} <> 'odd' AND length(trim(substring(title, 1, 9))) >= 4
  THEN {pick_sql(E.CATEGORIES + ['odd'], 'doc_id')} || ':' || {pick_sql(E.STATUSES, 'doc_id')} || ':' || coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'LIVE' END, '-') END AS result FROM news"""
)
def p21_model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.model_result(answers(), F.col("title"), F.lit(""))
    return news(spark, sf_dir).select("doc_id", F.when(r.isNotNull(), F.concat_ws(":", r["category"], r["status"], F.coalesce(r["badge"], F.lit("-")))).alias("result"))


@query(
    NEWS + """ SELECT doc_id, doc_id % 3 = 0 AND length(title) >= 4 AND (doc_id % 10) / 8.0 <= 1 AS valid, doc_id % 3 = 0 AND length(title) >= 4 AND (doc_id % 10) / 8.0 BETWEEN 0.9 AND 1 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS confirmed FROM news"""
)
def p22_story_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, shown = F.col("doc_id"), F.substring("title", 1, 12)
    answer = F.concat(
        F.lit('{"same_event": '), (k % 4 != 0).cast("string"), F.lit(', "material_update": '), (k % 5 == 0).cast("string"), F.lit(', "confidence": '), ((k % 10) / 8.0).cast("string"),
        F.lit(', "evidence_a": "'), F.when(k % 3 == 0, shown).otherwise("not in a title"), F.lit('", "evidence_b": "'), shown, F.lit('"}'),
    )
    v = E.story_verdict(answer, F.col("title"), F.col("title"))
    return news(spark, sf_dir).select("doc_id", v.isNotNull().alias("valid"), F.coalesce(v["confirmed"], F.lit(False)).alias("confirmed"))
