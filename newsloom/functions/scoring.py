"""Score components of an article as Column expressions.

An article row has sport, title, source, tags (array), priority, published_at, entity_hits (array of struct: entity_id,
sport, type, name, is_swedish, is_abroad_core), editorial (struct or null: category, status, breaking), local_score
(double, 0 if not matched), duplicate_count and event_intensity. Every component is a column of its own; `score_articles`
adds all of them and the total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_keep, round_half_up, text

# Score steps, terms and weights of the ranking model.
RECENCY_HOURS = [(1, 18), (3, 14), (6, 11), (12, 8), (24, 5), (48, 2)]
URGENCY_STEPS = [(24, 14), (16, 10), (8, 5)]
PRIORITY_STEPS = [(90, 18), (80, 12), (50, 6)]
SWEDISH_LEAGUES = ["allsvenskan", "superettan", "shl", "hockeyallsvenskan"]
BIG_NEWS = {"management": 18, "transfer": 18, "match": 16, "live": 12}
TRANSFER_CATEGORIES = ["transfer", "departure", "contract"]
LIVE_CATEGORIES = ["live", "discipline"]
EVERGREEN = {
    9: ["archive", "archives", "history of", "historien om", "hockey history", "all-time", "all time", "best ever", "where are they now", "nostalgia", "nostalgic", "throwback", "retro"],
    8: ["prospect profile", "draft profile", "draft review", "mock draft", "top prospect", "prospect", "prospects"],
    7: ["top 10", "top 5", "top 3", "top three", "ranking", "rankings", "ranked", "best player", "best players", "best goalie", "best goalies", "best defensemen", "best forward", "best forwards", "greatest"],
    5: ["commentary", "opinion", "column", "analysis", "analyserar", "kronika", "editorial"],
    4: ["guide", "sa fungerar", "explained", "forklaring", "explainer", "lista"],
}
SOURCES_HIGH = ["aftonbladet", "expressen", "svt sport", "bbc sport", "sky sports", "the athletic", "espn", "nhl", "uefa", "fifa"]
SOURCES_STRONG = ["hockeynews", "fotbollskanalen", "goal", "the hockey writers", "manchester evening news", "liverpool echo", "chroniclelive"]
SOURCES_LOW = ["news now", "newsnow", "fan site", "blogg", "blog"]
CATEGORY_BONUS = {"official_local": 4, "local_media": 3, "public_service_local": 3, "aggregator_team_feed": 1, "fan_community": -2}
LOW_NEWS = ["forum", "podd", "podcast", "opinion", "kronika", "infor", "livechatt", "blogg", "blog"]
FOOTBALL_LEAGUES = ["allsvenskan", "superettan", "premier league", "serie a", "bundesliga", "la liga", "champions league", "europa league"]
FOOTBALL_FIT_SOURCES = ["fotbollskanalen", "goal", "sky sports", "bbc sport"]
HOCKEY_LEAGUES = ["shl", "hockeyallsvenskan", "ahl", "world championship", "tre kronor"]
HOCKEY_FIT_SOURCES = ["hockeynews", "aftonbladet", "expressen", "svt sport"]
COUNTRY_TERMS = ["sverige", "svensk", "svenska", "allsvenskan", "superettan", "shl", "hockeyallsvenskan", "tre kronor"]
LOCAL_TERMS = ["lokalt", "lokal", "nara dig", "din stad", "din region"]
LOCAL_SOURCES = ["vlt", "unt", "hd", "sydsvenskan", "corren", "nt", "vk", "gd", "dt", "dalademokraten"]
NHL_TERMS = ["nhl", "nhl.com", "sportsnet", "tsn", "the hockey writers", "the hockey news"]


def any_word(c: Column, words: list[str]) -> Column:
    """One of the words or phrases stands between word boundaries."""
    escaped = "|".join(w.replace(".", "\\.") for w in words)
    return c.rlike(rf"\b({escaped})\b")


def steps(value: Column, bounds: list[tuple[float, int]], otherwise: int = 0, up_to: bool = False) -> Column:
    """The weight of the first bound that the value reaches (or, if up_to, stays within)."""
    out = F
    for bound, weight in bounds:
        out = out.when(value <= bound if up_to else value >= bound, weight)
    return out.otherwise(otherwise)


def age_hours(now: Column) -> Column:
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / 3.6e9)


def hit_sum(weight) -> Column:  # noqa: ANN001
    """The sum of weight(hit) over the entity hits."""
    hits = F.coalesce(F.col("entity_hits"), F.array().cast("array<struct<entity_id:string,sport:string,type:string,name:string,is_swedish:boolean,is_abroad_core:boolean>>"))
    return F.aggregate(hits, F.lit(0), lambda acc, h: acc + F.coalesce(weight(h), F.lit(0)))


def hit_exists(condition) -> Column:  # noqa: ANN001
    return F.coalesce(F.exists("entity_hits", lambda h: F.coalesce(condition(h), F.lit(False))), F.lit(False))


def article_text() -> Column:
    names = F.array_join(F.transform("entity_hits", lambda h: h["name"]), " ")
    return normalize_keep(F.concat_ws(" ", text(F.col("title")), text(F.col("source")), F.array_join(F.col("tags"), " "), names))


def core_identity() -> Column:
    """Uncapped: entities, ingest priority and words."""
    league = lambda h: (h["type"] == "league") & any_word(normalize_keep(h["name"]), SWEDISH_LEAGUES)
    own = lambda h: F.when(h["type"] == "player", 10).when(h["type"].isin("coach", "staff"), 8).when(h["type"] == "team", 6).otherwise(5)
    entities = hit_sum(lambda h: F.when(h["is_abroad_core"], 16).when(league(h), 12).when(h["is_swedish"], own(h)).otherwise(0))
    words = F.col("title_tags")
    said = (
        F.when(any_word(words, ["allsvenskan", "superettan", "svensk fotboll"]), 12).otherwise(0)
        + F.when(any_word(words, ["shl", "hockeyallsvenskan"]), 12).otherwise(0)
        + F.when(any_word(words, ["sverige", "svensk", "svenska", "tre kronor"]), 8).otherwise(0)
    )
    return entities + steps(F.coalesce("priority", F.lit(0)), [(80, 6), (50, 3)]) + said


def favorite_affinity(favorites: list[dict]) -> Column:
    """Summed over the favourites: an exact entity, a league's Swedish entity, or a team of the same name."""

    def one(f: dict) -> Column:
        exact = hit_exists(lambda h: h["entity_id"] == f["entity_id"])
        swedish, named = hit_exists(lambda h: h["is_swedish"]), hit_exists(lambda h: (h["type"] == "team") & (normalize_keep(h["name"]) == normalize_keep(F.lit(f["label"]))))
        weight = {
            "player": F.when(exact, 18),
            "team": F.when(exact | named, 16),
            "league": F.when(exact, 14).when(swedish, 10),
        }[f["type"]]
        return F.when(F.col("sport") == f["sport"], F.coalesce(weight, F.lit(0))).otherwise(0)

    return reduce(lambda a, b: a + b, [one(f) for f in favorites], F.lit(0))


def source_authority(profiles: bool) -> Column:
    """Before the multiplier. profiles: columns profile_authority and profile_category from a joined source dimension."""
    source, words = F.col("source_text"), F.col("title_tags")
    guessed = F.when(any_word(source, SOURCES_HIGH), 10).when(any_word(source, SOURCES_STRONG), 7).when(any_word(source, SOURCES_LOW), -2).otherwise(0)
    if not profiles:
        return guessed
    bonus = reduce(lambda acc, kv: acc.when(F.col("profile_category") == kv[0], kv[1]), CATEGORY_BONUS.items(), F).otherwise(0)
    low = F.when((F.col("profile_category") == "fan_community") & any_word(words, LOW_NEWS) & ~F.col("hard_news"), 4).otherwise(0)
    return F.when(F.col("profile_authority").isNull(), guessed).otherwise(round_half_up(F.col("profile_authority") * 10) + bonus - low)


def evaluated(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with these columns, worked out once a row in a step of its own. The optimizer neither repeats their
    expressions in those that use them nor infers anything from them, so plans stay as long as they are written."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def score_articles(articles: DataFrame, now: Column, favorites: list[dict] | None = None, geo: bool = False, profiles: bool = False) -> DataFrame:
    """articles with the components, core_identity, core_strength and score."""
    favorites = favorites or []
    title_tags = normalize_keep(F.concat_ws(" ", text(F.col("title")), F.array_join(F.col("tags"), " ")))
    hours = age_hours(now)
    category, football, hockey = F.col("editorial.category"), F.col("sport") == "football", F.col("sport") == "hockey"
    allowed = F.coalesce(F.col("editorial.breaking") | (F.col("editorial.status") == "confirmed"), F.lit(False))
    out = evaluated(articles, {"title_tags": title_tags, "source_text": normalize_keep(F.col("source")), "all_text": article_text(), "hard_news": allowed, "age_hours": hours})
    hours = F.col("age_hours")
    big = [
        (category == "management", BIG_NEWS["management"]),
        (category.isin(TRANSFER_CATEGORIES), BIG_NEWS["transfer"]),
        (category == "match-event", BIG_NEWS["match"]),
        (F.col("editorial.breaking") | category.isin(LIVE_CATEGORIES), BIG_NEWS["live"]),
    ]
    allowed = F.col("hard_news")
    out = evaluated(out, {
        "recency": steps(hours, RECENCY_HOURS, up_to=True),
        "urgency": steps(F.when(allowed, 12).otherwise(0), URGENCY_STEPS),
        "swedish_player": hit_sum(lambda h: F.when(h["is_swedish"] & (h["type"] == "player"), 8)),
        "swedish_abroad": hit_sum(lambda h: F.when(h["is_abroad_core"], 14)),
        # The league's raw name: its case counts.
        "swedish_league": hit_sum(lambda h: F.when((h["type"] == "league") & any_word(h["name"], SWEDISH_LEAGUES), 12)),
        "favorite_affinity": favorite_affinity(favorites),
        "local_geo": F.lit(0) if not geo else F.greatest(F.coalesce("local_score", F.lit(0.0)), F.lit(0.0)) + F.when(any_word(F.concat_ws(" ", "title_tags", "source_text"), LOCAL_TERMS), 6).otherwise(0) + F.when(any_word(F.concat_ws(" ", "title_tags", "source_text"), LOCAL_SOURCES), 4).otherwise(0),
        "big_news": reduce(lambda a, b: a + b, [F.when(allowed & c, w).otherwise(0) for c, w in big]),
        "core_identity": core_identity(),
        "priority_score": steps(F.coalesce("priority", F.lit(0)), PRIORITY_STEPS),
        "intensity": F.greatest(F.coalesce("event_intensity", F.lit(0)), F.lit(0)),
        "daily_feature": F.when(hockey & any_word(normalize_keep(F.col("title")), ["today in hockey history"]) & any_word(F.col("source_text"), ["the hockey writers"]), 24).otherwise(0),
    })
    strong = ["swedish_player", "swedish_abroad", "swedish_league", "core_identity", "favorite_affinity", "local_geo", "big_news", "intensity"]
    out = evaluated(out, {"core_strength": reduce(lambda a, b: a + b, [F.col(c) for c in strong])})
    swedish_hit = hit_exists(lambda h: h["is_swedish"] | h["is_abroad_core"])
    swedish = F.when(football, swedish_hit | hit_exists(lambda h: (h["type"] == "league") & any_word(h["name"], ["allsvenskan", "superettan"])) | any_word(F.col("all_text"), ["allsvenskan", "superettan", "svensk", "svenska", "sverige"])).otherwise(
        swedish_hit | hit_exists(lambda h: (h["type"] == "league") & any_word(h["name"], ["shl", "hockeyallsvenskan", "tre kronor"])) | any_word(F.col("all_text"), ["svensk", "svenska", "sverige", "tre kronor", "shl", "hockeyallsvenskan"])
    )
    nhl = hockey & (F.col("daily_feature") == 0) & (any_word(F.col("all_text"), NHL_TERMS) | hit_exists(lambda h: (h["type"] == "league") & any_word(h["name"], ["nhl"])))
    boosted = (F.col("favorite_affinity") > 0) | (F.col("local_geo") > 0) | (F.col("big_news") > 0)
    out = evaluated(out, {"swedish_context": swedish, "nhl": nhl, "boosted": boosted})
    strength = F.col("core_strength")
    level = lambda high, mid, low: steps(strength, [(28, high), (16, mid)], low)
    multiplier = (
        F.when(F.col("boosted") | (F.col("daily_feature") > 0), 1.0)
        .when(football & ~F.col("swedish_context"), level(0.12, 0.08, 0.05))
        .when(football, level(1.0, 0.6, 0.3))
        .when(F.col("nhl") & ~F.col("swedish_context"), level(0.55, 0.35, 0.15))
        .otherwise(level(1.0, 0.8, 0.55))
    )
    fit = F.when(football, F.when(any_word(F.col("title_tags"), FOOTBALL_LEAGUES), 5).otherwise(0) + F.when(any_word(F.col("source_text"), FOOTBALL_FIT_SOURCES), 3).otherwise(0)).otherwise(
        F.when(any_word(F.col("title_tags"), HOCKEY_LEAGUES), 5).otherwise(0) + F.when(any_word(F.col("source_text"), HOCKEY_FIT_SOURCES), 3).otherwise(0)
    )
    exempt = any_word(F.col("title_tags"), ["today in hockey history"])
    evergreen = reduce(lambda a, b: a + b, [F.when(any_word(F.col("title_tags"), words), weight).otherwise(0) for weight, words in EVERGREEN.items()])
    stale = F.when(F.col("big_news") > 0, steps(hours, [(48, 8), (24, 4)])).otherwise(steps(hours, [(72, 8), (36, 4)]))
    out = evaluated(evaluated(out, {"source_multiplier": multiplier}), {
        "source_authority": round_half_up(source_authority(profiles) * F.col("source_multiplier")),
        "source_league_fit": round_half_up(fit * F.col("source_multiplier")),
        "source_country_fit": round_half_up(F.when(any_word(F.col("title_tags"), COUNTRY_TERMS), 4).otherwise(0) * F.col("source_multiplier")),
        "evergreen_penalty": F.when(exempt, 0).otherwise(evergreen),
        "staleness_penalty": F.coalesce(stale, F.lit(0)),
        "duplicate_penalty": F.least(F.lit(12), 3 * F.coalesce("duplicate_count", F.lit(0))),
        "foreign_football_penalty": F.when(football & ~F.col("boosted") & ~((strength >= 16) & F.col("swedish_context")) & ~any_word(F.col("all_text"), ["allsvenskan", "superettan", "svensk", "svenska", "sverige"]), steps(strength, [(16, 12)], 16)).otherwise(0),
        "nhl_penalty": F.when(F.col("nhl") & ~F.col("boosted") & (F.col("daily_feature") == 0) & ~F.col("swedish_context"), steps(strength, [(24, 8), (16, 12)], 18)).otherwise(0),
    })
    abroad = hit_exists(lambda h: (h["type"] == "player") & h["is_swedish"] & h["is_abroad_core"])
    domestic = hit_exists(lambda h: (h["type"] == "player") & h["is_swedish"] & ~h["is_abroad_core"])
    bounded = F.when(domestic & ~abroad, F.least(F.col("core_identity"), F.lit(12))).otherwise(F.col("core_identity"))
    plus = ["recency", "urgency", "swedish_player", "swedish_abroad", "swedish_league", "favorite_affinity", "local_geo", "source_authority", "source_league_fit", "source_country_fit", "big_news", "intensity", "priority_score", "core_contribution", "daily_feature"]
    minus = ["evergreen_penalty", "staleness_penalty", "duplicate_penalty", "foreign_football_penalty", "nhl_penalty"]
    out = evaluated(out, {"core_contribution": bounded})
    total = reduce(lambda a, b: a + b, [F.col(c) for c in plus]) - reduce(lambda a, b: a + b, [F.col(c) for c in minus])
    return evaluated(out, {"score": total.cast("double")}).drop("title_tags", "source_text", "all_text", "age_hours")
