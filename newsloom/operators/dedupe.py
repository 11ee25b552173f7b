"""Order-dependent acceptance of a request's candidates, newest first.

The rules need what was accepted before, so a request's candidates are scanned in one pass of a grouped pandas function.
A request is bounded: it has at most its fetch limit of candidates. Everything that doesn't depend on the order is
computed before as columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import editorial, scoring
from newsloom.functions.classify import angle, banned_hockey, junior_team
from newsloom.functions.text import normalize, story_title, text


@dataclass(frozen=True)
class DedupeConfig:
    """Windows in milliseconds; 0 switches a rule off. Margins and floors are those of the acceptance rules."""

    cooldown: int = 0
    title_window: int = 7_200_000
    cross_window: int = 7_200_000
    event_window: int = 0
    similarity: float = 0.74
    limit: int | None = None
    source_margin: float = 0.12
    canonical_margin: float = 0.08
    entity_floor: float = 0.45
    match_floor: float = 0.55
    angle_floor: float = 0.92


MATCH_EVENTS = frozenset(["goal", "match_result", "penalty", "red_card"])
PEOPLE_EVENTS = frozenset(["transfer", "injury", "management"])


def _grams(title: str) -> frozenset[str]:
    padded = f" {title} "
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2)) if title else frozenset()


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


@dataclass
class Candidate:
    ordinal: int
    time: float
    title: str
    source: str
    quality: float
    preference: float
    event: str | None
    angle: str
    entities: frozenset = field(default_factory=frozenset)
    teams: frozenset = field(default_factory=frozenset)
    people: frozenset = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        self.words, self.grams = frozenset(self.title.split()), _grams(self.title)

    def similarity(self, other: Candidate) -> float:
        return max(_jaccard(self.words, other.words), _jaccard(self.grams, other.grams))

    def angles_clash(self, other: Candidate) -> bool:
        return self.angle != other.angle

    def same_event(self, other: Candidate, similarity: float, config: DedupeConfig) -> bool:
        if self.event is None or self.event != other.event or self.angles_clash(other):
            return False
        shared = len(self.entities & other.entities)
        if self.event in MATCH_EVENTS:
            return shared >= 2 or (shared >= 1 and bool(self.teams & other.teams) and similarity >= config.match_floor)
        if self.event in PEOPLE_EVENTS and self.people & other.people:
            return True
        return shared >= 1 and similarity >= config.entity_floor

    def preferred(self, other: Candidate) -> float:
        """The source's worth and up to 0.06 for being newer than the other, at 0.02 an hour."""
        return self.preference + max(-0.06, min(0.06, (self.time - other.time) / 3_600_000 * 0.02))


def decide(candidates: list[Candidate], event_keys: list[str | None], blocked: list[str | None], config: DedupeConfig) -> list[str]:
    """A verdict for each candidate in order: accepted, replaced, beyond-limit, or the rule that rejects it."""
    verdicts = [""] * len(candidates)
    last_of_source: dict[str, float] = {}
    titles: set[tuple[str, str]] = set()
    events: dict[str, float] = {}
    recent: list[Candidate] = []
    accepted = 0
    for k, (c, event, rule) in enumerate(zip(candidates, event_keys, blocked, strict=True)):
        if config.limit is not None and accepted >= config.limit:
            verdicts[k] = "beyond-limit"
        elif rule is not None:
            verdicts[k] = rule
        elif config.cooldown and c.source in last_of_source and 0 <= c.time - last_of_source[c.source] < config.cooldown:
            verdicts[k] = "cooldown"
        elif config.title_window and c.title and (c.source, c.title) in titles:
            # Candidates come newest first, so an earlier title of the source is never older than the window.
            verdicts[k] = "same-source-title"
        if verdicts[k]:
            continue
        if config.title_window and c.title:
            titles.add((c.source, c.title))
        if config.event_window and event is not None:
            if event in events and 0 <= events[event] - c.time <= config.event_window:
                verdicts[k] = "person-event"
                continue
            events[event] = c.time
        if config.cross_window and c.title:
            while recent and recent[0].time - c.time > config.cross_window:
                recent.pop(0)
            beaten = []
            for other in recent:
                s = c.similarity(other)
                if s < config.similarity and not c.same_event(other, s, config):
                    continue
                if c.angles_clash(other) and s < config.angle_floor:
                    continue
                if c.preferred(other) > other.preferred(c) + config.canonical_margin or c.quality > other.quality + config.source_margin:
                    beaten.append(other)
                    continue
                verdicts[k] = "cross-source"
                break
            if verdicts[k]:
                continue
            for other in beaten:
                verdicts[other.ordinal] = "replaced"
                recent.remove(other)
                accepted -= 1
            recent.append(c)
        verdicts[k] = "accepted"
        accepted += 1
        last_of_source[c.source] = c.time
    return verdicts


NO_ASSESSMENT = "struct<version:int,title:string,category:string,status:string,badge:string,breaking:boolean,evidence:string,assessed_at:timestamp,model:string>"


# What a source's category adds to its authority, an hour's fits to its worth, and an own entity's article.
CATEGORY_WORTH = {"official_local": 0.4, "local_media": 0.28, "public_service_local": 0.28, "aggregator_team_feed": 0.14, "fan_community": 0.04}
LEAGUE_WORTH, COUNTRY_WORTH = 0.025, 0.02
OWN_ENTITY_WORTH = {"official_local": 0.2, "local_media": 0.08, "public_service_local": 0.08}
HITS = "array<struct<entity_id:string,sport:string,type:string,name:string,is_swedish:boolean,is_abroad_core:boolean>>"


def by_category(category: Column, worth: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in worth.items() for x in kv])[category], F.lit(0.0))


def source_quality(authority: Column, category: Column) -> Column:
    """A source's worth by its profile: its authority and what its category adds, 0 at least; without a profile 0."""
    return F.greatest(F.lit(0.0), F.coalesce(authority, F.lit(0.0)) + by_category(category, CATEGORY_WORTH))


def with_source_worth(items: DataFrame, now: Column) -> DataFrame:
    """items with quality and preference, which `sequential_dedupe` takes: the source's worth, and that with what the
    article's league and country fit add, and more for an official or local source with an article of an entity it owns.

    items: title, tags, source, sport, published_at, editorial (struct or null), profile_authority and profile_category (of
    the source's profile), policy_entity_ids (those that the source's policy names) and entities (of the article). The fits
    are those of the score, of title, tags, source and assessment alone.
    """
    bare = items.select(F.struct(*items.columns).alias("_item"), "title", "tags", "source", "sport", "published_at", "editorial").withColumns({
        "entity_hits": F.array().cast(HITS), "priority": F.lit(0), "local_score": F.lit(0.0), "duplicate_count": F.lit(0), "event_intensity": F.lit(0),
    })
    scored = scoring.score_articles(bare, now)
    category = F.col("_item.profile_category")
    quality = source_quality(F.col("_item.profile_authority"), category)
    owns = F.coalesce(F.arrays_overlap("_item.policy_entity_ids", "_item.entities"), F.lit(False))
    own = F.when(owns, by_category(category, OWN_ENTITY_WORTH)).otherwise(0.0)
    preference = F.greatest(F.lit(0.0), quality + F.col("source_league_fit") * LEAGUE_WORTH + F.col("source_country_fit") * COUNTRY_WORTH + own)
    return scored.select("_item.*", quality.alias("quality"), preference.alias("preference"))


def prepared(items: DataFrame, sport: Column) -> DataFrame:
    """items (title, url, source, published_at) with what the rules need of each row."""
    title = normalize(F.col("title"))
    rule = (
        F.when((F.trim(text(F.col("title"))) == "") | (F.trim(text(F.col("url"))) == ""), "required")
        .when(F.col("published_at").isNull(), "date")
        .when((sport == "hockey") & banned_hockey(title), "banned")
        .when(junior_team(title), "junior")
    )
    # Of an article with an assessment that is valid for it, this tells the event.
    tags = F.col("tags") if "tags" in items.columns else F.array().cast("array<string>")
    a = F.col("editorial_assessment") if "editorial_assessment" in items.columns else F.lit(None).cast(NO_ASSESSMENT)
    a = F.when(editorial.valid(a, F.col("title")), a)
    return items.withColumns({
        "_title": story_title(F.col("title")), "_rule": rule, "_event_key": editorial.event_key(a, F.col("title"), tags, F.col("published_at")),
        "_event": editorial.canonical_event(a, F.col("title"), tags), "_angle": angle(title), "_ms": F.unix_millis(F.col("published_at").cast("timestamp")),
    })


def sequential_dedupe(items: DataFrame, request: list[str], sport: Column, config: DedupeConfig | None = None) -> DataFrame:
    """items with verdict. Columns: id, ordinal (ties of equal times keep this order), title, url, source, published_at,
    quality and preference (of the source), entities, teams and people (arrays of ids)."""
    config = config or DedupeConfig()
    ready, columns = prepared(items, sport), items.columns

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_ms", "ordinal"], ascending=[False, True], na_position="last", kind="stable").reset_index(drop=True)
        made = []
        for k in range(len(group)):
            r = group.iloc[k]
            none = lambda v: None if pd.isna(v) else v
            made.append(Candidate(k, float(r["_ms"]) if none(r["_ms"]) is not None else 0.0, r["_title"] or "", r["source"] or "", r["quality"], r["preference"], none(r["_event"]), r["_angle"], frozenset(r["entities"]), frozenset(r["teams"]), frozenset(r["people"])))
        clean = lambda c: [None if pd.isna(v) else v for v in group[c]]
        return group[columns].assign(verdict=decide(made, clean("_event_key"), clean("_rule"), config))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", verdict string"
    return ready.groupBy(*request).applyInPandas(scan, schema)
