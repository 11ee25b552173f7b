"""Whole plans: ingest, ranking and the personalised feed, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.errors import InvalidInput
from newsloom.functions.scoring import score_articles
from newsloom.operators import graph, rank, relational


@dataclass(frozen=True)
class FeedRequest:
    """Options of a feed; favourites are dicts of entity_id, sport, type and label."""

    sport: str
    limit: int = 20
    favorites: Sequence[dict] = field(default_factory=tuple)
    favorites_first: bool = False
    max_age_hours: float = 72.0
    floors: dict = field(default_factory=lambda: {"football": (0.0, -2.0), "hockey": (2.0, -3.0)})

    def __post_init__(self) -> None:
        if self.sport not in self.floors:
            raise InvalidInput(f"unknown sport: {self.sport}", sport=self.sport)
        if not 1 <= self.limit <= 30:
            raise InvalidInput("limit must be from 1 to 30", limit=self.limit)


def ingest(items: DataFrame, known: DataFrame, now: Column, per_feed: int = 80, hours: float = 12) -> tuple[DataFrame, DataFrame]:
    """New rows to insert, and the funnel: how many rows of each feed stop at which stage. items: feed, ordinal, title, url, published_at."""
    age = rank.age_minutes(now, F.col("published_at"))
    stages = [("required", (F.trim("title") != "") & (F.trim("url") != "")), ("age", F.coalesce(age <= hours * 60, F.lit(True)))]
    counts = relational.funnel(items, stages, ["feed"])
    kept = items.where(F.coalesce(stages[0][1], F.lit(False)) & stages[1][1])
    capped = rank.top_k(kept, ["feed"], per_feed, F.col("ordinal")).drop("position")
    dated = capped.withColumn("published_at", F.least(F.coalesce("published_at", now), now))
    return relational.merge_insert_ignore(known, dated, ["url"], "ordinal"), counts


def ranked(articles: DataFrame, request: FeedRequest, now: Column) -> DataFrame:
    """Duplicates and events counted, scored, floored, ordered and balanced. articles: id, sport, title, url, source,
    published_at, tags, priority, entity_hits, editorial, local_score, event_key."""
    own = articles.where(F.col("sport") == request.sport)
    duplicates = graph.duplicate_groups(own).select("id", "duplicate_count")
    clusters = graph.gap_clusters(own.where("event_key IS NOT NULL").select("id", "event_key", "published_at", "source"), ["event_key"], "published_at", 360 * 60, "id")
    sizes = clusters.groupBy("event_key", "cluster_start").agg(F.least(F.lit(8), 2 * (F.countDistinct("source") - 1)).alias("event_intensity"))
    events = clusters.join(sizes, ["event_key", "cluster_start"]).select("id", "event_intensity")
    scored = score_articles(own.join(duplicates, "id", "left").join(events, "id", "left"), now, list(request.favorites))
    kept = rank.score_floor(scored, request.floors).withColumn("ordinal", F.col("id")).withColumn("request", F.lit("feed"))
    few = rank.top_k(kept, ["request"], 10 * request.limit, *rank.score_order())
    return rank.balance_sources(few, ["request"])


def feed(articles: DataFrame, request: FeedRequest, now: Column) -> DataFrame:
    """The feed of one request: fresh rows before fallback and backfill, favourites first if asked for, up to the limit."""
    fresh = rank.within_hours(articles, now, request.max_age_hours)
    rows = ranked(fresh, request, now).withColumnRenamed("position", "rank")
    favorite = F.col("favorite_affinity") > 0 if request.favorites_first else F.lit(False)
    order = [favorite.desc(), rank.freshness_bucket(now, F.col("published_at")).isin(0, 1, 2).desc(), F.col("rank")]
    return rank.top_k(rows, ["request"], request.limit, *order)
