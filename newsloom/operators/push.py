"""Delivery planning: who gets which article, set by set, with an audit reason for every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.relational import trailing_counts


def audience(articles: DataFrame, subscriptions: DataFrame, expanded: DataFrame, links: DataFrame) -> DataFrame:
    """device, item, direct: enabled devices that follow an entity of an article. links: item, entity_id."""
    follows = subscriptions.where("enabled").select("device", F.col("created_at").alias("since")).distinct().join(expanded, "device")
    rows = articles.select(F.col("id").alias("item"), "fetched_at", "published_at").join(links.select("item", "entity_id").distinct(), "item").join(follows, "entity_id")
    return rows.groupBy("device", "item", "since", "fetched_at", "published_at").agg(F.max("direct").alias("direct"))


def plan(pairs: DataFrame, log: DataFrame, stories: DataFrame, now, age_minutes: int = 180, grace_minutes: int = 5, story_hours: int = 6, short: tuple[int, int] = (600, 3), long: tuple[int, int] = (3600, 10)) -> DataFrame:  # noqa: ANN001
    """pairs with reason: `send`, or the first rule against it.

    log: device, item, sent_at. stories: item, story. The rules: too old, older than the subscription, delivered to the
    device within the long window, another article of the story delivered within `story_hours`, too many deliveries.
    """
    minutes = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 6e7
    recent = log.withColumn("ago", minutes(now, F.col("sent_at"))).where("ago >= 0")
    given = recent.where(F.col("ago") * 60 <= long[0]).select("device", "item").distinct().withColumn("given", F.lit(True))
    told = recent.where(F.col("ago") <= story_hours * 60).join(stories, "item").select("device", "story", F.col("item").alias("other")).distinct()
    counts = recent.groupBy("device").agg(F.count_if(F.col("ago") * 60 <= short[0]).alias("in_short"), F.count_if(F.col("ago") * 60 <= long[0]).alias("in_long"))
    rows = pairs.join(given, ["device", "item"], "left").join(counts, "device", "left")
    with_story = pairs.select("device", "item").join(stories, "item").join(told, ["device", "story"]).where("item <> other")
    rows = rows.join(with_story.select("device", "item").distinct().withColumn("told", F.lit(True)), ["device", "item"], "left")
    reason = (
        F.when(F.coalesce(minutes(now, F.col("published_at")) > age_minutes, F.lit(True)), "too-old")
        .when(F.coalesce(minutes(F.col("since"), F.col("fetched_at")) > grace_minutes, F.lit(False)), "before-subscription")
        .when(F.col("given"), "already-delivered")
        .when(F.col("told"), "story-delivered")
        .when((F.coalesce("in_short", F.lit(0)) >= short[1]) | (F.coalesce("in_long", F.lit(0)) >= long[1]), "rate-limited")
        .otherwise("send")
    )
    return rows.withColumn("reason", reason).select("device", "item", "direct", "reason")


def audit(planned: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """A row for each device and item, to be merged on both."""
    return planned.groupBy("device", "item").agg(F.min("reason").alias("reason"), F.max("direct").alias("direct")).withColumn("sent", F.col("reason") == "send").withColumn("created_at", now)


def delivery_rates(log: DataFrame) -> DataFrame:
    """log with its deliveries in the trailing 10 and 60 minutes."""
    return trailing_counts(log, "device", "sent_at", {"in_10_minutes": 600, "in_60_minutes": 3600})
