"""Selections among rows of one request: anchors, backfills, recent choices, and rows with a second source to fall back to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import editorial
from newsloom.functions.text import normalize
from newsloom.operators.relational import first_of

# Types that can anchor an event, the most important first, and bounds of backfills and recent choices.
ANCHORS = {"player": 4, "staff": 3, "coach": 3, "team": 2}
BACKFILL_HOURS, BACKFILL_SCAN, BACKFILL_RUN = 3, 250, 3
RECENT = 20


def anchor_entity(hits: Column) -> Column:
    """The hit that an event is about: by type, then Swedish ones, then confidence, then their order; null without one.
    hits: structs of type, is_swedish, confidence and others."""
    weight = F.create_map(*[F.lit(x) for kv in ANCHORS.items() for x in kv])
    named = F.filter(hits, lambda h: h["type"].isin(list(ANCHORS)))
    ranked = F.transform(named, lambda h, i: F.struct((-weight[h["type"]]).alias("a"), (-F.coalesce(h["is_swedish"], F.lit(False)).cast("int")).alias("b"), (-F.coalesce(h["confidence"].cast("double"), F.lit(0.0))).alias("c"), i.alias("i"), h.alias("hit")))
    return F.get(F.array_sort(ranked, lambda x, y: F.when(_before(x, y), -1).when(_before(y, x), 1).otherwise(0)), F.lit(0))["hit"]


def _before(x: Column, y: Column) -> Column:
    key = lambda v: F.struct(v["a"], v["b"], v["c"], v["i"])
    return key(x) < key(y)


def fill(first: DataFrame, backfill: DataFrame, request: list[str], limit: int) -> DataFrame:
    """first, and the backfill's rows in their order for the places that are left. Both have position; the result's is new."""
    both = first.withColumn("_part", F.lit(0)).unionByName(backfill.withColumn("_part", F.lit(1)))
    w = Window.partitionBy(*request).orderBy("_part", "position")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_part")


def backfill_candidates(articles: DataFrame, now: Column, hours: int = BACKFILL_HOURS, scan: int = BACKFILL_SCAN, most: int = BACKFILL_RUN) -> DataFrame:
    """The articles that a run assesses late: without an assessment, published and fetched within the hours before now, the
    newest `scan` of them looked at, and the first `most` of those with a cue. articles: id, title, tags, published_at,
    fetched_at, assessed. The limits are those of a run."""
    age = lambda c: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))).between(0, hours * 3_600_000_000)
    rows = articles.where(~F.col("assessed") & age("published_at") & age("fetched_at")).orderBy(F.col("published_at").desc(), "id").limit(scan)
    return rows.where(editorial.candidate(F.col("title"), F.lit(""), F.col("tags"))).orderBy(F.col("published_at").desc(), "id").limit(most)


def recent_choices(choices: DataFrame, keys: list[str], most: int = RECENT) -> DataFrame:
    """Each key's latest choices: of those of one type with the same entity or label the last one, the latest `most`.

    choices: the keys, type, entity_id, label, at, ordinal. A choice goes if a later one has its entity or its label.
    """
    order = [F.col("at").desc(), F.col("ordinal").desc()]
    rows = choices.withColumn("_label", normalize(F.col("label")))
    later = lambda c: F.row_number().over(Window.partitionBy(*keys, "type", c).orderBy(*order)) > 1
    kept = rows.withColumn("_gone", later("entity_id") | later("_label")).where(~F.col("_gone")).drop("_gone", "_label")
    w = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def with_fallback_rows(wanted: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """wanted with the row of the first table, else of the second; wanted keys that neither has go. Both have the same columns."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return wanted.select(key).distinct().join(first_of(both, [key], F.col("_part")).drop("_part"), key)


def engine_favorites(favorites: DataFrame) -> DataFrame:
    """Favourites that ranking knows: those of an entity. Ones by token alone mark items and give no boost."""
    return favorites.where(F.col("entity_id").isNotNull())


def audited(audit: DataFrame, articles: DataFrame) -> DataFrame:
    """Audit rows with the title, source and time of their article, if it is still there."""
    return audit.join(articles.select(F.col("id").alias("item"), "title", "source", "published_at"), "item", "left")
