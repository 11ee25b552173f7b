"""The ingest funnel of feeds: every counter and a few samples of what each stage blocked, in one pass over the items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# The items of a feed that go on after the filters, and the samples kept of a blocking stage.
MOST_ITEMS, SAMPLES = 80, 5
#: Blocking stages in order, the name of what they block and of what is left after them.
STAGES = ["missing_required_fields", "age", "irrelevant", "cap", "source_sport_verification", "no_sport_signal", "sport_mismatch", "unknown_sport_reason"]
SAMPLED = [s for s in STAGES if s not in ("cap", "unknown_sport_reason")]


def staged(items: DataFrame, required: Column, fresh: Column, relevant: Column, verified: Column, resolution: Column, feed: str = "feed", ordinal: str = "ordinal", most: int = MOST_ITEMS) -> DataFrame:
    """items with `blocked_by`, the first stage that blocks an item of a feed, in its order; null for those that pass all.

    resolution: `match` or why an item has no sport: `no-signal`, `mismatch`, anything else. Nulls don't pass. The cap counts
    the items that passed the stages before it, which is a window over each feed.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    before = F.when(~ok(required), STAGES[0]).when(~ok(fresh), STAGES[1]).when(~ok(relevant), STAGES[2])
    marked = items.withColumn("_before", before)
    place = F.count_if(F.col("_before").isNull()).over(Window.partitionBy(feed).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(resolution == "no-signal", STAGES[5]).when(resolution == "mismatch", STAGES[6]).otherwise(STAGES[7])
    after = F.when(place > most, STAGES[3]).when(~ok(verified), STAGES[4]).when(~ok(resolution == "match"), reason)
    return marked.withColumn("blocked_by", F.coalesce("_before", after)).drop("_before")


def counters(marked: DataFrame, existing: Column, sample: Column, feed: str = "feed", ordinal: str = "ordinal") -> DataFrame:
    """A row for each feed: what was fetched, left after each stage and blocked by it, what passed but is stored already
    (duplicate_or_existing), and the first SAMPLES samples of each stage in SAMPLED. marked: by `staged`.

    Samples are numbered by the window that `staged` has sorted for, so all of it is one shuffle by feed.
    """
    stage = F.col("blocked_by")
    running = Window.partitionBy(feed).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    number = reduce(lambda acc, s: acc.when(stage == s, F.count_if(stage == s).over(running)), SAMPLED, F)
    text = F.nullif(F.coalesce(sample, F.lit("")), F.lit(""))
    few = marked.withColumn("_sample", F.when(number <= SAMPLES, F.struct(F.col(ordinal).alias("at"), text.alias("said"))))
    blocked = {s: F.count_if(stage == s) for s in STAGES}
    left = {s: F.count_if(stage.isNull() | ~stage.isin(STAGES[: k + 1])) for k, s in enumerate(STAGES)}
    samples = lambda s: F.transform(F.array_sort(F.collect_list(F.when((stage == s) & F.col("_sample.said").isNotNull(), F.col("_sample")))), lambda x: x["said"])
    return few.groupBy(feed).agg(
        F.count(F.lit(1)).alias("raw_fetched"),
        left[STAGES[0]].alias("after_required_fields"), blocked[STAGES[0]].alias("blocked_by_missing_required_fields"),
        left[STAGES[1]].alias("after_age_filter"), blocked[STAGES[1]].alias("blocked_by_age"),
        left[STAGES[2]].alias("after_irrelevant_filter"), blocked[STAGES[2]].alias("blocked_by_irrelevant"),
        left[STAGES[3]].alias("after_max_items_cap"), blocked[STAGES[3]].alias("capped_away"),
        left[STAGES[4]].alias("after_source_sport_verification"), blocked[STAGES[4]].alias("blocked_by_source_sport_verification"),
        left[STAGES[7]].alias("after_resolved_sport"), blocked[STAGES[5]].alias("blocked_by_no_sport_signal"),
        blocked[STAGES[6]].alias("blocked_by_sport_mismatch"), blocked[STAGES[7]].alias("blocked_by_unknown_sport_reason"),
        F.count_if(stage.isNull() & F.coalesce(existing, F.lit(False))).alias("duplicate_or_existing"),
        *[samples(s).alias(f"sample_{s}") for s in SAMPLED],
    )


def observed(marked: DataFrame, existing: Column, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The rows that pass, and an observation of the whole run's counters, taken while those rows are written: no second
    scan. `observation.get` waits for the write; a stream's are in its progress under the name."""
    stage, watch = F.col("blocked_by"), Observation(name)
    counts = [F.count(F.lit(1)).alias("raw_fetched"), F.count_if(stage.isNull()).alias("passed"), F.count_if(stage.isNull() & F.coalesce(existing, F.lit(False))).alias("duplicate_or_existing")]
    counts += [F.count_if(stage == s).alias(f"blocked_by_{s}") for s in STAGES]
    return marked.observe(watch, *counts).where(stage.isNull()).drop("blocked_by"), watch
