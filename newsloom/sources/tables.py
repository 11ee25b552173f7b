"""Table sources and sinks: Parquet and other Spark formats, and merges that rewrite a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.relational import merge_update_when, merge_upsert
from newsloom.sources.sink import publish


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has all the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, name: str, merged: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the rows of a catalog table by what `merged` makes of them, for instance a keyed merge of `relational`.

    The name is switched to the new rows once they are written whole (`sink.publish`), so a lost job leaves the old ones.
    A table format with its own MERGE does the same without writing unchanged rows again.
    """
    publish(merged(spark.table(name)), name)


def replaced_subscriptions(old: DataFrame, new: DataFrame, device: str, endpoint: str, ordinal: str) -> DataFrame:
    """old with all subscriptions of the new ones' devices disabled, then the new ones by endpoint."""
    off = old.join(new.select(F.col(device)).distinct().withColumn("_off", F.lit(True)), device, "left")
    off = off.withColumn("enabled", F.col("enabled") & F.col("_off").isNull()).drop("_off")
    return merge_upsert(off, new.withColumn("enabled", F.lit(True)), [endpoint], ordinal).select(*old.columns)


def without_gone(subscriptions: DataFrame, results: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Subscriptions whose endpoint answered a delivery with HTTP 404 or 410 are disabled. results: endpoint, status."""
    gone = results.where(F.col("status").isin(404, 410)).select(endpoint).distinct().withColumn("enabled", F.lit(False))
    return merge_update_when(subscriptions, gone, [endpoint], "enabled", F.lit(True))


def counters(events: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n: how often each reason was met; nulls are no reason."""
    return events.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def deliver(rows: DataFrame, send: Callable[[list[dict]], None] | None = None, batch: int = 500) -> int:
    """Hands rows to `send` in batches on the executors, and returns how many there were; without it nothing is sent."""
    if send is not None:

        def run(part):  # noqa: ANN001, ANN202
            held = []
            for row in part:
                held.append(row.asDict(recursive=True))
                if len(held) == batch:
                    send(held)
                    held = []
            if held:
                send(held)

        rows.foreachPartition(run)
    return rows.count()
