"""Registered queries that run a stream over a table and return what it wrote, with SQL over the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators.graph import checkpoint_folder
from newsloom.plans.registry import query, table
from newsloom.streaming import state


def streamed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a table's files writes until it has read them all and timers of the last watermark have run."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")
    out = build(stream)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
 SELECT user_id, min(ts) AS cluster_start, count(*) AS members, count(DISTINCT event_type) AS sources, arg_max(event_id, (ts, -event_id)) AS representative, (least(8, 2 * (count(DISTINCT event_type) - 1)))::INTEGER AS intensity
 FROM c GROUP BY user_id, k HAVING count(*) > 1 AND max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 18 HOURS"""
)
def m05_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed: a gap of 6 hours and the delay of 12 are over."""
    build = lambda s: state.event_sessions(s, ["user_id"], "ts", "event_id", "event_type")
    return streamed(spark, sf_dir, "events", build)
