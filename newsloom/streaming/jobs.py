"""Structured Streaming forms of the incremental behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bounded_lateness(stream: DataFrame, time: str, hours: int = 12) -> DataFrame:
    """Rows up to so many hours old when they are read, or without a time; the watermark bounds later state."""
    seconds = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col(time).cast("timestamp"))
    return stream.where(F.coalesce(seconds <= hours * 3600, F.lit(True))).withWatermark(time, f"{hours} hours")


def once_by(stream: DataFrame, key: str, time: str, hours: int = 12) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def session_clusters(stream: DataFrame, key: str, time: str, gap: str = "6 hours", watermark: str = "12 hours") -> DataFrame:
    """key, start, end, rows: sessions of rows at most the gap apart."""
    w = F.session_window(F.col(time), gap)
    return stream.withWatermark(time, watermark).groupBy(w.alias("session"), key).agg(F.count(F.lit(1)).alias("rows")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "rows")


def tumbling_counts(stream: DataFrame, time: str, width: str, *keys: str, watermark: str = "10 minutes") -> DataFrame:
    w = F.window(F.col(time), width)
    return stream.withWatermark(time, watermark).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.col("window.start").alias("start"), "rows")


def accept_within_limits(times: list[float], history: list[float], limits: list[tuple[float, int]]) -> tuple[list[bool], list[float]]:
    """Which sends (seconds, ascending) stay below every (window, count) limit of accepted sends; and those that later ones still see."""
    longest, out = max(w for w, _ in limits), []
    for t in times:
        history = [h for h in history if t - h <= longest]
        ok = all(sum(t - h <= w for h in history) < n for w, n in limits)
        out.append(ok)
        if ok:
            history.append(t)
    return out, history


def rate_limited(stream: DataFrame, key: str, time: str, limits: list[tuple[float, int]]) -> DataFrame:
    """The stream's key and time with `accepted`. The state of a key is its accepted sends within the longest window."""
    longest = int(max(w for w, _ in limits))
    kind = stream.schema[key].dataType.simpleString()

    def run(key_value: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        ok, history = accept_within_limits([t.timestamp() for t in rows["at"]], history, limits)
        state.update((history,))
        state.setTimeoutDuration(longest * 1000)
        yield pd.DataFrame({key: key_value[0], "at": rows["at"], "accepted": ok})

    slim = stream.select(F.col(key), F.col(time).cast("timestamp").alias("at"))
    return slim.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, at timestamp, accepted boolean", "history array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def within_windows(times: list[float], window: tuple[float, int] | None, seconds: float, most: int) -> tuple[list[bool], tuple[float, int]]:
    """Which requests (seconds, ascending) a fixed window lets pass; a window opens with the first request after the last
    one's end. And the window (start, count) that later ones still see."""
    start, count = window if window else (float("-inf"), 0)
    out = []
    for t in times:
        if t >= start + seconds:
            start, count = t, 0
        ok = count < most
        count += ok
        out.append(ok)
    return out, (start, count)


def window_limited(stream: DataFrame, key: str, time: str, seconds: int = 60, most: int = 60) -> DataFrame:
    """The stream's key and time with `accepted`. The state of a key is its open window, and goes when that is over."""
    kind = stream.schema[key].dataType.simpleString()

    def run(key_value: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        ok, window = within_windows([t.timestamp() for t in rows["at"]], window, seconds, most)
        state.update(window)
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({key: key_value[0], "at": rows["at"], "accepted": ok})

    slim = stream.select(F.col(key), F.col(time).cast("timestamp").alias("at"))
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at timestamp, accepted boolean", "start double, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs handle on every micro-batch. The handler must be idempotent by batch id, for instance a keyed merge."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
