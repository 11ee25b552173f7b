"""Streams with state of their own, in event time: what they say doesn't depend on how rows are dealt to batches.

All are processors of `transformWithState`. Rows wait in state until the watermark has passed them, or close what the
watermark has passed; so only rows that come after the watermark, which Spark drops, could change a result. State is
removed by event-time timers as soon as nothing can need it. They need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.streaming.jobs import accept_within_limits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def merged_sessions(sessions: Iterable[tuple], gap: int) -> list[tuple]:
    """Sessions (start, last, members, sources, newest, newest's id) at most the gap apart become one; of equally new rows the
    smaller id is the newest."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] - out[-1][1] <= gap:
            a = out.pop()
            newest, ident = max((a[4:], s[4:]), key=lambda x: (x[0], -x[1]))
            s = (a[0], max(a[1], s[1]), a[2] + s[2], sorted({*a[3], *s[3]}), newest, ident)
        out.append(s)
    return out


class EventSessions(StatefulProcessor):
    """Open sessions of a key; a session is told when the watermark is over a gap past its last row. A key has one timer, of
    the session that ends first, which when it runs tells all that are over and is set anew for the rest."""

    STATE = "start long, last long, members long, sources array<string>, newest long, newest_id long"

    def __init__(self, keys: list[str], gap: int) -> None:
        self.told, self.gap = Row(*keys, "cluster_start", "members", "sources", "representative", "intensity"), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = [tuple(s) for s in self.open.get()]
        known += [(r["_at"], r["_at"], 1, [r["_source"]] if r["_source"] is not None else [], r["_at"], r["_id"]) for r in rows]
        kept = merged_sessions(known, self.gap)
        self.open.put(kept)
        self.wait_for(kept)
        yield from ()

    def wait_for(self, sessions: list[tuple]) -> None:
        """A timer for the first end. An earlier one, of a session that has grown since, only finds none over."""
        self.handle.registerTimer(-(-(min(s[1] for s in sessions) + self.gap) // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = [tuple(s) for s in self.open.get()]
        over, rest = [s for s in known if s[1] + self.gap <= passed], [s for s in known if s[1] + self.gap > passed]
        if over and rest:
            self.open.put(rest)
        elif over:
            self.open.clear()
        if rest:
            self.wait_for(rest)
        for s in over:
            if s[2] > 1:
                yield self.told(*key, s[0], s[2], len(s[3]), s[5], min(8, 2 * max(0, len(s[3]) - 1)))

    def close(self) -> None:
        pass


def event_sessions(stream: DataFrame, keys: list[str], time: str, order: str, source: str, gap_minutes: int = 360, watermark: str = "12 hours") -> DataFrame:
    """The stream form of `graph.event_clusters`: keys, cluster_start, members, sources, representative, intensity.

    A late row may join two sessions to one, as a row a gap away still does; rows without a time are dropped. order: the
    rows' id, a whole number. What is told is final; a session ends a gap and the watermark's delay after its last row.
    """
    use_rocksdb(stream.sparkSession)
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    at = F.col(time).cast("timestamp")
    rows = stream.where(at.isNotNull()).select(*keys, at.alias("_time"), F.unix_micros(at).alias("_at"), F.col(order).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"))
    rows = rows.withWatermark("_time", watermark)
    schema = f"{kinds}, cluster_start long, members long, sources long, representative long, intensity int"
    told = rows.groupBy(*keys).transformWithState(EventSessions(keys, gap_minutes * 60_000_000), schema, "append", "eventTime")
    return told.withColumn("cluster_start", F.timestamp_micros("cluster_start"))


class InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them and are then judged in order of time (`judged`)."""

    PENDING = "at long, row string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.PENDING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        came = [(r["_at"], r["_row"]) for r in rows]
        self.pending.appendList(came)
        for at in {-(-at // 1000) for at, _ in came}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        due = sorted(r for r in waiting if r[0] <= passed)
        rest = [r for r in waiting if r[0] > passed]
        if due:
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        yield from self.judged(key, due, passed)

    def judged(self, key: Any, due: list[tuple[int, str]], passed: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class TrailingLimits(InOrder):
    """Accepts what stays below every (seconds, count) limit of accepted rows."""

    def __init__(self, key: str, limits: list[tuple[float, int]]) -> None:
        self.told = Row(key, "at", "row", "accepted")
        self.limits, self.longest = limits, int(max(w for w, _ in limits) * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.history = handle.getListState("history", "at long")

    def judged(self, key: Any, due: list[tuple[int, str]], passed: int) -> Iterator[Row]:
        history = [r[0] for r in self.history.get()]
        ok, history = accept_within_limits([at / 1e6 for at, _ in due], [h / 1e6 for h in history], self.limits)
        # Later rows are past the watermark, and see no more than the longest window before them.
        kept = [round(h * 1e6) for h in history if round(h * 1e6) + self.longest >= passed]
        if kept:
            self.history.put([(h,) for h in kept])
            self.handle.registerTimer(-(-(kept[-1] + self.longest) // 1000) + 1)
        else:
            self.history.clear()
        for (at, row), accepted in zip(due, ok, strict=True):
            yield self.told(*key, at, row, accepted)


class WindowLimits(InOrder):
    """Fixed windows of many keys, at most `most_keys` of which are held.

    Before a request, if so many are held, those that are over go, and then the first that came until there is room.
    """

    def __init__(self, length: int, most: int, most_keys: int) -> None:
        self.told = Row("shard", "at", "row", "accepted")
        self.length, self.most, self.most_keys = length, most, most_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.windows = handle.getMapState("windows", "name string", "start long, count int, since long")

    def judged(self, key: Any, due: list[tuple[int, str]], passed: int) -> Iterator[Row]:
        held = dict(sorted(((k[0], list(v)) for k, v in self.windows.iterator()), key=lambda x: x[1][2]))
        before = {k: list(v) for k, v in held.items()}
        number = max((v[2] for v in held.values()), default=0)
        for at, name in due:
            if len(held) >= self.most_keys:
                for k in [k for k, v in held.items() if v[0] + self.length <= at]:
                    del held[k]
                for k in list(held)[: max(0, len(held) - self.most_keys + 1)]:
                    del held[k]
            window = held.get(name)
            if window is None or window[0] + self.length <= at:
                if window is None:
                    number += 1
                held[name] = [at, 1, window[2] if window else number]
                accepted = True
            else:
                accepted = window[1] < self.most
                window[1] += accepted
            yield self.told(*key, at, name, accepted)
        # What is over by the watermark can't hold any later request back.
        for k in [k for k, v in held.items() if v[0] + self.length <= passed]:
            del held[k]
        for k in before.keys() - held.keys():
            self.windows.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.windows.updateValue((k,), tuple(v))
        if held:
            self.handle.registerTimer(-(-(min(v[0] for v in held.values()) + self.length) // 1000) + 1)


def _waiting(stream: DataFrame, key: Column, time: str, row: Column, watermark: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    at = F.col(time).cast("timestamp")
    rows = stream.where(at.isNotNull()).select(key, at.alias("_time"), F.unix_micros(at).alias("_at"), row.cast("string").alias("_row"))
    return rows.withWatermark("_time", watermark)


def trailing_limited(stream: DataFrame, key: str, time: str, limits: list[tuple[float, int]], row: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """key, at, row, accepted: rows in order of time, below all (seconds, count) limits of accepted ones or not.

    Verdicts come once the watermark has passed a row; a row that comes late but before that is judged in its place. Rows
    without a time are dropped. row: a column that is handed through as text; rows of one time are judged in its order.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = _waiting(stream, F.col(key), time, F.col(row) if row else F.lit(""), watermark)
    out = rows.groupBy(key).transformWithState(TrailingLimits(key, limits), f"{key} {kind}, at long, row string, accepted boolean", "append", "eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def fixed_window_limited(stream: DataFrame, key: str, time: str, seconds: int = 60, most: int = 60, most_keys: int = 5000, shards: int = 8, watermark: str = "1 minute") -> DataFrame:
    """key, at, accepted: requests within windows that open with a key's first request after its last window.

    Keys are dealt to shards, each of which holds most_keys / shards windows at most, so state is bounded however many keys
    there are; with one shard the bound works as one map does. A key whose window had to go starts a new one.
    """
    rows = _waiting(stream, F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), time, F.col(key), watermark)
    processor = WindowLimits(seconds * 1_000_000, most, max(1, most_keys // shards))
    out = rows.groupBy("shard").transformWithState(processor, "shard long, at long, row string, accepted boolean", "append", "eventTime")
    kind = stream.schema[key].dataType
    return out.select(F.col("row").cast(kind).alias(key), F.timestamp_micros("at").alias("at"), "accepted")
