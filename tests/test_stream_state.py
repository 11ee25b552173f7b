"""Streams with state: any dealing of the rows to batches gives what one batch gives."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph
from newsloom.streaming import state
from newsloom.streaming.jobs import accept_within_limits

START = datetime(2024, 1, 1)


def minutes(m):
    return START + timedelta(minutes=m)


def run(spark, tmp_path, batches, schema, build):
    """Rows of a stream that gets the batches one by one; and the most state rows that any batch left."""
    folder = tmp_path / uuid.uuid4().hex
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (query.recentProgress) if p["stateOperators"]]
    return spark.read.parquet(f"{folder}/out").collect(), held


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 4)])
def test_event_sessions_equal_batch_clusters(spark, tmp_path, seed, batches):
    """Shuffled rows, gaps of exactly the boundary and a second more, a late row that joins two sessions, ties, nulls."""
    rng = random.Random(seed)
    rows = [(k, rng.choice("abc"), minutes(rng.randint(0, 60) * 30), rng.choice(["s1", "s2", "s3", None])) for k in range(30)]
    rows += [(100, "edge", minutes(0), "x"), (101, "edge", minutes(360), "y"), (102, "edge", minutes(720) + timedelta(microseconds=1), "z"), (103, "far", minutes(0), "x"), (104, "far", minutes(361), "y")]
    rows += [(110, "joined", minutes(0), "x"), (111, "joined", minutes(700), "y"), (113, "joined", minutes(700), "w"), (120, "joined", None, "y")]
    rng.shuffle(rows)
    rows.append((112, "joined", minutes(350), "z"))
    schema = "id long, topic string, at timestamp, source string"
    want = graph.event_clusters(spark.createDataFrame(rows, schema), ["topic"], "at", "id", "source").collect()
    size = -(-len(rows) // batches)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [[(999, "end", minutes(100_000), "x")]]
    got, held = run(spark, tmp_path, parts, schema, lambda s: state.event_sessions(s, ["topic"], "at", "id", "source", watermark="40 hours"))
    columns = ["topic", "cluster_start", "members", "sources", "representative", "intensity"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r[c] for c in columns) for r in want)
    assert {r["topic"]: r["members"] for r in got if r["topic"] in ("edge", "far", "joined")} == {"edge": 2, "joined": 4}
    assert held[-1] <= 4


def test_trailing_limits_are_judged_in_order_of_time(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted({(k, START + timedelta(seconds=s)) for k in ("d1", "d2") for s in rng.sample(range(4000), 60)})
    limits = [(600.0, 3), (3600.0, 5)]
    want = {}
    for key in ("d1", "d2"):
        times = [at for k, at in rows if k == key]
        ok, _ = accept_within_limits([t.timestamp() for t in times], [], limits)
        want |= {(key, t): o for t, o in zip(times, ok, strict=True)}
    rng.shuffle(rows)
    results = []
    for parts in ([rows], [rows[:40], rows[40:90], rows[90:]]):
        got, held = run(spark, tmp_path, [*parts, [("end", minutes(10_000))]], "device string, at timestamp", lambda s: state.trailing_limited(s, "device", "at", limits, watermark="3 hours"))
        results.append({(r["device"], r["at"]): r["accepted"] for r in got if r["device"] != "end"})
        assert held[-1] <= 3
    assert results == [want, want] and set(want.values()) == {True, False}


def test_a_late_row_leaves_earlier_verdicts(spark, tmp_path):
    """Verdicts of rows that the watermark has passed are told; a row from before the watermark is dropped."""
    parts = [[("d", minutes(m)) for m in (0, 1, 2)], [("x", minutes(60))], [("x", minutes(60))], [("d", minutes(0) + timedelta(seconds=30)), ("d", minutes(61))], [("x", minutes(200))]]
    got, _ = run(spark, tmp_path, parts, "device string, at timestamp", lambda s: state.trailing_limited(s, "device", "at", [(600.0, 2)], watermark="10 minutes"))
    assert sorted((r["at"], r["accepted"]) for r in got if r["device"] == "d") == [(minutes(0), True), (minutes(1), True), (minutes(2), False), (minutes(61), True)]


def limited(requests, seconds, most, most_keys):
    """The map of windows, request by request."""
    held, out = {}, []
    for at, name in sorted(requests):
        if len(held) >= most_keys:
            for k in [k for k, (end, _) in held.items() if end <= at]:
                del held[k]
            while len(held) >= most_keys:
                del held[next(iter(held))]
        end, count = held.get(name, (None, 0))
        if end is None or end <= at:
            held[name] = (at + timedelta(seconds=seconds), 1)
            out.append((name, at, True))
        else:
            held[name] = (end, count + (count < most))
            out.append((name, at, count < most))
    return sorted(out)


@pytest.mark.parametrize("most_keys, shards", [(5000, 3), (6, 1)])
def test_fixed_windows_of_bounded_keys(spark, tmp_path, most_keys, shards):
    rng = random.Random(9)
    seconds = rng.sample(range(2000), 300)
    requests = [(START + timedelta(seconds=s), f"ip{rng.randint(0, 12)}") for s in seconds]
    parts = [[(name, at) for at, name in requests[k::3]] for k in range(3)] + [[("end", minutes(10_000))]]
    got, held = run(spark, tmp_path, parts, "name string, at timestamp", lambda s: state.fixed_window_limited(s, "name", "at", 60, 2, most_keys, shards, watermark="2 hours"))
    want = limited(requests, 60, 2, most_keys)
    assert sorted((r["name"], r["at"], r["accepted"]) for r in got if r["name"] != "end") == want and {x[2] for x in want} == {True, False}
    assert held[-1] <= 6


def test_windows_held_stay_bounded(spark, tmp_path):
    """Thousands of keys within one window: no more than the bound is held after any batch."""
    parts = [[(f"ip{k}", START + timedelta(seconds=b * 40 + k / 100)) for k in range(b * 400, b * 400 + 400)] for b in range(4)]
    got, held = run(spark, tmp_path, parts, "name string, at timestamp", lambda s: state.fixed_window_limited(s, "name", "at", 3600, 1, 50, 1, watermark="1 second"))
    assert len(got) > 1000 and all(r["accepted"] for r in got)
    # Windows, what still waits for the watermark, and timers, which Spark keeps twice.
    assert held[-1] < 4 * (400 + 50)
