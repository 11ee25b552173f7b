"""The table sink: every write is lost in turn, and batches come again."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from newsloom.operators.relational import merge_upsert
from newsloom.sources import sink, tables
from newsloom.streaming import jobs


@pytest.fixture
def name(spark, tmp_path):
    table = f"sink_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (k INT, v STRING) USING parquet LOCATION '{tmp_path}/rows'")
    spark.sql(f"INSERT INTO {table} VALUES (1, 'a'), (2, 'b')")
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def rows(spark, name):
    return sorted((r["k"], r["v"]) for r in spark.table(name).collect())


OLD, NEW = [(1, "a"), (2, "b")], [(1, "A"), (2, "B")]


def upper(old):
    return old.withColumn("v", F.upper("v"))


@pytest.mark.parametrize("step, when, left", [
    ("_stage", "before", OLD), ("_stage", "after", OLD), ("_note", "before", OLD), ("_note", "after", OLD),
    ("_switch", "before", OLD), ("_switch", "after", NEW), ("_clean", "before", NEW),
])
def test_a_lost_write_leaves_the_old_or_the_new_rows(spark, name, monkeypatch, step, when, left):
    whole = getattr(sink, step)

    def lost(*args):
        if when == "after":
            whole(*args)
        raise OSError("lost")

    monkeypatch.setattr(sink, step, lost)
    with pytest.raises(OSError, match="lost"):
        sink.publish(upper(spark.table(name)), name, "s", 7)
    assert rows(spark, name) == left
    assert sink.applied(spark, name) == ({"s": 7} if left == NEW else {})
    monkeypatch.setattr(sink, step, whole)
    # The job that comes again ends as if nothing had happened, and leaves two versions at most.
    sink.merge_batches(name, "s", lambda table, batch: upper(table))(spark.range(0), 7)
    assert rows(spark, name) == NEW and sink.applied(spark, name) == {"s": 7}
    root = sink.described(spark, name)["Location"].removeprefix("file:").rsplit("/", 1)[0]
    import os

    versions = [f for f in os.listdir(root) if sink.VERSION in f]
    assert len(versions) <= 3
    sink.publish(spark.table(name), name)
    assert len([f for f in os.listdir(root) if sink.VERSION in f]) <= 2 and rows(spark, name) == NEW and sink.applied(spark, name) == {"s": 7}


def test_a_failing_task_loses_nothing(spark, name):
    bad = lambda old: old.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("task lost"))).otherwise(F.col("v")).cast("string"))
    with pytest.raises(Exception, match="task lost"):
        tables.rewrite(spark, name, bad)
    assert rows(spark, name) == OLD
    tables.rewrite(spark, name, upper)
    tables.rewrite(spark, name, lambda old: old.where("k = 1"))
    assert rows(spark, name) == NEW[:1]
    spark.sql(f"INSERT INTO {name} VALUES (9, 'z')")
    assert rows(spark, name) == [(1, "A"), (9, "z")]


def test_another_writer_is_told(spark, name):
    seen = sink.described(spark, name)["Location"]
    sink.publish(upper(spark.table(name)), name)
    with pytest.raises(RuntimeError, match="another writer"):
        sink._switch(spark, name, seen, f"{seen}-x")
    assert rows(spark, name) == NEW


def test_managed_and_partitioned_tables(spark):
    managed, parts = f"m_{uuid.uuid4().hex}", f"p_{uuid.uuid4().hex}"
    spark.range(4).withColumn("v", F.lit("x")).write.saveAsTable(managed)
    tables.rewrite(spark, managed, lambda old: old.where("id < 2"))
    assert spark.table(managed).count() == 2
    spark.range(4).withColumn("v", F.lit("x")).write.partitionBy("v").saveAsTable(parts)
    with pytest.raises(ValueError, match="partitions"):
        tables.rewrite(spark, parts, lambda old: old)
    for t in (managed, parts):
        spark.sql(f"DROP TABLE {t}")


def test_streams_apply_each_batch_once(spark, name, tmp_path):
    """A stream of merges equals one merge; the same batch handed over again by hand changes nothing, for either stream."""
    source = tmp_path / "in"
    for k, part in enumerate([[(1, "x", 1), (3, "c", 2)], [(3, "d", 3)], [(2, "y", 4), (4, "e", 5)]]):
        spark.createDataFrame(part, "k int, v string, ordinal int").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("k int, v string, ordinal int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    handle = sink.merge_batches(name, "items", lambda table, batch: merge_upsert(table, batch, ["k"], "ordinal").select("k", "v"))
    jobs.each_batch(stream, handle, f"{tmp_path}/checkpoint").awaitTermination()
    want = [(1, "x"), (2, "y"), (3, "d"), (4, "e")]
    last = sink.applied(spark, name)["items"]
    assert rows(spark, name) == want and last == 2
    again = spark.createDataFrame([(1, "old", 9)], "k int, v string, ordinal int")
    handle(again, last)
    handle(again, 0)
    assert rows(spark, name) == want
    sink.merge_batches(name, "other", lambda table, batch: merge_upsert(table, batch, ["k"], "ordinal").select("k", "v"))(again, 0)
    assert rows(spark, name)[0] == (1, "old") and sink.applied(spark, name) == {"items": 2, "other": 0}
