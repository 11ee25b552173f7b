"""A sink that replaces a catalog table's rows all at once, and takes each batch of a stream once.

The new rows are written to a folder of their own beside the table's; then one change of the catalog, ALTER TABLE .. SET
LOCATION, makes the name point to it. A job that is lost before that leaves the old rows, after that the new ones. With
the rows lies a ledger (`_ledger`, which readers of the folder skip) of the last batch of each stream that they hold, so
the switch publishes both together, and a batch that comes again, as streams may hand it over after a restart, changes
nothing. Rows stay plain files of the table's own format. A table has one writer at a time: one whose table another
has switched meanwhile fails without a change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = "__version-"


def described(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog says of a table: Location, Provider and others."""
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def applied(spark: SparkSession, name: str) -> dict[str, int]:
    """The last batch of each stream whose rows the table holds."""
    ledger = f"{described(spark, name)['Location'].rstrip('/')}/_ledger"
    path, fs = hadoop_path(spark, ledger)
    if not fs.exists(path):
        return {}
    return {r["stream"]: r["batch"] for r in spark.read.schema("stream string, batch long").json(ledger).collect()}


def _stage(rows: DataFrame, kind: str, folder: str) -> None:
    rows.write.format(kind).save(folder)


def _note(spark: SparkSession, ledger: dict[str, int], folder: str) -> None:
    spark.createDataFrame(sorted(ledger.items()), "stream string, batch long").coalesce(1).write.json(f"{folder}/_ledger")


def _switch(spark: SparkSession, name: str, seen: str, folder: str) -> None:
    if described(spark, name)["Location"] != seen:
        raise RuntimeError(f"another writer has switched {name}")
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


def _clean(spark: SparkSession, root: str, keep: set[str]) -> None:
    """Deletes earlier versions, and what lost jobs have left, but for those that queries may still read."""
    path, fs = hadoop_path(spark, root)
    versions, mark = fs.listStatus(path.getParent()), f"{path.getName()}{VERSION}"
    for status in versions:
        found = status.getPath()
        if found.getName().startswith(mark) and found.getName() not in keep:
            fs.delete(found, True)


def publish(rows: DataFrame, name: str, stream: str | None = None, batch: int | None = None) -> None:
    """The table's rows are those of `rows` from now on, which may be read from the table itself.

    stream, batch: noted with the rows as applied. The version before stays until the next one, for queries that read it.
    """
    spark = rows.sparkSession
    about = described(spark, name)
    if "# Partition Information" in about:
        raise ValueError("tables in partitions of their own locations can't be switched as one")
    seen = about["Location"]
    root = seen.rstrip("/").split(VERSION)[0]
    folder = f"{root}{VERSION}{uuid.uuid4().hex}"
    ledger = applied(spark, name) | ({stream: batch} if stream is not None else {})
    _stage(rows.select(*spark.table(name).columns), about["Provider"], folder)
    if ledger:
        _note(spark, ledger, folder)
    _switch(spark, name, seen, folder)
    _clean(spark, root, {folder.rsplit("/", 1)[1], seen.rstrip("/").rsplit("/", 1)[1]})


def merge_batches(name: str, stream: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler: the table becomes merged(table, batch's rows), once for each batch id of the stream."""

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if batch > applied(spark, name).get(stream, -1):
            publish(merged(spark.table(name), rows), name, stream, batch)

    return handle
