"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators between words.
SPACES = " \t\n\x0b\x0c\r"
#: A maximal run of other characters is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Batches of rows go to Python with at most so many bytes, however long their texts are; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or int(now) > limit or int(now) <= 0:
        spark.conf.set(key, f"{limit}b")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a temporary one, which only a local session can use."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences, whose high bytes are mostly zero, byte by byte."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_sorted(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def materialized(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df as a table in the shared folder, in buckets of a key, and read it: grouping by the key doesn't shuffle it."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", f"{checkpoint_dir(spark)}/table-{name}").saveAsTable(name)
    return spark.table(name)


def drop_bucketed(df: DataFrame) -> None:
    """Deletes a table that `bucketed` wrote and that nothing will read again."""
    names = {f.rsplit("/", 2)[1].removeprefix("table-") for f in df.inputFiles()}
    discard(df)
    for name in names:
        if name.startswith("bucketed_"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are written: it does so when the driver's garbage goes, and
    Python's frames, some of them in cycles, hold theirs until it is collected too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table that `materialized` wrote and that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
