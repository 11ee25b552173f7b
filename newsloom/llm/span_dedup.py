"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, equal runs are
joined over the whole corpus, and the sentences that a non-first repeated run covers are removed.

A sentence ends after `.`, `!` or `?` and white space, or at a line's end; it keeps the white space after it, so the
sentences of a text joined are the text. Runs are compared by their words: case and white space don't count. From every
sentence starts one run, the shortest of `length` sentences or more that has `min_words` words or more: a passage of long
sentences is found by few of them, and one of one-word sentences by as many as make up a passage. The first run is the
one with the smallest document id, then the smallest position.

Only hashes and positions are shuffled for the search: per distinct hash one pre-aggregated row, and, if the repeated ones
are too many to be sent to all tasks, a join whose large keys Spark can split. Texts are shuffled once, to meet what is removed from them.

Edge cases: null texts stay null, have no sentences and lose none; a text too short for a run from its first sentence has
one run, the whole; repeated rows with one id are told apart by their text and, if that is equal too, lose the same; null ids sort
first; U+0001 in a text is a sentence boundary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import SPACES, bound_batches, materialized

MARK = "\x01"
BOUNDARY = r"([.!?][ \t\n\x0B\f\r]+|\n+)"
PARTS_END, PARTS = re.compile(BOUNDARY), re.compile(MARK)


def sentences(text: Column) -> Column:
    """The sentences of a text, white space included; the same ones joined are the text."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), BOUNDARY, "$1" + MARK), MARK), lambda s: s != "")


def runs_of(text: str, length: int, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """at, n, h1, h2 of every run of a text."""
    parts = [p.strip(SPACES).lower().encode() for p in PARTS.split(PARTS_END.sub(r"\g<0>" + MARK, text)) if p]
    counts = [max(1, len(p.split())) for p in parts]
    end = held = 0  # of the run: its sentences are parts[at:end], with `held` words
    for at in range(len(parts)):
        while end < len(parts) and (end - at < length or held < min_words):
            held += counts[end]
            end += 1
        if end - at < length or held < min_words:
            if at:  # nor does any later sentence start one
                return
        d = xxhash.xxh128_digest(b" ".join(parts[at:end]))
        yield at, end - at, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
        held -= counts[at]


def runs(docs: DataFrame, length: int = 2, min_words: int = 20) -> DataFrame:
    """doc_id, text_hash, at, n (sentences), h1, h2: a row for every run. docs: doc_id, text_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                rows += (mine := list(runs_of(text, length, min_words)))
                row += [k] * len(mine)
            at, n, h1, h2 = np.array(rows, np.int64).reshape(-1, 4).T
            keys = batch.select(["doc_id", "text_hash"]).take(pa.array(row, pa.int64()))
            yield pa.record_batch([*keys.columns, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h1), pa.array(h2)], ["doc_id", "text_hash", "at", "n", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.where(F.col("text") != "").select("doc_id", "text_hash", "text")
    return slim.mapInArrow(run, f"doc_id {kind}, text_hash long, at int, n int, h1 long, h2 long")


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 2, min_words: int = 20) -> DataFrame:
    """doc_id, n_sentences, n_removed, text: each document without its removed sentences.

    Building it runs a job, which writes the first place of each repeated run.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = runs(slim, length, min_words)
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col("at").alias("at"))
    # The count of rows and the first of each hash; most hashes stand once and go.
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    first = materialized(first)  # its size is known then: if it is small, the runs meet it where they are
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "text_hash").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("gone")
    )
    joined = slim.join(
        gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
        "left",
    )
    gone_at = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    # What stays is told by sets of places, so a long text takes time in proportion to its sentences.
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    return joined.withColumn("parts", sentences(F.col("text"))).select(
        "doc_id",
        F.size("parts").cast("long").alias("n_sentences"),
        F.size(gone_at).cast("long").alias("n_removed"),
        F.when(F.size(gone_at) == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "")).alias("text"),
    )


ORACLE = r"""
WITH parts AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t\n\x0B\f\r]+|\n+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM documents
), plain AS (SELECT doc_id, list_transform(p, lambda s: lower(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS s FROM parts WHERE len(p) > 0),
lens AS (SELECT doc_id, s, list_transform(s, lambda x: len(string_split_regex(x, '[\x20\x09-\x0D]+'))) AS c FROM plain),
starts AS (SELECT doc_id, s, c, unnest(range(len(s))) AS at_ FROM lens),
ends AS (SELECT doc_id, s, at_, list_filter(range(2, 21), lambda k: at_ + k <= len(s) AND list_sum(c[at_ + 1 : at_ + k]) >= 20)[1] AS k FROM starts),
runs AS (SELECT doc_id, at_, coalesce(k, len(s)) AS n, array_to_string(s[at_ + 1 : at_ + coalesce(k, len(s))], ' ') AS run FROM ends WHERE k IS NOT NULL OR at_ = 0),
firsts AS (SELECT run, min((doc_id, at_)) AS f FROM runs GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(at_, at_ + n)) AS i FROM runs JOIN firsts USING (run) WHERE (doc_id, at_) <> f),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, len(p)::BIGINT AS n_sentences, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(p, lambda s, i: NOT list_contains(g, i - 1)), '') END AS text
FROM parts LEFT JOIN lists USING (doc_id)
"""
