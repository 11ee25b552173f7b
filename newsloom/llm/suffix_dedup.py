"""Suffix-array dedup: removes every byte that a repeated string of `width` bytes covers, over all documents.

1. Filter, without loss. In every window of `width` bytes the k-gram with the smallest hash is an anchor, so equal
   windows have equal anchors. Only what lies within a window of an anchor that the corpus has twice can be repeated.
2. Shards of about `shard_bytes` of such segments. Each builds its suffix array in numpy by Larsson-Sadakane refinement
   (ranks of 8-byte prefixes, then groups still unsorted by the ranks one prefix length further on, doubled each
   round), then the common prefixes of neighbours by Kasai's walk through the text, many stretches at once.
   A neighbour with a common prefix of `width` or more is a repeat within the shard.
3. Cross-shard merging. Every shard sends one fingerprint of each of its distinct windows, sorted, to the fingerprint's
   range. A range merges the sorted runs of all shards and finds by binary search which of a run's windows stand in the
   runs of others; the answer is a bit for each. Fingerprints have 64 bits, and the range is chosen by others, up to 24.

Equal texts are taken once with their number, so a group of copies can hold any share of all rows. All shuffles are of
anchors, fingerprints and single texts, by hash; nothing is gathered by document group.

Edge cases: null texts are empty; texts shorter than `width` lose nothing; a text that stands twice (repeated rows
too) is removed whole if it has `width` bytes; matches never cross texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import bound_batches, discard, materialized, packed_sorted, release, unpacked_sorted

BLOCK = 1 << 20
SEPARATOR = 0xFF  # no byte of UTF-8


@lru_cache(maxsize=2)
def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2 to the 64th. Workers keep two pairs of them."""
    base = int.from_bytes(hashlib.sha256(b"base").digest()[:8], "little") | 1
    power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length, b, np.uint64)]))
    return power(base), power(pow(base, -1, 1 << 64))


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    """Random values of bytes."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8] for i in range(256)), np.uint64)


def window_hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every k bytes in a row."""
    value, (power, inverse) = byte_values(seed), powers(1 << max(21, int(len(data)).bit_length()))
    n = len(data) - k + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[: len(data)], dtype=np.uint64)])
    h = (sums[k:] - sums[:n]) * inverse[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the leftmost smallest of a window of `width` bytes."""
    w = width - k + 1
    places, hashes = [], []
    for start in range(0, max(0, len(data) - width + 1), BLOCK - w):
        h = window_hashes(data[start : start + BLOCK + k - 1], k, 1)
        if len(h) < w:
            break
        # The place in the low bits: the smallest tells its place, and the leftmost of equal ones is taken.
        mark = (h & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate([mark, np.full(-len(mark) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        least = np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64(BLOCK - 1)
        at = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])]).astype(np.int64)
        places.append(at + start)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by Larsson-Sadakane refinement: at most log2(n / 8) rounds."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.zeros(n + 1, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1] + 1  # rank: where the group begins, from 1
    rank[order] = group
    slots = np.arange(n)
    h = 8
    while True:
        # Only groups of two and more are sorted further.
        edge = np.concatenate([new, [True]])
        alone = edge[:-1] & edge[1:]
        slots, group = slots[~alone], group[~alone]
        if not len(slots):
            return order
        at = order[slots]
        key = (group << 32) | rank[np.minimum(at + h, n)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = slots[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        rank[at] = group
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int, stretch: int = 128) -> np.ndarray:
    """By place, min(width, common prefix with the suffix before it in order). Kasai: a place's is at least its left
    neighbour's less one. Stretches of the text are walked side by side."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    # Beyond the end nothing is equal: the text is padded with the separator, which the comparison stops at.
    padded = np.concatenate([data, np.full(width + 16, SEPARATOR, np.uint8)])
    m = len(padded) - 8
    key = np.zeros(m, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + m]
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, stretch)
    length = np.zeros(len(starts), np.int64)
    for step in range(stretch):
        i = starts + step
        here = np.flatnonzero(i < n)
        i = i[here]
        j = before[i]
        l = np.maximum(length[here] - 1, 0)  # noqa: E741
        l[j < 0] = 0
        live = np.flatnonzero(j >= 0)
        while len(live):  # eight bytes at a time
            live = live[l[live] < width]
            equal = key[np.minimum(i[live] + l[live], m - 1)] == key[np.minimum(j[live] + l[live], m - 1)]
            live = live[equal]
            l[live] += 8
        live = np.flatnonzero((j >= 0) & (l < width))
        for _ in range(7):  # then single bytes
            equal = padded[np.minimum(i[live] + l[live], n + width)] == padded[np.minimum(j[live] + l[live], n + width)]
            live = live[equal]
            l[live] += 1
        length[here] = l
        out[i] = np.minimum(l, width)
    return out


def shards(texts: DataFrame, width: int, k: int, shard_bytes: int) -> DataFrame:
    """texts: k1, k2, text, places (of repeated anchors). A row for every shard: its segments one after another, where
    each begins and comes from, and the bits of windows that repeat in the shard and that stand for their equals."""

    def finish(number: int, parts: list[tuple[int, int, int, bytes]]) -> dict:
        data = np.frombuffer(b"".join(p[3] + b"\xff" for p in parts), np.uint8)
        offsets = np.cumsum([0] + [len(p[3]) + 1 for p in parts])[:-1]
        order = suffix_array(data)
        shared = common_prefixes(data, order, width) >= width
        valid = valid_windows(len(data), offsets, np.array([len(p[3]) for p in parts]), width)
        again = np.zeros(len(data), bool)
        again[order[1:][shared[order[1:]]]] = True
        head = valid & ~again  # the first of each group of equal windows
        again[order[:-1][shared[order[1:]]]] = True
        again &= valid
        return {
            "shard": number, "data": data.tobytes(), "offsets": offsets.tolist(), "k1": [p[0] for p in parts], "k2": [p[1] for p in parts], "starts": [p[2] for p in parts],
            "repeated": np.packbits(again).tobytes(), "heads": np.packbits(head).tobytes(), "n_heads": int(head.sum()),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for k1, k2, text, places in zip(batch["k1"], batch["k2"], batch["text"], batch["places"], strict=True):
                body = text.encode()
                for a, b in segments(np.unique(np.asarray(places, np.int64)), len(body), width, k):
                    parts.append((k1, k2, a, body[a:b]))
                    held += b - a
                    if held >= shard_bytes:
                        yield pd.DataFrame([finish(number, parts)])
                        number, parts, held = number + 1, [], 0
        if parts:
            yield pd.DataFrame([finish(number, parts)])

    return texts.mapInPandas(
        run, "shard long, data binary, offsets array<long>, k1 array<long>, k2 array<long>, starts array<long>, repeated binary, heads binary, n_heads long"
    )


def segments(places: np.ndarray, n: int, width: int, k: int, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """The union of all windows that hold one of the anchors, in pieces that overlap by less than a window."""
    a, b = np.maximum(places - (width - k), 0), np.minimum(places + width, n)
    first = np.concatenate([[True], a[1:] > b[:-1]])
    for x, y in zip(a[first].tolist(), b[np.concatenate([first[1:], [True]])].tolist(), strict=True):
        for z in range(x, y - width + 1, most):
            yield z, min(y, z + most + width - 1)


def valid_windows(n: int, offsets: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Places whose window lies within one segment."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, offsets, 1)
    np.add.at(edge, offsets + np.maximum(lengths - width + 1, 0), -1)
    return np.cumsum(edge[:-1]) > 0


def sent(data: np.ndarray, heads: np.ndarray, width: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows that stand for their equals, their fingerprints and ranges, in the order of both."""
    places = np.flatnonzero(heads)
    prints = window_hashes(data, width, 2)[places]
    to = (window_hashes(data, width, 3)[places] >> np.uint64(40)).astype(np.int64) % ranges
    order = np.lexsort((prints, to))
    return places[order], prints[order], to[order]


def bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def repeated_spans(docs: DataFrame, width: int = 400, k: int = 32, shard_bytes: int = 2_000_000, range_windows: int = 2_000_000, tables: list[DataFrame] | None = None) -> DataFrame:
    """k1, k2, copies, spans (start, length of removed bytes, sorted): texts that lose bytes. docs: k1, k2, text.

    tables: a list that gets the tables which the result reads.
    """
    bound_batches(docs.sparkSession)
    n_bytes = F.octet_length("text")
    long_enough = docs.where(n_bytes >= width)
    copies = long_enough.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, second, hashes, places = [], [], [], []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                at, h = anchors(np.frombuffer(text.encode(), np.uint8), width, k)
                order = np.argsort(h, kind="stable")
                value, begin = np.unique(h[order], return_index=True)
                first += [k1] * len(value)
                second += [k2] * len(value)
                hashes += value.view(np.int64).tolist()
                places += np.split(at[order], begin[1:]) if len(value) else []
            yield pd.DataFrame({"k1": first, "k2": second, "h": hashes, "places": places})

    # A row for a text and hash, however often the text has it; copies of a text count once.
    found = long_enough.mapInPandas(marked, "k1 long, k2 long, h long, places array<long>")
    found = found.groupBy("h", "k1", "k2").agg(F.first("places").alias("places"))
    often = found.groupBy("h").agg(F.sum(F.size("places")).alias("n")).where("n > 1").drop("n")
    wanted = found.join(often, "h", "left_semi").groupBy("k1", "k2").agg(F.flatten(F.collect_list("places")).alias("places"))
    # Written, its size is known: Spark sends it to the tasks if it is small, and else shuffles the texts to it.
    wanted = materialized(wanted)
    texts = long_enough.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("places").alias("places"))
    table = materialized(shards(texts, width, k, shard_bytes))
    discard(wanted)
    release(docs.sparkSession)
    if tables is not None:
        tables.append(table)
    total = table.agg(F.coalesce(F.sum("n_heads"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // range_windows))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, blob, heads in zip(batch["shard"], batch["data"], batch["heads"], strict=True):
                data = np.frombuffer(blob, np.uint8)
                _, prints, to = sent(data, bits(heads, len(data)), width, ranges)
                ends = np.searchsorted(to, np.arange(ranges + 1))
                runs = [(r, shard, packed_sorted(prints[ends[r] : ends[r + 1]])) for r in np.unique(to).tolist()]
                yield pd.DataFrame(runs, columns=["range", "shard", "prints"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        runs = [unpacked_sorted(p) for p in group["prints"]]
        merged = np.sort(np.concatenate(runs), kind="stable")
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        if not len(twice):
            return pd.DataFrame({"shard": [], "range": [], "bits": []})
        found = [twice[np.minimum(np.searchsorted(twice, r), len(twice) - 1)] == r for r in runs]
        return pd.DataFrame({"shard": group["shard"], "range": group["range"], "bits": [np.packbits(f).tobytes() for f in found]})

    answers = (
        table.select("shard", "data", "heads").mapInPandas(send, "range long, shard long, prints binary").groupBy("range").applyInPandas(merge, "shard long, range long, bits binary")
    )

    def close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        data = np.frombuffer(row["data"], np.uint8)
        again = bits(row["repeated"], len(data))
        places, _, to = sent(data, bits(row["heads"], len(data)), width, ranges)
        ends = np.searchsorted(to, np.arange(ranges + 1))
        for r, blob in zip(right["range"], right["bits"], strict=True):
            at = places[ends[r] : ends[r + 1]]
            again[at[bits(blob, len(at))]] = True
        starts = np.flatnonzero(again)
        if not len(starts):
            return pd.DataFrame({"k1": [], "k2": [], "start": [], "length": []})
        first = np.concatenate([[True], starts[1:] > starts[:-1] + width])
        a, b = starts[first], starts[np.concatenate([first[1:], [True]])] + width
        part = np.searchsorted(row["offsets"], a, side="right") - 1
        origin = lambda c: np.asarray(row[c])[part]
        return pd.DataFrame({"k1": origin("k1"), "k2": origin("k2"), "start": origin("starts") + a - np.asarray(row["offsets"])[part], "length": b - a})

    spans = table.drop("n_heads").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(close, "k1 long, k2 long, start long, length long")
    found = maximal(spans)
    return copies.join(found, ["k1", "k2"], "left").where((F.col("copies") > 1) | F.col("spans").isNotNull())


def maximal(spans: DataFrame) -> DataFrame:
    """k1, k2, spans: spans that touch or overlap as one, sorted. spans: k1, k2, start, length."""
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("k1", "k2").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spans.withColumn("apart", F.coalesce(F.col("start") > F.max(end).over(before), F.lit(True)).cast("int"))
    run = F.sum("apart").over(Window.partitionBy("k1", "k2").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, 0))
    joined = ahead.withColumn("run", run).groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    return joined.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length")))).alias("spans"))


@F.pandas_udf(T.BinaryType())
def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """The bytes of each text outside its removed spans; null texts stay null."""

    def cut(text: str | None, spans: np.ndarray) -> bytes | None:
        if text is None:
            return None
        body, at, kept = text.encode(), 0, []
        for span in spans:
            kept.append(body[at : span["start"]])
            at = span["start"] + span["length"]
        return b"".join([*kept, body[at:]])

    return pd.Series([cut(t, s) for t, s in zip(texts, removed, strict=True)], dtype=object)


def suffix_dedup(docs: DataFrame, text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """docs with n_bytes, removed (start and length of each maximal removed run) and kept (the other bytes).

    Building it runs jobs: anchors, shards and the removed spans are written in the shared folder.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    kept: list[DataFrame] = []
    found = repeated_spans(docs.select(k1.alias("k1"), k2.alias("k2"), body.alias("text")), tables=kept, **options)
    # Written, so that only a large table of spans makes the documents meet it by a shuffle.
    found = materialized(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("copies").alias("_copies"), F.col("spans").alias("_spans")))
    for used in kept:
        discard(used)
    release(docs.sparkSession)
    joined = docs.drop("n_bytes", "removed", "kept").withColumns({"_k1": k1, "_k2": k2}).join(found, ["_k1", "_k2"], "left")
    n = F.octet_length(body).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("length")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    joined = joined.withColumn("n_bytes", n).withColumn("removed", F.when(F.col("_copies") > 1, whole).when(F.col("_spans").isNotNull(), F.col("_spans")).otherwise(none))
    # Only texts that lose bytes go to Python.
    cut = without(F.when((F.size("removed") > 0) & (F.coalesce(F.col("_copies"), F.lit(0)) <= 1), F.col(text)), F.col("removed"))
    joined = joined.withColumn("kept", F.coalesce(cut, F.when(F.col("_copies") > 1, F.lit(b"")).otherwise(body.cast("binary"))))
    return joined.drop("_k1", "_k2", "_copies", "_spans")


def digest(deduped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return deduped.select(
        F.col(doc_id).alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
