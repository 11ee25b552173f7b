"""Best-fit packing by sums of squares: a document goes where the squared counts of open bins per residual gap become
smallest.

Texts are tokenized whole; a document's ids end with `end_id`. A document longer than `capacity` is cut from its end
into full pieces, so only its first piece is shorter. Full pieces are sequences of their own. All other pieces are dealt
by a hash into shards of about `shard_pieces`, each packed by itself, so no task holds more than that many rows of a few
numbers, and a shard leaves at most a few open sequences.

Edge cases: null and empty texts are the end id alone; repeated rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, materialized

SPACE_RUN = re.compile(r" \s")
#: The only added token of byte_bpe_50k.json, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256


class PartIds(dict):
    """The ids of ' ' + part as little-endian unsigned 32-bit numbers, filled on demand and bounded."""

    def __init__(self, path: str, most: int = 120_000) -> None:
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.encode(" " + part)
        if len(part) <= 40:
            self[part] = found
        return found

    def with_added(self, text: str) -> bytes:
        """The ids of a text in which the added token has its own id, as the tokenizer gives them."""
        return np.array([ADDED_ID], "<u4").tobytes().join(self.text(x) if x else b"" for x in text.split(ADDED))

    def text(self, text: str) -> bytes:
        """The ids of a text. The tokenizer's pattern lets no token cross a space that isn't beside other white space."""
        if SPACE_RUN.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=1)
def part_ids(path: str) -> PartIds:
    """One for a worker process, whose tasks share it."""
    return PartIds(path)


def pieces_of(docs: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids (little-endian, binary) if asked for.

    added_tokens: the string of the tokenizer's added token is that token, else ordinary text.
    """
    path = tokenizer or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bound_batches(docs.sparkSession)
    # Ids go through Python as strings, which nulls and large numbers don't change.
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = part_ids(path)
        encode = known.with_added if added_tokens else known.text
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(value) if isinstance(value, str) else b"") + end
                n, at, k = len(ids) // 4, 0, 0
                length = n % capacity or capacity
                while at < n:
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((key, k, at, length, zlib.crc32(part), part if keep_ids else None))
                    at, k, length = at + length, k + 1, capacity
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield out if keep_ids else out.drop(columns="ids")

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"
    return slim.mapInPandas(run, schema + ", ids binary" * keep_ids).withColumn("doc_id", F.col("doc_id").cast(kind))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, in the order given. counts[g]: open bins with the residual gap g."""
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        # Half the change of the sum when a bin of gap g becomes one of gap g - s; closed bins don't count.
        change = counts[: capacity + 1 - s] - counts[s:] + 1.0
        change[0] = 0.5 - counts[s]
        change[counts[s:] == 0] = np.inf
        best = int(change.argmin())
        gap = best + s
        if change[best] == np.inf or (gap != s and counts[capacity - s] + 0.5 < change[best]):
            at, gap = made, capacity
            made += 1
        else:
            at = open_bins[gap].pop()
            counts[gap] -= 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 200_000) -> DataFrame:
    """pieces (doc_id, piece, length and others; lengths from 1 to capacity) with sequence_id and offset."""
    kind, pieces = pieces.schema["doc_id"].dataType, materialized(pieces.withColumn("doc_id", F.col("doc_id").cast("string")))
    small = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-small.count() // shard_pieces))
    columns = pieces.columns

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=bins * shards + group.pop("shard"), offset=offsets)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return dealt.groupBy("shard").applyInPandas(packed, schema).unionByName(full).withColumn("doc_id", F.col("doc_id").cast(kind))
