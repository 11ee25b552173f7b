"""Cross-tokenizer alignment by segment deduplication.

Both tokenizers see a space and the text: byte-level BPE (A) as such, piece BPE (B) through the space that it adds itself. The
bytes are cut into segments before runs of white space, but only where neither vocabulary can merge across: no entry of
either has a character that isn't white space followed by the one that begins the run (`safe_spaces`, read from the
vocabularies), and A's pattern also ends a part there. So a segment's tokens are the same wherever it stands. Distinct
segments are tokenized and aligned once, by Spark's tasks, and joined back.

Steps: `encode` cuts texts into chunks of about `chunk_chars` characters, documents as numbers of the chunk's own distinct
segments, which go to ranges of hashes as compressed lists; `align` makes the distinct segments of a range, aligns each
once, and answers each chunk. Chunks then count in how many documents each pair of ids is linked; the pairs of a range
meet the corpus's counts, the range's segments get their sums, and chunks compose their documents. What is shuffled is a
compressed list for each chunk and range; texts are read once and never shuffled, nor are the documents, which lie in
buckets of chunks. Hashes only choose the range: segments are compared as they are.

Bytes of a token: A's entry by the byte-level alphabet; B's piece in UTF-8 with U+2581 as a space, byte pieces as their byte.
Where tokens of both end is the end of a group; all pairs of a group's tokens are linked.

Edge cases: null and empty texts, and texts whose tokens don't spell their bytes (B takes U+2581 for a space), have no
tokens: zeros and no hash. Strings of special tokens are ordinary text. Texts without white space are one segment. Ids of
any simple type, null ids too; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored.

Bounds: a call holds a chunk, which is `chunk_chars` characters and one document more at most, and the alignments of its
segments; or the segments of a range, of which there is one for each `range_chars` characters of the corpus. Pairs of
a group are kept as distinct pairs with their numbers.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.llm.common import bound_batches, bucketed, materialized, release

BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if BYTE_PIECE.fullmatch(p) else p.replace(SPACE, " ").encode() for p in pieces]
        entries = [x.decode("utf-8", "replace") for x in self.bytes_a] + [p.replace(SPACE, " ") for p in pieces]
        self.spaces = safe_spaces(entries)
        # A line feed before a segment keeps B from adding a space to it, as no piece has more than the line feed.
        if any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("a piece merges line feeds with other characters")
        self.lead = len(self.b.encode("\n"))
        spaces = re.escape(self.spaces)
        self.segments = re.compile(rf"\s*\S*(?:[^\S{spaces}]\s*\S*)*").findall

    def align(self, segments: list[str]) -> list[tuple]:
        """For each segment: n_a, n_b, n_groups, n_links, groups, linked pairs and their numbers; None if its tokens don't spell it."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self.b.encode(["\n" + s for s in segments], num_threads=1)
        return [self.aligned(s.encode(), a, b[self.lead :]) for s, a, b in zip(segments, ids_a, ids_b, strict=True)]

    def aligned(self, said: bytes, a: list[int], b: list[int]) -> tuple | None:
        of_a, of_b = [self.bytes_a[k] for k in a], [self.bytes_b[k] for k in b]
        if b"".join(of_a) != said or b"".join(of_b) != said:
            return None
        groups, pairs, links, at_a, at_b = [], {}, 0, 0, 0
        i = j = first_a = first_b = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(of_a[i])
                i += 1
            else:
                at_b += len(of_b[j])
                j += 1
            if at_a == at_b:
                one, two = a[first_a:i], b[first_b:j]
                groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
                links += len(one) * len(two)
                if len(one) * len(two) <= 16:
                    for x in one:
                        for y in two:
                            pairs[x << 32 | y] = pairs.get(x << 32 | y, 0) + 1
                else:
                    for x, n in Counter(one).items():
                        for y, m in Counter(two).items():
                            pairs[x << 32 | y] = pairs.get(x << 32 | y, 0) + n * m
                first_a, first_b = i, j
        return len(a), len(b), len(groups), links, ";".join(groups), list(pairs), list(pairs.values())


def safe_spaces(entries: list[str]) -> str:
    """The characters, of those that both tokenizers take for white space, that no entry has after one that isn't."""
    return "".join(c for c in " \n\t\r" if not any(re.search(rf"\S{c}", e) for e in entries if c in e))


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One for a worker process, whose tasks share it."""
    return Pair(path_a, path_b)


class Numbers(dict):
    """Numbers for distinct segments, in order."""

    def __missing__(self, segment: str) -> int:
        self[segment] = k = len(self)
        return k


def packed(values: np.ndarray | list[int]) -> bytes:
    """Whole numbers from 0 on, byte by byte of as many bytes as they need, compressed."""
    values = np.asarray(values, np.int64)
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(len(values), 8)[:, :size].T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    size, raw = blob[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    out = np.zeros((raw.size // size, 8), np.uint8)
    out[:, :size] = raw.reshape(size, -1).T
    return out.view("<i8").ravel()


def packed_texts(texts: list[str]) -> bytes:
    """The texts' lengths in bytes and the texts."""
    raw = [t.encode() for t in texts]
    lengths = packed([len(t) for t in raw])
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unpacked_texts(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:4], "little")
    ends, raw = np.cumsum(unpacked(blob[4 : 4 + n])).tolist(), zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, paths: tuple[str, str], chunk_chars: int, ranges: int) -> DataFrame:
    """chunk and, for each range of its segments, range, ks and segments, or for each of its documents, doc_id and codes,
    the ks of its segments."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("ks", pa.binary()), ("segments", pa.binary()), ("doc_id", to_arrow_type(kind)), ("codes", pa.binary())])

    def batch_of(number: int, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["chunk"] = pa.array(np.full(n, number))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def dealt(number: int, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
        """The chunk's segments by range, in order of their number."""
        segments = list(known)
        of = np.fromiter((xxhash.xxh64_intdigest(s) % ranges for s in segments), np.int64, len(segments))
        order = np.argsort(of, kind="stable")
        for ks in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            yield batch_of(number, range=pa.array([int(of[ks[0]])]), ks=pa.array([packed(ks)]), segments=pa.array([packed_texts([segments[k] for k in ks.tolist()])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pair(*paths).segments
        number, known, size = TaskContext.get().partitionId() << 32, Numbers(), 0
        for batch in batches:
            ids, codes, start = batch.column(0), [], 0
            for k, value in enumerate(batch.column(1)):
                text = value.as_py()
                codes.append(packed(list(map(known.__getitem__, filter(None, find(" " + text)))) if text else []))
                size += len(text or "")
                if size >= chunk_chars:
                    yield batch_of(number, doc_id=ids.slice(start, k + 1 - start), codes=pa.array(codes, pa.binary()))
                    yield from dealt(number, known) if known else ()
                    number, known, size, codes, start = number + 1, Numbers(), 0, [], k + 1
            if codes:
                yield batch_of(number, doc_id=ids.slice(start), codes=pa.array(codes, pa.binary()))
        if known:
            yield from dealt(number, known)

    return docs.mapInArrow(run, f"chunk long, range int, ks binary, segments binary, doc_id {kind.simpleString()}, codes binary")


#: What a chunk is told of its segments of a range, in order of their ks.
TOLD = ["spelt", "n_a", "n_b", "n_groups", "n_links", "sizes", "pairs", "groups"]


def align(encoded: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Of each range a row with the pairs of its distinct segments and their numbers (`pairs`, `times`, `sizes`), and of each
    chunk in it one with ks, the places of its segments among those, and TOLD."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        numbers, at = Numbers(), []
        for blob in rows["segments"]:
            at.append(np.fromiter(map(numbers.__getitem__, unpacked_texts(blob)), np.int64))
        segments, found = list(numbers), []
        for k in range(0, len(segments), 5000):
            found += pair(*paths).align(segments[k : k + 5000])
        bad = (0, 0, 0, 0, "", [], [])
        columns = list(zip(*(x or bad for x in found), strict=True))
        n, groups, pairs, times = [np.array(c, np.int64) for c in columns[:4]], columns[4], columns[5], columns[6]
        spelt, sizes = np.array([x is not None for x in found], np.int64), np.array([len(p) for p in pairs], np.int64)
        flat = lambda lists: np.array([x for one in lists for x in one], np.int64)
        all_pairs, begin = flat(pairs), np.cumsum(sizes) - sizes
        out = [(None, rows["range"].iloc[0], None, None, None, None, None, None, None, packed(sizes), packed(all_pairs), None, packed(flat(times)))]
        for chunk, ks, mine in zip(rows["chunk"], rows["ks"], at, strict=True):
            places = np.repeat(begin[mine] - np.cumsum(sizes[mine]) + sizes[mine], sizes[mine]) + np.arange(sizes[mine].sum())
            said = packed_texts([groups[k] for k in mine.tolist()])
            out.append((chunk, rows["range"].iloc[0], ks, packed(mine), packed(spelt[mine]), *(packed(x[mine]) for x in n), packed(sizes[mine]), packed(all_pairs[places]), said, None))
        return pd.DataFrame(out, columns=["chunk", "range", "ks", "at", *TOLD, "times"], dtype=object)

    sent = encoded.where(F.col("range").isNotNull()).select("chunk", "range", "ks", "segments")
    return sent.groupBy("range").applyInPandas(run, "chunk long, range int, ks binary, at binary, " + ", ".join(f"{c} binary" for c in TOLD) + ", times binary")


def documents_of(codes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All segment numbers of a chunk's documents, and each document's number of them."""
    parts = [unpacked(x) for x in codes]
    return np.concatenate([*parts, np.empty(0, np.int64)]), np.array([len(x) for x in parts], np.int64)


def per_document(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of values of these lengths."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.cumsum(lengths)
    return ends[at] - ends[at - lengths]


def placed(left: pd.DataFrame, name: str) -> np.ndarray:
    """A chunk's numbers by k, from those of its ranges."""
    ks = [unpacked(x) for x in left["ks"]]
    out = np.zeros(sum(map(len, ks)), np.int64)
    for at, blob in zip(ks, left[name], strict=True):
        out[at] = unpacked(blob)
    return out


def linked_documents(left: pd.DataFrame, right: pd.DataFrame, step: int = 400_000) -> pd.DataFrame:
    """pair, docs: in how many of a chunk's documents each pair of ids is linked. left: what it was told, right: documents.
    step: the segments of documents that are looked at together."""
    found, lengths = documents_of(right["codes"])
    sizes = placed(left, "sizes")
    begin = np.cumsum(sizes) - sizes
    pairs = np.zeros(sizes.sum(), np.int64)
    for ks, blob in zip(left["ks"], left["pairs"], strict=True):
        ks = unpacked(ks)
        pairs[np.repeat(begin[ks] - np.cumsum(sizes[ks]) + sizes[ks], sizes[ks]) + np.arange(sizes[ks].sum())] = unpacked(blob)
    good = per_document(1 - placed(left, "spelt")[found], lengths) == 0
    names, at = np.unique(pairs, return_inverse=True)
    docs, ends, a = np.zeros(len(names), np.int64), np.cumsum(lengths), 0
    while a < len(lengths):
        # Some documents at a time: what is kept of each is its distinct pairs.
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - lengths[a] + step, side="right")))
        part = found[ends[a] - lengths[a] : ends[b - 1]]
        doc = np.repeat(np.arange(b - a), lengths[a:b])
        once = np.unique(((doc << 32) | part)[good[a:b][doc]])
        doc, segment = once >> 32, once & 0xFFFFFFFF
        first, n = begin[segment], sizes[segment]
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique((np.repeat(doc, n) << 32) | at[places])
        docs += np.bincount(both & 0xFFFFFFFF, minlength=len(names))
        a = b
    return pd.DataFrame({"pair": names[docs > 0], "docs": docs[docs > 0]})


def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """chunk, ks, n_best, count_sum of the chunks of a range. left: chunks, and the range's own row; right: its pairs' counts."""
    own = left["chunk"].isna()
    sizes, pairs, times = (unpacked(left.loc[own, c].iloc[0]) for c in ("sizes", "pairs", "times"))
    order = np.argsort(right["pair"].to_numpy(np.int64))
    names = right["pair"].to_numpy(np.int64)[order]
    at = np.searchsorted(names, pairs)
    # Pairs of segments that only documents without tokens have are linked in none.
    known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == pairs) if len(names) else np.zeros(len(pairs), bool)
    pick = lambda c: np.where(known, right[c].to_numpy(np.int64)[order][np.minimum(at, len(names) - 1)], 0) if len(names) else np.zeros(len(pairs), np.int64)
    best, total = per_document(pick("best") * times, sizes), per_document(pick("docs") * times, sizes)
    rest = left[~own]
    mine = [unpacked(x) for x in rest["at"]]
    return pd.DataFrame({"chunk": rest["chunk"].astype("int64"), "ks": rest["ks"], "n_best": [packed(best[x]) for x in mine], "count_sum": [packed(total[x]) for x in mine]})


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SUMS = ["n_best", "count_sum"]


def composed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk. left: what it was told, with rows for COUNTS and groups and rows for SUMS; right: documents."""
    found, lengths = documents_of(right["codes"])
    told, sums = left[left["groups"].notna()], left[left["groups"].isna()]
    good = (per_document(1 - placed(told, "spelt")[found], lengths) == 0) & (lengths > 0)
    out = {c: np.where(good, per_document(placed(told if c in COUNTS else sums, c)[found], lengths), 0) for c in [*COUNTS, *SUMS]}
    groups = np.empty(sum(len(unpacked(x)) for x in told["ks"]), object)
    for ks, blob in zip(told["ks"], told["groups"], strict=True):
        groups[unpacked(ks)] = unpacked_texts(blob)
    ends = np.cumsum(lengths)
    digests = [hashlib.sha256(";".join(groups[found[e - n : e]]).encode()).hexdigest() if ok else "" for ok, n, e in zip(good, lengths, ends, strict=True)]
    return pd.DataFrame({"doc_id": right["doc_id"].to_numpy(), **out, "groups_sha256": digests})


def align_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None,
    chunk_chars: int = 16_000_000, range_chars: int = 8_000_000,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Building it runs jobs, which write tables.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the sum of those numbers over links.
    """
    paths = tokenizer_a or str(public_tokenizers.path("byte_bpe_50k.json")), tokenizer_b or str(public_tokenizers.path("piece_bpe_32k.model"))
    bound_batches(docs.sparkSession)
    spark, slim = docs.sparkSession, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, chars = slim.schema["doc_id"].dataType, slim.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    # Ids go through pandas as strings, which nulls and large numbers don't change.
    encoded = bucketed(encode(slim, paths, chunk_chars, max(1, -(-chars // range_chars))), "chunk", min(10_000, max(1, -(-2 * chars // chunk_chars))))
    texts = encoded.where(F.col("range").isNull()).select(F.col("chunk").alias("of_chunk"), F.col("doc_id").cast("string").alias("doc_id"), "codes")
    aligned = materialized(align(encoded, paths))
    release(spark)
    told = aligned.where(F.col("chunk").isNotNull())
    counts = told.select("chunk", "ks", "spelt", "sizes", "pairs").groupBy("chunk").cogroup(texts.groupBy("of_chunk")).applyInPandas(lambda left, right: linked_documents(left, right), "pair long, docs long")
    counts = materialized(counts.groupBy("pair").agg(F.sum("docs").alias("docs")))
    release(spark)
    of_a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(of_a).agg(F.max("docs").alias("most"))
    counts = counts.withColumn("a", of_a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))

    def own_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, blob in zip(batch["range"], batch["pairs"], strict=True):
                yield pd.DataFrame({"pair": np.unique(unpacked(blob))}).assign(of_range=r)

    wanted = aligned.where(F.col("chunk").isNull()).select("range", "pairs").mapInPandas(own_pairs, "of_range int, pair long")
    wanted = wanted.join(counts, "pair")
    sides = aligned.select("chunk", "range", "ks", "at", F.when(F.col("chunk").isNull(), F.col("sizes")).alias("sizes"), F.when(F.col("chunk").isNull(), F.col("pairs")).alias("pairs"), "times")
    sums = materialized(sides.groupBy("range").cogroup(wanted.groupBy("of_range")).applyInPandas(summed, "chunk long, ks binary, n_best binary, count_sum binary"))
    release(spark)
    told = told.select("chunk", "ks", "spelt", *COUNTS, "groups").unionByName(sums, allowMissingColumns=True)
    out = told.groupBy("chunk").cogroup(texts.groupBy("of_chunk")).applyInPandas(composed, "doc_id string, " + ", ".join(f"{c} long" for c in [*COUNTS, *SUMS]) + ", groups_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
