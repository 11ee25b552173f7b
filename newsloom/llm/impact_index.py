"""Ranked lexical search by a bit-sliced impact index.

What a term adds to a document's score, its impact, is a whole number that is known when the index is built. For each term
and block of documents, bitmap i holds bit i of the impacts, a bit for each document of the block. A query adds its terms'
bitmaps by bitwise arithmetic, all slices and 64 documents a machine word at once: full adders keep sums and carries apart
until the last term, and one ripple adds them. The k best of a block are found from the most significant slice down: a slice
splits the undecided documents, and either those with the bit are k at most and are taken, or the others go. Blocks return
at most k documents for a query, whose scores are exact, and Spark ranks those.

Tables: `counted` has the documents and postings of each block, `build_index` turns them into slices, `search` answers
items in batches against each block, so neither the documents nor the items have to fit anywhere. Only 64-document words in
which a term occurs are kept of its bitmaps.

Scores: terms are maximal matches of TERM with A-Z in lower case; N documents with a term, L terms in all, df documents with
the term, n terms of the document, tf of them the term. w = floor(1000 ln((2N + 2) / (2df + 1))), m = 100 - 25 + 25nN div L,
impact = w * (10^9 tf div (1000 tf + 12m)), once for each time the item has the term.

Edge cases: null and empty texts have no term; items without a term of the index have no rows; items with one id are ranked
row by row, as are documents; equal scores by ascending id, null ids last; empty tables give an empty result; other columns
are ignored.

Bounds: a block has up to `block` documents; slices are decompressed as they are used. The terms of the items are sent to
the tasks if they are at most `most_terms`; beyond that all terms are counted and joined with the items'.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.llm.common import bound_batches, discard, materialized

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of UTF-8 bytes: letters in lower case, digits and what isn't ASCII as they are, everything else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """The array of terms of a text, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"))


def counted(docs: DataFrame, doc_id: str, text: str, known: set[bytes] | None, block: int) -> DataFrame:
    """Of each block of documents a row with their ids, in order, and numbers of terms, and a row for each term's postings.

    known: the only terms whose postings are kept; all terms if None.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary())])

    def rows_of(number: int, ids: list, lengths: list[int], found: dict[bytes, array]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        n = np.array(lengths, np.int64)[order]
        out: list[tuple] = [(number, [ids[k] for k in order], n.tobytes(), int((n > 0).sum()), int(n.sum()), None, None, None)]
        for term, pairs in found.items():
            at, tf = np.array(pairs, np.uint32).reshape(-1, 2).T
            at = place[at]
            sort = np.argsort(at)
            both = np.stack([at[sort].astype("<u4"), tf[sort].astype("<u4")])
            out.append((number, None, None, None, None, term.decode(), len(at), both.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, lengths, found = TaskContext.get().partitionId() << 32, [], [], defaultdict(lambda: array("I"))
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (value.as_py() or "").encode().translate(TERM_BYTES).split()
                for term, tf in Counter(words if known is None else filter(known.__contains__, words)).items():
                    found[term].extend((len(ids), tf))
                ids.append(key)
                lengths.append(len(words))
                if len(ids) >= block:
                    yield rows_of(number, ids, lengths, found)
                    number, ids, lengths = number + 1, [], []
                    found.clear()
        if ids:
            yield rows_of(number, ids, lengths, found)

    fields = f"block long, ids array<{kind.simpleString()}>, lengths binary, n_docs long, n_terms long, term string, df long, postings binary"
    return slim.mapInArrow(run, fields)


def slices_of(at: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of 64 documents that hold any of `at` (ascending), and bitmaps of the bits of their impacts."""
    words, where = np.unique(at >> 6, return_inverse=True)
    bits = max(1, int(impacts.max()).bit_length())
    dense = np.zeros(len(words) * 64, np.int64)
    dense[where * 64 + (at & 63)] = impacts
    out = np.empty((bits, len(words)), "<u8")
    for i in range(bits):
        out[i] = np.packbits((dense >> i & 1).astype(np.uint8), bitorder="little").view("<u8")
    return words.astype("<u4"), out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build_index(blocks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """block, ids (one row of a block), term, weight, words, slices (zstandard). blocks: a table by `counted`.

    terms: a table of distinct terms; others get no slices.
    """
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    postings = blocks.where("term IS NOT NULL").select("block", "term", "df", "postings")
    if terms is not None:
        postings = postings.join(terms.select("term"), "term", "left_semi")
    often = postings.groupBy("term").agg(F.sum("df").alias("all_df"))
    postings = postings.select("block", "term", "postings").join(often, "term").select("block", "term", "all_df", "postings")
    documents = blocks.where("term IS NULL").select(F.col("block").alias("of_block"), "ids", "lengths")
    kind = blocks.schema["ids"].dataType.simpleString()

    def sliced(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pack = zstandard.ZstdCompressor(level=1).compress
        block, n = right["of_block"][0], np.frombuffer(right["lengths"][0], np.int64)
        m = 12 * (75 + (25 * n * n_docs) // max(1, n_terms))
        out: list[tuple] = [(block, right["ids"][0], None, None, None, None)]
        for term, df, blob in zip(left["term"], left["all_df"], left["postings"], strict=True):
            at, tf = np.frombuffer(blob, "<u4").reshape(2, -1).astype(np.int64)
            w = weight(int(df), n_docs)
            words, slices = slices_of(at, w * ((1_000_000_000 * tf) // (1000 * tf + m[at])))
            out.append((block, None, term, w, words.tobytes(), pack(slices.tobytes())))
        return pd.DataFrame(out, columns=["block", "ids", "term", "weight", "words", "slices"], dtype=object)

    return postings.groupBy("block").cogroup(documents.groupBy("of_block")).applyInPandas(sliced, f"block long, ids {kind}, term string, weight long, words binary, slices binary")


class Slices(dict):
    """Words and slices of terms, decompressed as they are used; at most `most` numbers are kept."""

    def __init__(self, rows: pd.DataFrame, most: int = 4_000_000) -> None:
        super().__init__()
        self.rows = {t: (w, s) for t, w, s in zip(rows["term"], rows["words"], rows["slices"], strict=True) if t is not None}
        self.unpack, self.most, self.held = zstandard.ZstdDecompressor().decompress, most, 0

    def __missing__(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        words, blob = self.rows[term]
        words = np.frombuffer(words, "<u4")
        self[term] = found = words, np.frombuffer(self.unpack(blob), "<u8").reshape(-1, len(words))
        self.held += found[1].size
        if self.held > self.most:
            self.clear()
            self.held = found[1].size
            self[term] = found
        return found


class Sums:
    """Sums of sliced numbers, sums and carries apart: one full adder takes a number for all documents and slices."""

    def __init__(self, bits: int, words: int) -> None:
        self.total, self.carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)

    def add(self, words: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
        """Add the numbers times 2^shift in these words."""
        at = slice(None) if len(words) == self.total.shape[1] else words
        a, b = self.total[:, at], self.carry[:, at]
        x = np.zeros_like(a)
        x[shift : shift + len(slices)] = slices
        half = a ^ b
        carry = np.zeros_like(a)
        carry[1:] = (a & b | half & x)[:-1]
        self.total[:, at], self.carry[:, at] = half ^ x, carry

    def slices(self) -> np.ndarray:
        """The slices of the sums, with the carries added in."""
        out, carry = np.empty_like(self.total), np.zeros(self.total.shape[1], np.uint64)
        for i, (a, b) in enumerate(zip(self.total, self.carry, strict=True)):
            half = a ^ b
            out[i] = half ^ carry
            carry = a & b | half & carry
        return out


def best(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k largest numbers above 0, or all if fewer; of equal ones those at the first places."""
    sure, open_ = np.zeros(slices.shape[1], np.uint64), np.bitwise_or.reduce(slices, axis=0)
    for row in slices[::-1]:
        with_bit = open_ & row
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure |= with_bit
            open_ &= ~row
            if n == k:
                open_[:] = 0
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little"))
    at = places(sure)
    at = np.concatenate([at, places(open_)[: k - len(at)]])
    values = np.zeros(len(at), np.int64)
    for i, row in enumerate(slices):
        values |= (row[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << i
    return at, values


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", terms: str = "terms", k: int = 20, batch_items: int = 2000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each row of items.

    items: an id and the array of its terms. They are dealt into batches of about `batch_items`, each of which meets every
    block in a call of its own.
    """
    asked = materialized(items.select(F.col(item_id).alias("item_id"), F.col(terms).alias("terms")).withColumn("item", F.monotonically_increasing_id()))
    batches = max(1, -(-asked.count() // batch_items))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long")))
    queries = index.where("term IS NULL").select(F.col("block").alias("of_block"), every.alias("of_batch")).join(asked.select(F.col("batch").alias("of_batch"), "item", "terms"), "of_batch")
    copies = index.withColumn("batch", every)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def answered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left["ids"].notna()
        ids, known = left["ids"][own].iloc[0], Slices(left)
        weights = dict(zip(left["term"], left["weight"], strict=True))
        words = -(-len(ids) // 64)
        out: list[tuple] = []
        for item, asked in zip(right["item"], right["terms"], strict=True):
            often = {t: q for t, q in Counter(asked).items() if t in known.rows and weights[t] > 0}
            if not often:
                continue
            sums = Sums(int(sum(1_000_000 * weights[t] * q for t, q in often.items())).bit_length() + 1, words)
            for t, q in often.items():
                for shift in range(q.bit_length()):
                    if q >> shift & 1:
                        sums.add(*known[t], shift)
            out += [(item, ids[p], v) for p, v in zip(*(x.tolist() for x in best(sums.slices(), k)), strict=True)]
        return pd.DataFrame(out, columns=["item", "doc_id", "score"], dtype=object)

    found = copies.groupBy("batch", "block").cogroup(queries.groupBy("of_batch", "of_block")).applyInPandas(answered, f"item long, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 20, block: int = 8192, most_terms: int = 500_000, batch_items: int = 2000,
) -> DataFrame:
    """item_id, rank, doc_id, score of all items against all documents, by an index of the items' terms."""
    asked = items.select(F.col(item_id).alias("item_id"), terms_of(F.col(item_text)).alias("terms"))
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    some = terms.limit(most_terms + 1).collect()
    few = len(some) <= most_terms
    blocks = materialized(counted(docs, doc_id, text, {r["term"].encode() for r in some} if few else None, block))
    index = materialized(build_index(blocks, None if few else terms))
    discard(blocks)
    return search(index, asked, "item_id", "terms", k, batch_items)


ORACLE = rf"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), totals AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM words
), counts AS (
    SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM words) AS t
    WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term
), scores AS (
    SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id, row
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) AS t WHERE rank <= 20
"""
