"""N-gram Jaccard join by chosen paths.

A document is the set of its `shingle`-word windows. In each of `runs` repeated runs, a set follows every path that it
chooses: at each level it chooses each of its tokens with a probability of `branch` / its size, by a hash of path and
token, so two sets choose shared tokens alike. Buckets of one set end; buckets of up to `small` sets are compared by
brute force; larger ones are split again, down to `levels`, and what is still large then is compared by brute force in
blocks. Runs are as many as the target recall of a pair at the threshold needs (`runs_for`).

Bucket comparisons use sketches of 64 minima to propose candidates, which only makes components of candidates. Within
those, each pair of blocks is compared exactly, every pair once. So what is shuffled is a row for each set, path and
block, never a pair; the number of a document's links is counted where pairs are compared, and a spanning forest of the
links is all that leaves.

Equal sets are taken once with their number of documents; they are linked to each other and share all links.

Edge cases: null and blank texts have no shingle, no link, and a class of their own; texts with fewer words than a
shingle are one shingle of all their words; ids of any simple type; null ids are documents like others, and a class of
them alone has a null id; rows that share an id but not a text are documents of their own, and repeated rows are equal
sets; an empty table gives an empty result; other columns are ignored.

Bounds: what chosen paths leave large is compared in blocks of `block` sets, and so is a component of candidates: one of
n sets ships each set n / `block` times and compares all n * n / 2 pairs in numpy. It is exact at any size, at that cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, discard, materialized
from newsloom.llm.components import components

ODD = np.uint64(0x9E3779B97F4A7C15)
SKETCH = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: WordHash) -> np.ndarray:
    """The sorted distinct hashes of all windows of `width` words; of all words if they are fewer."""
    words = text.encode().split() if text else []  # bytes know of ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * ODD
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The smallest token of each of 64 hash functions, as 16 bits."""
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(tokens), 4096):
        part = tokens[a : a + 4096, None] * seeds[None, :]
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def chosen(paths: np.ndarray, tokens: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(which of the paths, the path below it) for all that a set of tokens chooses."""
    if not len(paths):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seeds = mix(paths)
    h = (tokens[None, :] ^ seeds[:, None]) * ODD
    h ^= h >> np.uint64(29)
    limit = np.uint64(min(1.0, branch / max(1, len(tokens))) * 18446744073709549568.0)
    at, token = np.nonzero(h <= limit)
    return at, mix(h[at, token] ^ seeds[at])


def walk(tokens: np.ndarray, runs: int, levels: int, branch: float) -> list[int]:
    """All paths of a set: for each first path its number of second ones, and for each of those its third ones."""
    _, first = chosen(np.arange(runs, dtype=np.uint64), tokens, branch)
    at2, second = chosen(first if levels > 1 else first[:0], tokens, branch)
    at3, third = chosen(second if levels > 2 else second[:0], tokens, branch)
    first, second, third = first.view(np.int64).tolist(), second.view(np.int64).tolist(), third.view(np.int64).tolist()
    end2, end3 = np.searchsorted(at2, np.arange(len(first) + 1)).tolist(), np.searchsorted(at3, np.arange(len(second) + 1)).tolist()
    out: list[int] = []
    for i, p in enumerate(first):
        out += (p, end2[i + 1] - end2[i])
        for j in range(end2[i], end2[i + 1]):
            out += (second[j], end3[j + 1] - end3[j], *third[end3[j] : end3[j + 1]])
    return out


def survival(levels: int, branch: float, threshold: float) -> float:
    """The chance that a pair at the threshold shares a bucket after so many levels of one run."""
    shared = 2 * threshold / (1 + threshold)  # of a set's tokens, for sets of one size
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-branch * shared * p)
    return p


def runs_for(recall: float, levels: int, branch: float, threshold: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels, branch, threshold)))


def blocks(df: DataFrame, key: str, node: str, size: int) -> DataFrame:
    """df dealt to pairs of blocks of its key: `pair` (a block beside itself or a later one) and `side`.

    A key with up to `size` rows is one block. n: the number of rows of the key, a column of df.
    """
    count = F.ceil(F.col("n") / size).cast("int")
    block = F.pmod(F.xxhash64(node, F.lit(7)), count).cast("int")
    others = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high"), (block > j).alias("side")))
    return df.withColumn("_pair", F.explode(others)).select(*df.columns, F.col("_pair.low").alias("low"), F.col("_pair.high").alias("high"), F.col("_pair.side").alias("side"))


class Forest:
    """A spanning forest of edges among n places, which come as one place and those it is linked to."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def link(self, i: int, others: np.ndarray) -> None:
        apart = others[self.label[others] != self.label[i]]
        for label, k in zip(*np.unique(self.label[apart], return_index=True), strict=True):
            self.edges.append((i, int(apart[k])))
            self.label[self.label == label] = self.label[i]


def intersections(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the rows, the sizes of its intersections with all sets. Tokens of a single set don't count.

    By products of 0/1 matrices where many sets share few tokens, else by the tokens' postings.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    shared = often[code] > 1
    owner, code, columns = owner[shared], column[code[shared]], int((often > 1).sum())
    order = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[order], np.arange(columns + 1))
    if (often[often > 1].astype(np.float64) ** 2).sum() * 20 > float(len(rows)) * len(sets) * columns:
        common = np.zeros((len(rows), len(sets)), np.float32)
        for a in range(0, columns, 2048):
            part = order[begin[a] : begin[min(a + 2048, columns)]]
            x = np.zeros((len(sets), 2048), np.float32)
            x[owner[part], code[part] - a] = 1
            common += x[rows] @ x.T
        for k, i in enumerate(rows.tolist()):
            row = common[k].astype(np.int64)
            row[i] = sizes[i]
            yield i, row
        return
    of, by_owner = np.split(code, np.searchsorted(owner, np.arange(1, len(sets)))), owner[order]
    for i in rows.tolist():
        low, lengths = begin[of[i]], begin[of[i] + 1] - begin[of[i]]
        at = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        yield i, np.bincount(by_owner[at], minlength=len(sets))


def in_deals(df: DataFrame, keys: list[str], size: int, run, schema: str, per_deal: int = 1000) -> DataFrame:  # noqa: ANN001
    """run(columns of one group as arrays) -> rows, for all groups of the keys, by deals of about `per_deal` rows.

    Most groups are a few rows; a task's cost for each deal is far above that of a group in it. size: the rows of df.
    """
    deals = max(1, -(-size // per_deal))
    names = schema.replace(" long", "").split(", ")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys).reset_index(drop=True)
        edge = np.zeros(len(rows), bool)
        for k in keys:
            edge |= rows[k].ne(rows[k].shift()).to_numpy()
        starts = np.append(np.flatnonzero(edge), len(rows)).tolist()
        arrays = {c: rows[c].to_numpy() for c in rows.columns}
        found: list[tuple] = []
        for x, y in zip(starts, starts[1:]):
            if y - x > 1:
                found += run({c: v[x:y] for c, v in arrays.items()})
        return pd.DataFrame(found, columns=names, dtype=object)

    return df.withColumn("deal", F.pmod(F.xxhash64(*keys), F.lit(deals))).groupBy("deal").applyInPandas(deal, schema)


def candidate_edges(leaves: DataFrame, size: int, least: float) -> DataFrame:
    """A spanning forest of the pairs of each bucket whose sketches agree enough. leaves: bucket, n, low, high, side, node, sketch."""

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        _, first = np.unique(np.stack([group["node"], group["side"].astype(np.int64)]), axis=1, return_index=True)
        nodes, side = group["node"][first], group["side"][first].astype(bool)
        s = np.frombuffer(b"".join(group["sketch"][first]), "<u2").reshape(-1, SKETCH)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        inner = group["low"][0] == group["high"][0]
        right = left if inner else right

        found = Forest(len(nodes))
        for k, i in enumerate(left.tolist()):
            others = right[k + 1 :] if inner else right
            found.link(i, others[(s[others] == s[i]).sum(axis=1) >= least * SKETCH])
        return [(nodes[i], nodes[j]) for i, j in found.edges]

    return in_deals(leaves, ["bucket", "low", "high"], size, run, "a long, b long")


def exact_links(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """node, links, other: links counts documents in a pair of blocks, other (one row each) an edge of a spanning forest.

    members: component, n, low, high, side, node, weight, tokens (sorted, binary).
    """

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        nodes, weight, side = group["node"], group["weight"], group["side"].astype(bool)
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
        sizes = np.array([len(x) for x in sets])
        inner = group["low"][0] == group["high"][0]
        links, found = np.zeros(len(sets), np.int64), Forest(len(sets))
        for i, common in intersections(sets, np.flatnonzero(~side)):
            hit = common >= threshold * (sizes + sizes[i] - common) - 1e-9
            j = np.flatnonzero(hit & ((np.arange(len(sets)) > i) if inner else side))
            links[i] += weight[j].sum()
            links[j] += weight[i]
            found.link(i, j)
        counts = [(nodes[i], links[i], None) for i in np.flatnonzero(links).tolist()]
        return counts + [(nodes[i], 0, nodes[j]) for i, j in found.edges]

    return in_deals(members, ["component", "low", "high"], size, run, "node long, links long, other long")


def dealt_rows(df: DataFrame, size: int) -> int:
    """How many rows `blocks` makes of df."""
    return df.agg(F.coalesce(F.sum(F.ceil(F.col("n") / size)), F.lit(0))).first()[0]


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.9995,
    levels: int = 3, branch: float = 1.25, small: int = 64, block: int = 1024,
) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), n_links (other documents with a similarity of `threshold` or more)."""
    bound_batches(docs.sparkSession)
    runs = runs_for(recall, levels, branch, threshold)
    # Ids go through Python as strings, which nulls and large numbers don't change. A text is told by its id and hash.
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingles(text, shingle, known)
                if len(tokens):
                    d = xxhash.xxh128_digest(tokens.tobytes())
                    rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), walk(tokens, runs, levels, branch)))
                else:
                    rows.append((None, None, None))
            yield pd.DataFrame(rows, columns=["s1", "s2", "paths"], dtype="object").assign(key=batch["key"], t=batch["t"])

    # One pass over the texts: a hash of each set, and its paths.
    table = materialized(slim.select("key", "t", "text").mapInPandas(split, "key string, t long, s1 long, s2 long, paths array<long>"))
    # Without the paths, which are deleted as soon as they are followed.
    sets = materialized(table.select("key", "t", "s1", "s2")).withColumn("doc_id", F.col("key").cast(kind))
    # Of equal sets one text stands for all, under a number that is written with it.
    stands = sets.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("weight"), F.min(F.struct("key", "t")).alias("of"))
    stands = materialized(stands.select("s1", "s2", "head", "weight", F.col("of.key").alias("of_key"), F.col("of.t").alias("of_t"), F.monotonically_increasing_id().alias("node")))

    def chosen(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """One row of each of these texts, with its node."""
        return rows.join(nodes.select("node", "of_key", "of_t"), F.col("key").eqNullSafe(F.col("of_key")) & (F.col("t") == F.col("of_t"))).dropDuplicates(["node"])

    heads = chosen(table.where("s1 IS NOT NULL"), stands).select("node", "paths")

    def first_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, first, below = [], [], []
            for node, flat in zip(batch["node"], batch["paths"], strict=True):
                flat, k = flat.tolist(), 0
                while k < len(flat):
                    start = k + 2
                    k = start
                    for _ in range(flat[start - 1]):
                        k += 2 + flat[k + 1]
                    nodes.append(node)
                    first.append(flat[start - 2])
                    below.append(flat[start:k])
            yield pd.DataFrame({"node": nodes, "p1": first, "below": below})

    steps = materialized(heads.mapInPandas(first_paths, "node long, p1 long, below array<long>"))
    discard(table)

    def counted(df: DataFrame) -> DataFrame:
        """df with n, without the buckets of one row."""
        n = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return df.join(n, "bucket")

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, flat in zip(batch["node"], batch["below"], strict=True):
                k, flat = 0, flat.tolist()
                while k < len(flat):
                    end = k + 2 + flat[k + 1]
                    rows.append((flat[k], node, flat[k + 2 : end]))
                    k = end
            yield pd.DataFrame(rows, columns=["bucket", "node", "deep"])

    one = counted(steps.select(F.col("p1").alias("bucket"), "node", "below"))
    two = counted(one.where(F.col("n") > small).mapInPandas(unpacked, "bucket long, node long, deep array<long>"))
    three = counted(two.where(F.col("n") > small).select(F.explode("deep").alias("bucket"), "node"))
    last = three.select("bucket", "node", "n")
    if levels == 1:
        last = one.select("bucket", "node", "n")
    elif levels == 2:
        last = one.where(F.col("n") <= small).select("bucket", "node", "n").unionByName(two.select("bucket", "node", "n"))
    else:
        last = one.where(F.col("n") <= small).select("bucket", "node", "n").unionByName(two.where(F.col("n") <= small).select("bucket", "node", "n")).unionByName(last)
    last = materialized(last)
    discard(steps)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for batch in batches:
            rows = [(t.tobytes(), sketch(t).tobytes()) for t in (shingles(x, shingle, known) for x in batch["text"])]
            yield pd.DataFrame(rows, columns=["tokens", "sketch"]).assign(node=batch["node"])

    near = stands.join(last.select("node").distinct(), "node")
    drawn = materialized(chosen(slim, near).select("node", "text").mapInPandas(sketched, "node long, tokens binary, sketch binary"))
    spread = 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    # Buckets with the same members are one.
    alike = last.groupBy("bucket", "n").agg(F.sum(F.xxhash64("node") % (1 << 40)).alias("m1"), F.bit_xor(F.xxhash64("node")).alias("m2"))
    alike = alike.groupBy("n", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket")
    dealt = blocks(last.join(alike, "bucket", "left_semi"), "bucket", "node", block).join(drawn.select("node", "sketch"), "node")
    edges = candidate_edges(dealt, dealt_rows(last, block), threshold - spread)
    member = components(edges).withColumnRenamed("root", "component")
    member = member.join(member.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").join(stands.select("node", "weight"), "node")
    size = dealt_rows(member, block)
    dealt = blocks(member, "component", "node", block).join(drawn.select("node", "tokens"), "node")
    found = materialized(exact_links(dealt, size, threshold))
    for used in (last, drawn):
        discard(used)
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_root = roots.join(stands.select("node", "head"), "node").groupBy("root").agg(F.min("head").alias("class_id"))
    classes = stands.join(roots.join(of_root, "root"), "node", "left").join(links, "node", "left").select(
        "s1", "s2", F.when(F.col("root").isNull(), F.col("head")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    joined = sets.join(classes, ["s1", "s2"], "left")
    return joined.select("doc_id", F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
