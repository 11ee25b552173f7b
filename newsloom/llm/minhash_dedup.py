"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct `shingle`-word windows, with A-Z in lower case; with fewer words, the whole
sequence is the only one. Equal sets are taken once. A signature has `bands` x `rows` minima; sets whose minima agree in a
whole band meet in a bucket, which a pair at the threshold misses with the chance (1 - threshold^rows)^bands, 6e-6 here.
That holds for buckets of any size: larger ones than `split` sets are compared in blocks, without another condition.

Pairs of a bucket are compared by batches of `batch` minima, kept as bytes. After each batch the posterior of their
agreement, under a flat prior, is Beta(matches + 1, misses + 1); a pair goes as soon as the chance that its similarity
reaches the threshold is under `miss` (`least_matches`). What survives is compared on the full sets, so every link is exact.

Only components are asked for, so pairs that are connected already are not compared again, and no pair leaves a task but
the edges of spanning forests: first of the surviving pairs, then, inside their components, of the exact links. Either is
done in two rounds (`forest`). Groups of up to `split` signatures, or `block` full sets, are one task's call. Larger ones are dealt into blocks which all
hold the same `anchors` sets too, so copies of one text are connected at linear cost; what isn't in the group's largest part
after that is compared with all of the group, block by block.

Edge cases: null and blank texts have no shingle and are linked with nothing; ids of any simple type, null ids are
documents like others, and a component of them alone has a null id and is kept; rows that share an id but not a text are
documents of their own; repeated rows are equal sets; an empty table gives an empty result; other columns are ignored.

Bounds: a call holds the signatures of up to 2 * `split` + `anchors` documents, or the sets of 2 * `block` + `anchors`. A
group of n that is in many parts after the first round ships each at most n / `block` (n / `split`) times more; it is exact
at any size, at that cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, discard, materialized
from newsloom.llm.components import components
from newsloom.llm.jaccard_join import ODD, WordHash, in_deals, mix, shingles


def lower(text: str | None) -> str | None:
    """A-Z alone in lower case."""
    return text.encode().lower().decode() if text else None


def minima(tokens: np.ndarray, hashes: int) -> np.ndarray:
    """The smallest value of each of so many 32-bit hash functions over a set of 64-bit tokens."""
    seeds = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * ODD)
    a, b = (seeds[:hashes] | np.uint64(1)).astype(np.uint32), (seeds[hashes:] | np.uint64(1)).astype(np.uint32)
    x = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    least = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024, None] * a[None, :]
        h ^= h >> np.uint32(15)
        h *= b
        np.minimum(least, h.min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of so many minima; other bands have other hashes."""
    parts = least.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * ODD
    for j in range(rows):
        out = mix((out ^ parts[:, j]) * ODD)
    return out


def posterior(matches: int, n: int, threshold: float) -> float:
    """The chance that minima kept as bytes agree as often as at the threshold, after so many matches of n.

    The posterior is Beta(matches + 1, n - matches + 1); its tail above x is that of Binomial(n + 1, x) up to `matches`.
    """
    x = threshold + (1 - threshold) / 256
    term, total = (1 - x) ** (n + 1), 0.0
    for k in range(matches + 1):
        total += term
        term *= (n + 1 - k) / (k + 1) * x / (1 - x)
    return total


@lru_cache(maxsize=8)
def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of batches, the fewest matches with which a pair stays."""
    return tuple(next(m for m in range(n + 1) if m == n or posterior(m, n, threshold) >= miss) for n in range(batch, hashes + 1, batch))


def survivors(one: np.ndarray, many: np.ndarray, batch: int, bars: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which of many signatures stay beside one, and their matches."""
    at, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, bar in enumerate(bars):
        part = slice(k * batch, (k + 1) * batch)
        matches = matches + (many[at, part] == one[part]).sum(axis=1)
        stay = matches >= bar
        at, matches = at[stay], matches[stay]
    return at, matches


class Labels:
    """Parts of a graph whose edges come one by one."""

    def __init__(self, first: np.ndarray) -> None:
        self.of, self.edges = np.unique(first, return_inverse=True)[1], []

    def join(self, i: int, j: int) -> None:
        self.edges.append((i, j))
        self.of[self.of == self.of[j]] = self.of[i]


def apart(group: dict[str, np.ndarray], batch: int, bars: tuple[int, ...]) -> Iterator[tuple[Labels, int, np.ndarray]]:
    """For each row of a group the rows that stay beside it and aren't of its part yet, those that agree most first."""
    labels, left, right = Labels(group["label"]), group["left"].astype(bool), np.flatnonzero(group["right"])
    signatures = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(left), -1)
    for i in np.flatnonzero(left).tolist():
        others = right[right > i] if left.all() else right
        others = others[labels.of[others] != labels.of[i]]
        if len(others):
            at, matches = survivors(signatures[i], signatures[others], batch, bars)
            yield labels, i, others[at[np.argsort(-matches, kind="stable")]]


def stars(nodes: np.ndarray, labels: Labels | None) -> list[tuple]:
    """Edges that connect what was joined, from the smallest node of each part: the same in most buckets of a large class."""
    if labels is None or not labels.edges:
        return []
    at = np.unique(np.array(labels.edges))
    ids, of = nodes[at].astype(np.int64), labels.of[at]
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    heads = np.repeat(ids[first], np.diff(np.append(first, len(of))))
    return [(a, b) for a, b in zip(heads.tolist(), ids.tolist()) if a != b]


def near_pairs(batch: int, bars: tuple[int, ...]) -> Callable[[dict[str, np.ndarray]], list[tuple]]:
    """Edges that connect the pairs of a group that stay."""

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        labels = None
        for labels, i, others in apart(group, batch, bars):
            for j in others.tolist():
                if labels.of[j] != labels.of[i]:
                    labels.join(i, j)
        return stars(group["node"], labels)

    return run


def exact_pairs(batch: int, bars: tuple[int, ...], percent: int) -> Callable[[dict[str, np.ndarray]], list[tuple]]:
    """Edges that connect the pairs of a group whose full sets are similar enough."""

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        sets, labels = [np.frombuffer(t, np.uint64) for t in group["tokens"]], None
        for labels, i, others in apart(group, batch, bars):
            for j in others.tolist():
                if labels.of[j] == labels.of[i]:
                    continue
                small, large = len(sets[i]), len(sets[j])
                if 100 * min(small, large) < percent * max(small, large):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (small + large - common):
                    labels.join(i, j)
        return stars(group["node"], labels)

    return run


def several(banded: DataFrame) -> DataFrame:
    """group, n: the buckets of more than one set, one of those with the same members. banded: node, group."""
    node = F.xxhash64("node")
    sizes = banded.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(node % (1 << 40)).alias("m1"), F.bit_xor(node).alias("m2"))
    return sizes.where("n > 1").groupBy("n", "m1", "m2").agg(F.min("group").alias("group")).select("group", "n")


def forest(members: DataFrame, payload: DataFrame, run: Callable[[dict[str, np.ndarray]], list[tuple]], block: int, anchors: int) -> DataFrame:
    """a, b: edges that connect what `run` connects, in each group of members (group, node, n), n the size of the group.

    payload: node and what `run` needs of it.
    """
    members = materialized(members.select("group", "node", "n"))
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    anchor = (parts > 1) & (F.pmod(F.xxhash64("node", F.lit(11)), F.col("n")) < anchors)
    dealt = members.withColumn("part", F.explode(F.when(anchor, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
    dealt = dealt.select("group", "part", F.lit(0).alias("other"), "node", F.col("node").alias("label"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    keys, edge = ["group", "part", "other"], "a long, b long"
    edges = materialized(in_deals(dealt.join(payload, "node"), keys, members.count(), run, edge))
    large = members.where(F.col("n") > block)
    if large.isEmpty():
        discard(members)
        return edges
    # Of the large groups, what isn't in the largest part yet meets all that is in another part.
    roots = components(edges)
    large = materialized(large.join(roots, "node", "left").select("group", "node", "n", F.coalesce("root", "node").alias("label")))
    sizes = large.groupBy("group", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("group").agg(F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("all"))
    main = main.select("group", F.col("main.label").alias("main"), (F.col("all") - F.col("main.rows")).alias("rest")).where("rest > 0")
    rest = large.join(main, "group")
    lefts, rights = F.ceil(F.col("rest") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    at = lambda count: F.pmod(F.xxhash64("node", F.lit(13)), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    one = rest.where("label <> main").withColumn("part", at(lefts)).withColumn("other", every(rights)).withColumn("left", F.lit(True)).withColumn("right", F.lit(False))
    two = rest.withColumn("part", every(lefts)).withColumn("other", at(rights)).withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    dealt = materialized(one.unionByName(two).select("group", "part", "other", "node", "label", "left", "right"))
    more = materialized(in_deals(dealt.join(payload, "node"), keys, dealt.count(), run, edge))
    for used in (members, large, dealt):
        discard(used)
    return edges.unionByName(more)


def near_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6,
    batch: int = 40, miss: float = 1e-6, split: int = 16384, block: int = 1024, anchors: int = 64,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that is reachable by links), kept (it is the own id).

    Sets are linked if 100 * intersection >= percent * union. batch divides bands * rows. Building it runs jobs.
    """
    bound_batches(docs.sparkSession)
    bars = least_matches(bands * rows, batch, percent / 100, miss)
    # Ids go through Python as strings, which nulls and large numbers don't change. A text is told by its id and hash.
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for frame in batches:
            out = []
            for x in frame["text"]:
                tokens = shingles(lower(x), shingle, known)
                if not len(tokens):
                    out.append((None, None, 0, None, None))
                    continue
                d, least = xxhash.xxh128_digest(tokens.tobytes()), minima(tokens, bands * rows)
                s1, s2 = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
                out.append((s1, s2, len(tokens), band_hashes(least, rows).view(np.int64), (least & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["s1", "s2", "n_shingles", "bands", "signature"], dtype=object).assign(key=frame["key"], t=frame["t"])

    table = materialized(slim.select("key", "t", "text").mapInPandas(signed, "key string, t long, s1 long, s2 long, n_shingles long, bands array<long>, signature binary"))
    sets = table.where("s1 IS NOT NULL")
    # Of equal sets one text stands for all, under a number that is written with it.
    stands = sets.groupBy("s1", "s2").agg(
        F.min(F.col("key").cast(kind)).alias("head"), F.min(F.struct("key", "t")).alias("of"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    stands = materialized(stands.withColumn("node", F.monotonically_increasing_id()))
    banded = stands.select("node", F.explode("bands").alias("group"))
    buckets = materialized(several(banded))
    met = banded.join(buckets, "group")
    signatures = stands.select("node", "signature")
    near = components(forest(met, signatures, near_pairs(batch, bars), split, anchors))
    near = near.select("node", F.col("root").alias("group"))
    near = materialized(near.join(near.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group"))

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for frame in batches:
            tokens = [shingles(lower(x), shingle, known).tobytes() for x in frame["text"]]
            yield frame[["node", "signature"]].assign(tokens=tokens)

    needed = stands.join(near.select("node"), "node").select("node", "signature", F.col("of.key").alias("of_key"), F.col("of.t").alias("of_t"))
    discard(buckets)
    drawn = slim.join(needed, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("t") == F.col("of_t"))).dropDuplicates(["node"])
    drawn = materialized(drawn.select("node", "signature", "text").mapInPandas(full, "node long, signature binary, tokens binary"))
    roots = components(forest(near, drawn, exact_pairs(batch, bars, percent), block, anchors))
    discard(drawn)
    of_root = roots.join(stands.select("node", "head"), "node").groupBy("root").agg(F.min("head").alias("component_id"))
    classes = stands.join(roots.join(of_root, "root"), "node", "left").select("s1", "s2", F.when(F.col("root").isNull(), F.col("head")).otherwise(F.col("component_id")).alias("component_id"))
    own = F.col("key").cast(kind)
    out = table.join(classes, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("s1").isNull(), own).otherwise(F.col("component_id")))
    return out.select(own.alias("doc_id"), "n_shingles", "component_id", own.eqNullSafe(F.col("component_id")).alias("kept"))
