"""MinHash near-dedup against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from newsloom.llm import minhash_dedup as M

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def near(text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(texts, width=2):
    """{(row): (n_shingles, component_id)} by comparing all pairs of rows; ids None last."""
    sets = [shingles(t, width) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted((i for i in range(len(texts)) if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if 100 * len(sets[i]) < 80 * len(sets[j]):
                break
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    parts: dict = {}
    for i, (key, _) in enumerate(texts):
        parts.setdefault(find(i), []).append(key)
    least = {p: min((k for k in keys if k is not None), default=None) for p, keys in parts.items()}
    return sorted(((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(texts)), key=str)


def rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    base = [prose(RNG.randint(1, 120)) for _ in range(30)]
    out = [*base, *base[:3], *[near(t, k) for t in base for k in (1, 3, 6)], *[near(base[4], 2) for _ in range(40)], base[5].upper(), "É à " + base[6]]
    out += ["", None, " \t\n", "one", "ONE", "one two", "one two one two", prose(3000)]
    return list(enumerate(out, 50))


@pytest.mark.parametrize("split, block, anchors", [(16384, 1024, 64), (6, 5, 2)])
def test_components_equal_brute_force(spark, texts, split, block, anchors):
    """With small blocks, buckets and components are split, and what the anchors don't connect is compared block by block."""
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, kept string, component_id int")
    assert rows(M.near_dedup(docs, shingle=2, split=split, block=block, anchors=anchors)) == brute(texts)


def test_chains_without_a_common_neighbour_are_connected(spark):
    """Each text is near the next one only, so most of the group isn't in the anchors' parts."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(M.near_dedup(docs, shingle=2, split=4, block=4, anchors=1))
    assert got == brute(texts)
    assert {r[2] for r in got} == {0}


def test_large_buckets_need_no_second_band(spark):
    """With one band there is no other that texts of a bucket could share."""
    base = prose(80)
    texts = [(k, near(base, 1)) for k in range(20)] + [(50, prose(80))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = lambda split: rows(M.near_dedup(docs, shingle=2, bands=1, rows=1, batch=1, split=split, anchors=1))
    assert one(2) == one(16384) and len({r[2] for r in one(2)}) < 10


def test_edges_are_stars():
    labels = M.Labels(np.array([0, 1, 2, 2, 4, 5]))
    for pair in ((3, 1), (2, 4)):
        labels.join(*pair)
    nodes = np.array([9, 8, 7, 6, 5, 4])
    assert sorted(M.stars(nodes, labels)) == [(5, 6), (5, 7), (5, 8)] and M.stars(nodes, None) == []


def test_null_shared_and_string_ids_and_no_rows(spark):
    a, b, c = prose(50), prose(50), prose(50)
    rows_in = [(None, a), (None, b), (7, b), (7, c), (8, c), (9, None), (None, None), (8, c)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in M.near_dedup(docs, shingle=2).collect()), key=str)
    assert got == sorted([(None, None, True), (None, 7, False), (7, 7, True), (7, 7, True), (8, 7, False), (8, 7, False), (9, 9, True), (None, None, True)], key=str)
    named = spark.createDataFrame([("b", a), ("a", a)], "name string, body string")
    assert {(r["doc_id"], r["component_id"]) for r in M.near_dedup(named, "name", "body").collect()} == {("b", "a"), ("a", "a")}
    assert M.near_dedup(docs.limit(0)).collect() == []


def test_whole_documents_lose_no_link(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(M.near_dedup(docs, shingle=2)) == brute(texts)


def test_posterior_bounds():
    """The tail against an integral over a grid; bounds rise with the batches and keep pairs at the threshold."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for matches, n in ((20, 32), (40, 64), (60, 64)):
        density = x**matches * (1 - x) ** (n - matches)
        t = 0.8 + 0.2 / 256
        assert abs(M.posterior(matches, n, 0.8) - density[x >= t].sum() / density.sum()) < 1e-4
    bars = M.least_matches(160, 32, 0.8, 1e-6)
    assert list(bars) == sorted(bars) and bars[-1] < 0.8 * 160 and len(M.least_matches(240, 40, 0.8, 1e-6)) == 6
    rng = np.random.default_rng(3)
    agree = rng.random((20_000, 160)) < 0.8 + 0.2 / 256
    many = np.where(agree, 0, 1).astype(np.uint8)
    at, matches = M.survivors(np.zeros(160, np.uint8), many, 32, bars)
    assert len(at) >= 19_995
    assert (matches == (many[at] == 0).sum(axis=1)).all()
