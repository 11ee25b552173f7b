"""The bit-sliced index against scores worked out one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from newsloom.llm import impact_index as I

RNG = random.Random(4)
WORDS = [*("".join(RNG.choice("abcdeå") for _ in range(RNG.randint(1, 5))) for _ in range(120)), "É", "9", "日本"]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    sets = [(key, terms(t)) for key, t in docs]
    n_docs, n_terms = sum(1 for _, t in sets if t), sum(len(t) for _, t in sets)
    df = Counter(x for _, t in sets for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for key, t in sets:
            tf, m = Counter(t), 75 + (25 * len(t) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, r, None if last else key, -s) for r, (s, last, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def data():
    sep = [" ", "-", ". ", "\n", "_", "/"]
    text = lambda n: "".join(RNG.choice(WORDS) + RNG.choice(sep) for _ in range(n))
    docs = [(i, text(RNG.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(300, None), (301, ""), (302, " -- "), (303, text(4000)), (None, text(30)), (None, text(30)), (5, docs[5][1]), (5, text(9))]
    items = [(i, text(RNG.randint(1, 12))) for i in range(25)] + [(90, docs[3][1]), (91, None), (92, "zzzz"), (93, "a a a a a A"), (93, "9 日本"), (None, "a É")]
    return docs, items


@pytest.mark.parametrize("block, batch_items, most_terms", [(8192, 2000, 500_000), (16, 7, 0), (64, 2000, 3)])
def test_ranks_equal_brute_force(spark, data, block, batch_items, most_terms):
    """In one block and in many, items in one batch and in many, with terms sent to the tasks and with terms joined."""
    docs, items = data
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, rank int, term string").repartition(3)
    i = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, score int")
    assert rows(I.rank_documents(d, i, k=7, block=block, batch_items=batch_items, most_terms=most_terms)) == brute(docs, items, 7)


def test_empty_tables(spark, data):
    docs, items = data
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert I.rank_documents(d.limit(0), i).collect() == []
    assert I.rank_documents(d, i.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "y z")], "name string, body string")
    got = I.rank_documents(named, spark.createDataFrame([("q", "z x")], "qid string, q string"), "name", "body", "qid", "q").collect()
    assert [(r["doc_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("c", 1), ("a", 2), ("b", 3)]


def test_sums_and_best_equal_arithmetic():
    rng = np.random.default_rng(2)
    total, sums = np.zeros(640, np.int64), I.Sums(45, 10)
    for _ in range(60):
        at = np.sort(rng.choice(640, rng.integers(1, 640), replace=False))
        impacts, shift = rng.integers(0, 1 << 34, len(at)), int(rng.integers(0, 3))
        total[at] += impacts << shift
        sums.add(*I.slices_of(at, impacts), shift)
    for k in (1, 20, 640, 1000):
        at, values = I.best(sums.slices(), k)
        order = np.lexsort((np.arange(640), -total))
        want = [int(p) for p in order[:k] if total[p] > 0]
        assert sorted(at.tolist()) == sorted(want) and (values == total[at]).all()
    ties = np.array([3, 5, 5, 0, 5, 1] * 20)
    words, slices = I.slices_of(np.arange(120), ties)
    assert sorted(I.best(slices, 4)[0].tolist()) == [1, 2, 4, 7]


def test_sql_says_the_same(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(I.ORACLE).fetchall(), key=str)
    got = rows(I.rank_documents(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))))
    assert got == want and len(got) > 100
