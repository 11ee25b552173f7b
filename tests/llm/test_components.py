"""Components by one contraction and propagation, against union-find."""

from __future__ import annotations

import random

import pytest

from newsloom.llm import components as C

RNG = random.Random(5)
STARS = [(RNG.randrange(12), n) for n in range(12, 300) for _ in range(8)]
CHAIN = [(n, n + 1) for n in range(1000, 1030)]
MESS = [(RNG.randrange(2000, 2100), RNG.randrange(2000, 2100)) for _ in range(60)]


def roots(edges):
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {n: find(n) for n in root}


@pytest.mark.parametrize("edges", [STARS, STARS + CHAIN + MESS, [(7, 7)], [(9, 8), (8, 9)]])
def test_components_equal_union_find(spark, edges):
    got = C.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r["node"], r["root"]) for r in got.collect()) == sorted(roots(edges).items())


def test_most_edges_of_a_class_are_met_once(spark):
    """Its nodes stand in stars of many heads, one for each bucket, and one contraction leaves edges between those alone."""
    edges = spark.createDataFrame(STARS, "a long, b long").distinct()
    to, left = C.contracted(edges)
    assert edges.count() > 1500 and left.count() <= 12 * 11 // 2
    assert to.count() == 300
