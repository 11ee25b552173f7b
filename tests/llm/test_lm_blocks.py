"""Blocks and ranges of hashes send arrays, and contexts that are frequent are dealt over several ranges."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from newsloom.llm import lm_scoring
from tests.llm.test_lm_tree import UNKNOWN, grown, tokens


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    follow = {w: rng.choices(range(200), k=4) for w in range(400)}
    out = []
    for i in range(300):
        w, said = 0, []
        for _ in range(rng.randint(0, 120)):
            said.append(f"w{w}")
            w = 0 if rng.random() < 0.3 else rng.choice(follow[w]) if rng.random() < 0.8 else rng.randrange(400)
        out.append((i, " ".join(said)))
    return [*out, (900, None), (None, "w0 w1 w0"), (901, "w0 w0 " * 400), (902, "never seen")]


def shuffled_records(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_what_is_shuffled_is_rows_of_blocks_and_ranges(spark, texts):
    """And not a row for each context and next symbol of a block."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    before = shuffled_records(spark)
    assert lm_scoring.score_documents(docs, range_tokens=10_000).count() == len(texts)
    assert 0 < shuffled_records(spark) - before < 3 * len(texts)


def test_heavy_contexts_are_judged_by_the_sums_of_their_parts(spark, texts):
    """A context of 6,000 tokens in up to 256 parts, and blocks of a few texts."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    options = {"min_context": 4, "min_next": 2, "min_bits": 6.0, "range_tokens": 3000, "block_tokens": 1500}
    got = {h: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_scoring.score_documents(docs, heavy=h, **options).collect()) for h in (40, 1 << 20)}
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    tree, node_of = grown([tokens(t) for key, t in texts if not held(key)], 3, 4, 2, 6.0, 2.0)
    want = []
    for key, text in texts:
        t, score = tokens(text), 0.0
        for k, w in enumerate(t):
            node = max([0, *(found for d in range(1, 4) if k >= d and (found := node_of.get(tuple(t[k - d : k]))) is not None and tree.kept[found])])
            score += math.log10(tree.probability(node, tree.symbols.get(w, tree.symbols[UNKNOWN])))
        want.append((str(key), len(t), score))
    for rows in got.values():
        for a, b in zip(rows, sorted(want), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-4)
    assert sum(tree.kept) > 20


def test_contexts_with_the_counts_of_their_suffix_are_not_sent():
    """What ends at place 1 has the count that it has without its first word, so the context of place 2 is known."""
    state = {
        "places": np.arange(4, dtype=np.uint32), "lengths": np.array([4]), "held": np.array([False]), "hashes": np.array([1, 2, 3, 4], np.uint64) << np.uint64(60),
        "n": np.array([5, 5, 5, 1]), "same": np.array([0, 1, 0, 0], np.uint8), "log_p": np.zeros(4),
    }
    e = lm_scoring.entries(state, 1, lm_scoring.Bars(2, 1, 1.0, 2.0, 1 << 20))
    assert e.known.tolist() == [2] and e.at.tolist() == [1, 3] and len(e.routes) == len(e.n) == 2
