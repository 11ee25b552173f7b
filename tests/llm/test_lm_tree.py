"""All scores of a corpus against a suffix tree that is grown in memory from counts of tuples."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import lm_scoring

UNKNOWN = "no word"


def tokens(text):
    return [*(w.decode() for w in (text or "").encode().lower().split()), "\n"]


def grown(texts, depth, least, least_next, bits, prior):
    """The tree of the training texts, by the docstring's rules."""
    counts = [Counter(tuple(t[k - d : k + 1]) for t in texts for k in range(d, len(t))) for d in range(depth + 1)]
    alone = [Counter(tuple(t[k - d : k]) for t in texts for k in range(d, len(t))) for d in range(depth + 1)]
    n, v = sum(counts[0].values()), len(counts[0])
    symbols = [*sorted(w for w, in counts[0]), UNKNOWN]
    tree = lm_scoring.Tree(symbols, np.array([(counts[0][w,] + 0.5) / (n + 0.5 * (v + 1)) for w in symbols]))
    node_of = {(): 0}
    for d in range(1, depth + 1):
        nexts = defaultdict(list)
        for (*context, w), c in counts[d].items():
            if c >= least_next:
                nexts[tuple(context)].append((w, c))
        for context, total in sorted(alone[d].items()):
            # A context grows from its suffix; it can only be looked for where that one's next symbol reached the bar.
            if total < least or context[1:] not in node_of:
                continue
            node = node_of[context] = len(tree.parent)
            tree.parent.append(node_of[context[1:]])
            tree.kept.append(False)
            tree.escape.append(0.0)
            p = {w: c / (total + prior) for w, c in nexts[context]}
            q = {w: tree.probability(tree.kept_parent(node), tree.symbols[w]) for w in p}
            rest, rest_q = 1 - sum(p.values()), max(1e-9, 1 - sum(q.values()))
            gain = sum(p[w] * math.log2(p[w] / q[w]) for w in p) + rest * math.log2(rest / rest_q)
            if p and total * gain >= bits:
                tree.kept[node], tree.escape[node] = True, math.log10(rest / rest_q)
                tree.entries |= {node * tree.size + tree.symbols[w]: math.log10(x) for w, x in p.items()}
    return tree, node_of


@pytest.mark.parametrize("seed, bars", [(1, (8, 2, 16.0)), (2, (3, 1, 4.0)), (3, (300, 5, 16.0))])
def test_scores_equal_a_tree_in_memory(spark, seed, bars):
    """Also with a bar for contexts far above 255."""
    rng = random.Random(seed)
    follow = {w: rng.choices(range(25), k=3) for w in range(40)}
    rows = []
    for i in range(150):
        w, said = rng.randrange(25), []
        for _ in range(rng.randint(0, 60)):
            said.append(f"W{w}")
            w = rng.choice(follow[w]) if rng.random() < 0.85 else rng.randrange(40)
        rows.append((i, " ".join(said)))
    rows += [(500, None), (501, "unknown words only"), (None, "w1 w2 w3"), (None, "w2 w2"), (502, "w1 " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, hashes string").repartition(3)
    least, least_next, bits = bars
    got = lm_scoring.score_documents(docs, min_context=least, min_next=least_next, min_bits=bits, range_tokens=4000).collect()
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    tree, node_of = grown([tokens(t) for key, t in rows if not held(key)], 3, least, least_next, bits, 2.0)
    want = []
    for key, text in rows:
        t, score = tokens(text), 0.0
        for k, w in enumerate(t):
            node = 0
            for d in range(1, 4):
                found = node_of.get(tuple(t[k - d : k])) if k >= d else None
                if found is not None and tree.kept[found]:
                    node = found
            score += math.log10(tree.probability(node, tree.symbols.get(w, tree.symbols[UNKNOWN])))
        want.append((str(key), len(t), score))
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-4)
    assert sum(tree.kept) > 3
