"""Similarity joins and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, jaccard_join, span_dedup, suffix_dedup

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ".", ".\n"]) for _ in range(n))


def near(text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base = [prose(RNG.randint(1, 160)) for _ in range(30)]
    passage = prose(120)
    out = [*base, *base[:4], *[near(t, 2) for t in base[:12] for _ in range(2)], *[near(base[3], 1) for _ in range(8)]]
    out += [prose(20) + " " + passage + " " + prose(20) for _ in range(5)] + ["a" * 900, "a" * 901, "", None, "   \n", "one two", "one two", "é" * 300 + passage]
    return list(enumerate(out, 100))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in texts], "doc_id long, text string, class_id string, h string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_equals_brute_force(spark, texts):
    sets = {i: shingles(t) for i, t in texts}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    # Small blocks, so that buckets and classes are split among several of them.
    got = jaccard_join.jaccard_join(frame(spark, texts), small=2, block=4).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (find(i), links[i]) for i in sets}
    assert len(got) == len(texts)


def test_jaccard_join_loses_no_link_of_the_documents(spark):
    """All links of 1,000 documents, found by comparing every pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: frozenset(map(hash, shingles(r["text"]))) for r in docs.collect()}
    ids, links = sorted(i for i in sets if sets[i]), Counter()
    ids.sort(key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_join(docs).collect()}
    assert sum(links.values()) > 100 and {i: n for i, n in got.items() if n} == dict(links)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).collect() == []
    got = jaccard_join.jaccard_join(frame(spark, [(1, None), (2, "")])).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(1, 1, 0), (2, 2, 0)}


def test_jaccard_join_of_shared_null_and_other_ids(spark):
    """Rows are documents, whatever their ids: no link of a text is lost to another text with its id."""
    a, b = prose(80), prose(80)
    rows = [(1, a), (1, b), (2, near(a, 1)), (3, near(b, 1)), (None, prose(60)), (None, a), ((1 << 60) + 1, "one text of its own here"), ((1 << 60) + 1, "one text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "node": F.lit(0), "t": F.lit(0.5)})
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs, small=2, block=4).collect()), key=str)
    big = (1 << 60) + 1
    assert got == sorted([(1, 1, 2), (1, 1, 1), (2, 1, 2), (3, 1, 1), (None, None, 0), (None, 1, 2), (big, big, 1), (big, big, 1)], key=str)
    named = jaccard_join.jaccard_join(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {(r["doc_id"], r["class_id"]) for r in named.collect()} == {(None, None), (None, "d1"), ("d1", "d1"), ("d2", "d1"), ("d3", "d1"), (f"d{big}", f"d{big}")}


def test_suffix_dedup_equals_brute_force(spark, texts):
    width = 60
    bodies = {i: (t or "").encode() for i, t in texts}
    counts = Counter(b[k : k + width] for b in bodies.values() for k in range(len(b) - width + 1))
    want = {}
    for i, b in bodies.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    out = suffix_dedup.suffix_dedup(frame(spark, texts), width=width, k=12, shard_bytes=3000, range_windows=500)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(out).collect()}
    assert got == want


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"banana\xffbandana\xff" + b"ab" * 40 + b"\xff", np.uint8)
    order = suffix_dedup.suffix_array(data)
    tails = [data[i:].tobytes() for i in order]
    assert tails == sorted(tails)
    shared = suffix_dedup.common_prefixes(data, order, 16, stretch=5)
    for a, b, i in zip(tails, tails[1:], order[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[i] == min(n, 16)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, []))).collect() == []


def test_span_dedup_equals_brute_force(spark, texts):
    def parts(t):
        return [x for x in re.sub(r"([.!?][ \t\n\x0B\f\r]+|\n+)", "\\1\x01", t or "").split("\x01") if x]

    runs = {}
    for i, t in texts:
        s = [p.strip(" \t\n\x0b\f\r").lower() for p in parts(t)]
        lens = [len(re.split(r"[\x20\x09-\x0D]+", x)) for x in s]
        for k in range(len(s)):
            n = next((n for n in range(2, len(s) - k + 1) if sum(lens[k : k + n]) >= 20), len(s) if k == 0 else 0)
            if n:
                runs.setdefault(" ".join(s[k : k + n]), []).append((i, k, n))
    gone = {i: set() for i, _ in texts}
    for places in runs.values():
        for i, k, n in sorted(places)[1:]:
            gone[i] |= set(range(k, k + n))
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(frame(spark, texts)).collect()}
    for i, t in texts:
        p = parts(t)
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(p), len(gone[i]))
        assert got[i]["text"] == ("".join(x for k, x in enumerate(p) if k not in gone[i]) if gone[i] else t)


def test_span_dedup_of_cut_passages_and_edges(spark):
    """Passages of over 50 words that begin and end amid sentences go from all but the first text; the rest stays."""
    fresh = iter(range(10**6))
    sentence = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n)) + ". "
    passage = "".join(sentence(n) for n in (9, 13, 11, 14, 12))[:-2] + " tail"
    loud = "".join(f"w{next(fresh)}!! " for _ in range(60))
    long = "".join(sentence(8) for _ in range(4000))
    rows = [(k, sentence(12) + f"lead{k} in " + passage + f" out{k}. " + sentence(12)) for k in range(4)]
    rows += [(10, sentence(5) + loud + sentence(5)), (11, sentence(7) + loud + sentence(7)), (12, sentence(30)), (13, long), (14, "x " + long)]
    rows += [(None, "alone. here."), (20, None), (21, ""), (22, " \n "), (23, "Same words."), (24, "same  words.")]
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, n int, gone string")
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(docs).collect()}
    assert [got[k]["n_removed"] > 0 for k in range(4)] == [False, True, True, True]
    assert got[10]["n_removed"] == 0 and got[11]["n_removed"] == 60
    assert got[12]["text"] == rows[6][1] and got[None]["text"] == "alone. here." and got[20]["text"] is None
    assert got[13]["n_removed"] == 0 and got[14]["n_removed"] == 3999
    assert got[23]["n_removed"] == 0 and got[24]["n_removed"] in (0, 1) and got[22]["n_removed"] == 0
    assert span_dedup.dedup_spans(docs.limit(0)).collect() == []


def test_decontamination_finds_other_parameters(spark):
    bench = spark.createDataFrame(
        [
            (1, "A train from Lisbon travels 120 km in 2 hours and then 60 km in 1 hour; how far does it go in all?"),
            (2, "Tom has 12 apples and gives 12 apples away to Ann before lunch so how many apples are left now?"),
            (3, ""), (4, None), (5, "capital of France"),
        ],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [
            (10, "Before. A train from Lisbon travels 120 km in 2 hours and then 60 km in 1 hour; how far does it go in all? After."),
            (11, "Some words. A train from Madrid travels 300 km in 5 hours and then 90 km in 4 hour; how far does it go in all? more"),
            (12, "Tom has 7 apples and gives 7 apples away to Ann before lunch so how many apples are left now?"),
            (13, "Tom has 7 apples and gives 3 apples away to Ann before lunch so how many apples are left now?"),
            (14, "The train was late and the apples were red, the capital was far and nobody knew how many hours were left."),
            (15, None), (16, ""), (17, "it is the capital of France they say"),
        ],
        "doc_id long, text string",
    )
    for most in (2_000_000, 0):  # with the hashes sent to the tasks, and without
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench, max_broadcast=most).collect()}
        assert {(10, 1), (11, 1), (12, 2), (17, 5)} <= found
        assert not {14, 15, 16} & {d for d, _ in found}
        assert (13, 2) not in found  # equal numbers of the item stand for different ones
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {13, 14, 15, 16}


def brute_windows(text, width):
    """Template tokens and their values, then the windows of a text by plain slicing."""
    known = decontaminate.Tokens()
    _, kind, raw = decontaminate.canonical(text, known)
    token = [decontaminate.value_of(w) if k == decontaminate.WORD else decontaminate.PLACEHOLDER[int(k)] for k, w in zip(kind, raw, strict=True)]
    value = [None if k == decontaminate.WORD else decontaminate.value_of(w) for k, w in zip(kind, raw, strict=True)]
    return {k: (tuple(token[k : k + width]), tuple(v for v in value[k : k + width] if v is not None)) for k in range(len(token) - width + 1) if any(v is None for v in value[k : k + width])}


def test_decontamination_equals_brute_force(spark):
    """At one place of a document windows add up, scattered ones don't, and slots are held together over all of a place."""
    item = "A train from Lisbon travels 120 km in 2 hours and then 60 km in 1 hour; how far does it go in all when the wind is strong and the driver rests for 15 minutes?"
    words = item.split()
    filler = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
    scattered = " ".join(" ".join(words[k : k + 7]) + " " + filler(90) for k in range(0, len(words) - 4, 3))
    shifted = " ".join([*words[:16], "indeed", "so", *words[16:]])
    torn = " ".join(words[:16]).replace("120", "7") + " now " + " ".join(words[16:]).replace("60", "8")
    texts = [item, filler(50) + " " + item + " " + filler(50), scattered, shifted, torn, item.replace("120", "300").replace("60", "90"), filler(300), None, "", (filler(400) + " ") * 40 + item, item]
    docs = spark.createDataFrame([(None if k == 10 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"item_id": F.lit("x"), "key": F.lit(1)})
    bench = spark.createDataFrame([(1, item), (2, "how far does it go in all"), (3, None)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_matched"], r["n_exact"]) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    want = set()
    for k, t in enumerate(texts):
        for i, b in ((1, item), (2, "how far does it go in all")):
            mine, its = brute_windows(t, 5), brute_windows(b, 5)
            lines = {}
            for at, (w, slots) in mine.items():
                for place, (v, own) in its.items():
                    if v == w:
                        lines.setdefault(at - place, []).append((place, slots == own, set(zip(own, slots, strict=True))))
            one = lambda pairs: len({a for a, _ in pairs}) == len(pairs)
            best = exact = 0
            size = max(len(its), 10)
            for tile in {x for s in lines for x in (s // size * 2, int((s + size / 2) // size) * 2 + 1)}:
                near = [v for s, v in lines.items() if tile in (s // size * 2, int((s + size / 2) // size) * 2 + 1)]
                fits = [v for v in near if one(set().union(*(p for *_, p in v)))]
                same = {p for v in near for p, e, _ in v if e}
                if one(set().union(*(p for v in fits for *_, p in v))):
                    n = len({p for v in fits for p, *_ in v} | {p for v in near if v not in fits for p, e, _ in v if e})
                else:
                    n = max([len({p for p, *_ in v}) for v in fits] + [len(same)])
                best, exact = max(best, n), max(exact, len(same))
            if best >= 0.8 * len(its):
                want.add((None if k == 10 else k // 2, i, best, exact))
    assert set(got) == want
    kept = [r["text"] for r in decontaminate.decontaminate(docs, bench.where("item_id = 1")).collect()]
    assert scattered in kept and None in kept and item not in kept and len(kept) < len(texts)
