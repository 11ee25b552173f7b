"""The phrase join on both of its paths against a search of every text for every term."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import normalize
from newsloom.operators import relational

RNG = random.Random(2)
WORDS = ["a", "ab", "Åre", "mål", "x9", "über", "real", "madrid", "IFK", "of", "the"]


@pytest.mark.parametrize("most_chars", [2_000_000, 0])
def test_both_paths_equal_a_search_of_every_pair(spark, most_chars):
    say = lambda n: RNG.choice([" ", "-", ", "]).join(RNG.choice(WORDS) for _ in range(n))
    texts = [(i, RNG.choice("fh"), say(RNG.randint(0, 40))) for i in range(120)] + [(500, "f", None), (501, "h", "--"), (502, "f", "a a a"), (502, "f", "a a a")]
    terms = [(i, RNG.choice("fh"), say(RNG.randint(1, 9))) for i in range(200)] + [(900, "f", ""), (901, "h", None), (902, "f", "a a"), (903, "f", "A a"), (904, "h", "nowhere")]
    x = spark.createDataFrame([(*r, "mine", "own") for r in texts], "id int, sport string, text string, _said string, _hits string")
    t = spark.createDataFrame(terms, "tid int, sport string, term string")
    norm = lambda df, c: [r[0] for r in df.select(normalize(F.col(c))).collect()]
    want = sorted(
        (i, tid, sport) for (i, sport, _), said in zip(texts, norm(x, "text"), strict=True) for (tid, of, _), term in zip(terms, norm(t, "term"), strict=True)
        if term and said and sport == of and f" {term} " in f" {said} "
    )
    got = relational.phrase_join(x, t, on=["sport"], most_chars=most_chars)
    assert got.columns == ["id", "sport", "text", "_said", "_hits", "tid", "term"]
    assert sorted((r["id"], r["tid"], r["sport"]) for r in got.collect()) == want and len(want) > 100
    assert {r["_said"] + r["_hits"] for r in got.collect()} == {"mineown"}
    assert relational.phrase_join(x, t.limit(0), on=["sport"], most_chars=most_chars).count() == 0
    assert relational.phrase_join(x.limit(0), t, on=["sport"], most_chars=most_chars).count() == 0


def shuffled(df):
    """Bytes that the stages of a query write to shuffles."""
    sc = df.sparkSession.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._gateway
    stages = lambda: store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    total = lambda: sum(found.apply(k).shuffleWriteBytes() for found in [stages()] for k in range(found.size()))
    before = total()
    rows = sorted(map(tuple, df.collect()))
    return rows, total() - before


def test_documents_and_all_items_cost_no_more_than_their_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    terms = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", F.col("text").alias("term"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    results = []
    for most_chars in (2_000_000, 0):
        began = time.time()
        rows, written = shuffled(relational.phrase_join(docs, terms, most_chars=most_chars).select("doc_id", "item_id"))
        results.append(rows)
        assert written < 3 * size and time.time() - began < 120
    assert results[0] == results[1] and results[0]
