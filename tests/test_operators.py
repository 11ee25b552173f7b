from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import dedupe, graph, rank, relational

T0 = dt.datetime(2026, 9, 21, 12)


def feed(spark, rows):
    return spark.createDataFrame([("r", k, s, float(v), f, k) for k, (s, v, f) in enumerate(rows, 1)], "request string, id int, source string, score double, favorite_match boolean, position int")


def order(df):
    return [r["id"] for r in df.orderBy("position").collect()]


def test_balance_sources(spark):
    rows = feed(spark, [("a", 50, False), ("a", 49, False), ("a", 48, False), ("b", 45, False), ("c", 20, False)])
    assert order(rank.balance_sources(rows, ["request"])) == [1, 2, 4, 3, 5]


def test_balance_favorites(spark):
    rows = feed(spark, [("a", 9, True), ("a", 8, True), ("a", 7, True), ("b", 6, False), ("c", 5, True)])
    assert order(rank.balance_favorites(rows, ["request"])) == [1, 2, 4, 3, 5]


def test_hybrid_order_jumps_one_bucket(spark):
    rows = [("r", k, T0 - dt.timedelta(minutes=m), float(s), 80, False, False, None, False, True, None, False, k) for k, (m, s) in enumerate([(20, 20), (55, 50), (120, 300)], 1)]
    df = spark.createDataFrame(rows, "request string, id int, published_at timestamp, score double, priority int, favorite_match boolean, favorite_context boolean, favorite_context_score int, is_local boolean, has_swedish_player boolean, editorial_tier int, is_top_league boolean, position int")
    got = order(rank.hybrid_order(df, ["request"], F.lit(T0)))
    assert set(got) == {1, 2, 3} and got.index(2) < got.index(1)


def test_collapse_stories(spark):
    rows = [("r", 1, "s", False, 0.5, T0, 1), ("r", 2, "s", False, 0.9, T0, 2), ("r", 3, "s", True, 0.1, T0, 3), ("r", 4, "u", False, 0.1, T0, 4)]
    df = spark.createDataFrame(rows, "request string, id int, story string, pinned boolean, preference double, published_at timestamp, position int")
    got = {r["story"]: (r["id"], r["position"]) for r in rank.collapse_stories(df, ["request"]).collect()}
    assert got == {"s": (3, 1), "u": (4, 4)}


def items(spark, rows):
    full = [("r", str(k), k, t, f"u{k}", s, T0 - dt.timedelta(minutes=m), q, q, e, [], e) for k, (t, s, m, q, e) in enumerate(rows)]
    return spark.createDataFrame(full, "request string, id string, ordinal int, title string, url string, source string, published_at timestamp, quality double, preference double, entities array<string>, teams array<string>, people array<string>")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("Isak klar for Liverpool", "a", 0, 0.5, []), ("Isak klar for Liverpool", "a", 600, 0.5, [])], ["accepted", "same-source-title"]),
        ([("Isak klar for Liverpool", "a", 0, 0.5, []), ("Isak klar for Liverpool nu", "b", 5, 0.5, [])], ["accepted", "cross-source"]),
        ([("Isak klar for Liverpool", "a", 0, 0.5, []), ("Isak klar for Liverpool nu", "b", 5, 0.9, [])], ["replaced", "accepted"]),
        # Titles with a cue and no assessment have no event yet; those of an injury have one by their words.
        ([("Isak signs deal", "a", 0, 0.5, ["p"]), ("Forward transfer official", "b", 5, 0.5, ["p"])], ["accepted", "accepted"]),
        ([("Isak injury", "a", 0, 0.5, ["p"]), ("Forward missar derby", "b", 5, 0.5, ["p"])], ["accepted", "cross-source"]),
        ([("Seger i u17 serien", "a", 0, 0.5, []), ("", "b", 5, 0.5, [])], ["junior", "required"]),
    ],
)
def test_sequential_dedupe(spark, rows, want):
    got = dedupe.sequential_dedupe(items(spark, rows), ["request"], F.lit("football"))
    assert [r["verdict"] for r in got.orderBy("ordinal").collect()] == want


def test_similar_pairs_equal_brute_force(spark):
    titles = ["Isak signs for Liverpool today", "Isak signs for Liverpool", "Isak signs for Liverpool today!", "Other news", "other  news", "Hockey starts"]
    rows = [(k, "football", t, f"https://a.se/{k}", T0 + dt.timedelta(hours=7 * (k == 4))) for k, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id int, sport string, title string, url string, published_at timestamp")
    got = {(r["a"], r["b"]) for r in graph.similar_pairs(df, 0.7).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}
    groups = {r["id"]: r["duplicate_count"] for r in graph.duplicate_groups(df, threshold=0.7).collect()}
    assert groups == {0: 2, 1: 2, 2: 2}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 91: 90}


def test_relational(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, ordinal int")
    assert {(r["k"], r["v"], r["ordinal"]) for r in relational.last_position_wins(rows, ["k"]).collect()} == {(1, "b", 1), (2, "c", 3)}
    assert relational.single(rows.where("k = 2")).first()["v"] == "c"
    with pytest.raises(Exception, match="expected one row"):
        relational.single(rows).collect()
    found = relational.phrase_join(spark.createDataFrame([(1, "Real Madrid vinner!"), (2, "realmadrid")], "id int, text string"), spark.createDataFrame([("real madrid",)], "term string"))
    assert [r["id"] for r in found.collect()] == [1]
    log = spark.createDataFrame([("d", T0 + dt.timedelta(seconds=s)) for s in (0, 100, 700)], "device string, at timestamp")
    assert [r["n"] for r in relational.trailing_counts(log, "device", "at", {"n": 600}).orderBy("at").collect()] == [1, 2, 2]


def test_phrase_join_finds_terms_of_any_length(spark):
    long = "one two three four five six seven eight"
    texts = spark.createDataFrame([(1, f"Now {long}, and {long}"), (2, "one two three four five six seven"), (3, "one two three four five six sevenfold eight")], "id int, text string")
    terms = spark.createDataFrame([(long,), ("six seven",)], "term string")
    got = sorted((r["id"], r["term"]) for r in relational.phrase_join(texts, terms, most_words=3).collect())
    assert got == [(1, long), (1, "six seven"), (2, "six seven")]


def test_distinct_ignoring_case_keeps_first_of_many(spark):
    """The work doesn't grow with the square of the list: 300,000 different words are one row."""
    words = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(599_999)), lambda i: F.concat(F.when(i % 2 == 0, F.lit("W")).otherwise(F.lit("w")), (i % 300_000).cast("string"))).alias("w"))
    got = words.select(text.distinct_ignoring_case(F.col("w")).alias("d")).first()["d"]
    assert got == [("W" if i % 2 == 0 else "w") + str(i) for i in range(300_000)]
