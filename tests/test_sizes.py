"""Joins make no more rows than inputs and results have, however often a value is repeated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import percolate, relational, stories


def joined(df):
    """The result, and the most rows that a join of its plan has made."""
    rows = df.collect()

    def most(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(plan.executedPlan())
        if name.endswith("QueryStage"):
            return most(plan.plan())
        made = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
        below = plan.children()
        return max([made, *(most(below.apply(k)) for k in range(below.size()))])

    return rows, most(df._jdf.queryExecution().executedPlan())


def test_a_spot_is_compared_once(spark):
    at = lambda d, key, n, step: d.range(n).select(F.col("id").alias(key), (F.col("id") % 2 * step).cast("double").alias("lat"), F.lit(10.0).alias("lng"))
    rows, most = joined(relational.nearest(at(spark, "p", 2000, 20), at(spark, "q", 600, 20.1), "p", "q", 50))
    assert {(r["p"] % 2, r["q"]) for r in rows} == {(0, 0), (1, 1)} and len(rows) == 2000 and most <= 2000
    assert round({r["p"]: r["km"] for r in rows}[1], 2) == 11.12


def test_equal_articles_are_one_class(spark):
    noon = dt.datetime(2024, 1, 5, 12)
    rows = [(k, "football", "Isak scores twice", noon, ["a", "b"], 900 - k) for k in range(900)] + [(1000, "football", "Isak scores once", noon + dt.timedelta(hours=3), ["b", None], 0)]
    base = spark.createDataFrame(rows, "id int, sport string, title string, published_at timestamp, entity_ids array<string>, ordinal int")
    found, most = joined(stories.story_candidates(base, base))
    got = {}
    for r in found:
        got.setdefault(r["id"], {})[r["position"]] = r["other"]
    assert most < 10_000 and len(got) == 901 and got[5] == {1: 899, 2: 898, 3: 897} and got[898] == {1: 899, 2: 897, 3: 896} and got[1000] == {1: 899, 2: 898, 3: 897}


def test_articles_of_one_profile_look_up_devices_once(spark):
    df = spark.createDataFrame
    entities = df([(0, "league", "Serie", None, None), (1, "team", "Malmö", None, 0), (2, "player", "Isak", 1, 0)], "id int, type string, name string, team_id int, league_id int")
    articles = df([(k, f"nyhet {k}", None) for k in range(200)], "item int, title string, tags array<string>")
    links, favorites = df([(k, 2) for k in range(200)], "item int, entity_id int"), df([(f"d{d}", e, 3 * d + 2 - e) for d in range(30) for e in range(3)], "device string, entity_id int, ordinal int")
    found = percolate.audience(articles, links, favorites, entities, df([], "name string, alias string"), df([("d3", True)], "device string, enabled boolean"))
    rows, most = joined(found)
    assert len(rows) == 6000 and {tuple(r["entity_ids"]) for r in rows} == {(2, 1, 0)} and {r["reason"] for r in rows} == {"tagged"} and sum(r["subscribed"] for r in rows) == 200
    assert most <= 6000


def test_devices_and_profiles_meet_without_a_shuffle_of_pairs(spark):
    """A row for each profile and device is the result's business: what is shuffled is devices by favourite, and profiles by entity."""
    df = spark.createDataFrame
    pairs = [(a, b) for a in range(12) for b in range(a)]
    entities = df([(e, "staff", f"name{e}", None, None) for e in range(12)], "id int, type string, name string, team_id int, league_id int")
    articles = df([(k, "nyhet", None) for k in range(len(pairs))], "item int, title string, tags array<string>")
    links = df([(k, e) for k, p in enumerate(pairs) for e in p], "item int, entity_id int")
    favorites = df([(f"d{d}", e, e) for d in range(200) for e in range(12)], "device string, entity_id int, ordinal int")
    found = percolate.audience(articles, links, favorites, entities, df([], "name string, alias string"), df([], "device string, enabled boolean"))
    rows = found.collect()
    assert {(r["device"], r["item"], tuple(r["entity_ids"])) for r in rows} == {(f"d{d}", k, (b, a)) for d in range(200) for k, (a, b) in enumerate(pairs)} and len(rows) == 13_200

    def moved(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return moved(plan.executedPlan())
        if name.endswith("QueryStage"):
            return moved(plan.plan())
        wrote = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        below = plan.children()
        return max([wrote, *(moved(below.apply(k)) for k in range(below.size()))])

    assert 0 < moved(found._jdf.queryExecution().executedPlan()) <= 2400


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    texts = spark.range(40).select("id", F.concat(F.repeat(F.lit("long "), 20_000), F.lit("aik")).alias("text"))
    found = relational.phrase_join(texts, spark.createDataFrame([("AIK",)], "term string"))
    assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20 and found.count() == 40


def test_duplicate_members_join_urls_once(spark, monkeypatch):
    """Which members have a url pair is read from the pairs, which are joined and written once."""
    from newsloom.operators import graph
    from newsloom.plans import registry

    calls, joined = [], graph.same_urls
    monkeypatch.setattr(graph, "same_urls", lambda *a, **k: calls.append(1) or joined(*a, **k))
    got = registry.QUERIES["a03_duplicate_members"](spark, "/root/testdata/sf0.01").collect()
    assert len(calls) == 1 and len({r["id"] for r in got}) == len(got) == 527 and any(r["by_url"] for r in got)
