from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.operators import favorites, push
from newsloom.plans import feed

NOW = dt.datetime(2026, 9, 21, 12)
ENTITIES = [
    ("L", "football", "league", "Premier League", None, None, False), ("T", "football", "team", "Arsenal", None, "L", False), ("S", "football", "team", "AIK", None, None, True),
    ("g", "football", "player", "Viktor Gyokeres", "T", None, True), ("o", "football", "player", "Martin Odegaard", "T", None, False), ("k", "football", "staff", "Coach", "S", None, False),
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "id string, sport string, type string, name string, team_id string, league_id string, is_swedish boolean")


def test_expand(spark, entities):
    follows = spark.createDataFrame([("d", "T"), ("e", "L"), ("f", "S"), ("f", "k")], "device string, entity_id string")
    got = {(r["device"], r["entity_id"]): (r["weight"], r["direct"]) for r in favorites.expand(follows, entities).collect()}
    assert got == {("d", "T"): (200, True), ("d", "g"): (180, False), ("e", "L"): (150, True), ("e", "g"): (140, False), ("f", "S"): (200, True), ("f", "k"): (180, True)}
    context = favorites.context_score(spark.createDataFrame([("d", "g")], "device string, entity_id string"), entities)
    assert {r["entity_id"] for r in context.collect()} == {"T", "o"}


def test_best_favorite_ignores_shadowed_alias(spark, entities):
    follows = spark.createDataFrame([("d", "g", 300, True), ("d", "T", 200, True)], "device string, entity_id string, weight int, direct boolean")
    links = spark.createDataFrame([("1", "g", "Viktor"), ("1", "T", "Viktor Arsenal"), ("2", "g", "Gyokeres"), ("2", "T", "Arsenal")], "item string, entity_id string, alias string")
    got = {r["item"]: r["entity_id"] for r in favorites.best_favorite(follows, links, entities).collect()}
    assert got == {"1": "T", "2": "g"}


def test_plan(spark):
    m = lambda k: NOW - dt.timedelta(minutes=k)
    rows = [("a", "1", m(900), m(5), m(9)), ("a", "2", m(900), m(5), m(500)), ("b", "1", m(1), m(30), m(9)), ("c", "1", m(900), m(5), m(9)), ("d", "1", m(900), m(5), m(9)), ("e", "1", m(900), m(5), m(9))]
    pairs = spark.createDataFrame([(*r, True) for r in rows], "device string, item string, since timestamp, fetched_at timestamp, published_at timestamp, direct boolean")
    log = spark.createDataFrame([("c", "1", m(20)), ("d", "9", m(200)), *[("e", str(k), m(k)) for k in (5, 6, 7)]], "device string, item string, sent_at timestamp")
    stories = spark.createDataFrame([("1", "s"), ("9", "s")], "item string, story string")
    got = {(r["device"], r["item"]): r["reason"] for r in push.plan(pairs, log, stories, F.lit(NOW)).collect()}
    assert got == {("a", "1"): "send", ("a", "2"): "too-old", ("b", "1"): "before-subscription", ("c", "1"): "already-delivered", ("d", "1"): "story-delivered", ("e", "1"): "rate-limited"}


def test_feed_and_ingest(spark):
    hits = "array<struct<entity_id:string,sport:string,type:string,name:string,is_swedish:boolean,is_abroad_core:boolean>>"
    rows = [(str(k), "football", f"Allsvenskan news number {k}", f"https://a.se/{k}", f"s{k % 2}", NOW - dt.timedelta(minutes=10 * k), ["allsvenskan"], 80, [], None, 0.0, None) for k in range(8)]
    df = spark.createDataFrame(rows, f"id string, sport string, title string, url string, source string, published_at timestamp, tags array<string>, priority int, entity_hits {hits}, editorial struct<category:string,status:string,breaking:boolean>, local_score double, event_key string")
    got = feed.feed(df, feed.FeedRequest("football", limit=5), F.lit(NOW)).collect()
    assert len(got) == 5 and [r["position"] for r in sorted(got, key=lambda r: r["position"])] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="limit"):
        feed.FeedRequest("football", limit=99)
    items = spark.createDataFrame([("f", 1, "A", "u1", NOW), ("f", 2, "", "u2", NOW), ("f", 3, "C", "u3", NOW - dt.timedelta(days=2)), ("f", 4, "D", "u4", None), ("f", 5, "E", "u1", NOW)], "feed string, ordinal int, title string, url string, published_at timestamp")
    new, counts = feed.ingest(items, spark.createDataFrame([("u9",)], "url string"), F.lit(NOW))
    assert {r["url"]: r["ordinal"] for r in new.collect()} == {"u1": 1, "u4": 4}
    assert {r["stage"]: r["n"] for r in counts.collect()} == {"required": 1, "age": 1, "kept": 3}
