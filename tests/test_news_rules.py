"""Rules and links on small rows of their own: edges, nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.errors import InvalidInput
from newsloom.functions import editorial, policy, relevance, text
from newsloom.operators import graph, linking, search, selection, stories

NOW = dt.datetime(2026, 9, 21, 12)


def column(spark, values, expression, schema="v string"):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression(F.col("v")).alias("x")).collect()]


def test_folding_of_compatibility_forms(spark):
    values = ["Łódź ﬁnal Ｆｕｌｌ x² Ωμέγα", "Škoda Čech Őr", None, "", "naïve ĳs"]
    assert column(spark, values, text.fold) == ["Łodz final Full x2 Ωμεγα", "Skoda Cech Or", "", "", "naive ijs"]


def test_trigrams_of_long_titles(spark):
    got = column(spark, ["ab", "", "a" * 20_000, "é😀b"], text.trigrams)
    assert got == [["  a", " ab", "ab ", "b  "], [], ["  a", " aa", "aaa", "aa ", "a  "], ["  é", " é😀", "é😀b", "😀b ", "b  "]]


def test_scope(spark):
    out = [policy.other_scope(text.normalize_policy(F.col("v"))), policy.irrelevant(F.col("v"))]
    values = ["Damian Andersson gör mål", "Damallsvenskan", "en dam i laget", "Nova Selin klar för AIK", "Nova Selin", "travet i dag", "fotboll", "", None]
    assert column(spark, values, lambda v: out[0]) == [False, True, True, True, False, False, False, False, False]
    assert column(spark, values, lambda v: out[1]) == [False, True, True, True, False, True, False, False, False]


def test_broken_urls_of_club_sources_are_told(spark):
    rows = spark.createDataFrame([("FeanOnline", "SC Heerenveen wint", "no url"), ("FeanOnline", "SC Heerenveen wint", None), ("Other", "x", "no url")], "s string, t string, u string")
    got = rows.select(policy.club_eligible(F.col("s"), F.col("t"), F.col("u"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("x")).collect()
    assert [r["x"] for r in got] == [None, True, True]


def test_candidates_stand_by_themselves(spark):
    values = ["Klart: ny back", "klartext", "målet", "formal", "HERE_WE_GO", "silly season", "", None]
    none = F.lit(None).cast("array<string>")
    assert column(spark, values, lambda v: editorial.candidate(v, F.lit(None).cast("string"), none)) == [True, False, True, False, True, True, False, False]


def test_model_answers(spark):
    good = '{"category": "transfer", "status": "confirmed", "badge": null, "breaking": true, "evidence": "klar f\u00f6r"}'
    values = [good, good.replace("true", '"true"'), good.replace('"status"', '"state"'), good[:-1] + ', "x": 1}', good.replace("klar", "nope"), "[]", "", None]
    got = column(spark, values, lambda v: editorial.model_result(v, F.lit("Isak klar för Liverpool"), F.lit(None).cast("string"))["category"])
    assert got == ["transfer", *[None] * 7]


def test_story_candidates_and_links(spark):
    m = lambda k: NOW - dt.timedelta(minutes=k)
    rows = [(1, "football", "Isak scores twice for Liverpool", m(0), ["a"], 1), (2, "football", "Isak scores for Liverpool again", m(170), ["a", "b"], 2), (3, "football", "Isak scores twice for Liverpool", m(190), ["a"], 3), (4, "hockey", "Isak scores", m(1), ["a"], 4), (5, "football", "Isak scores twice", None, ["a"], 5), (6, "football", "Isak scores twice", m(1), [], 6)]
    base = spark.createDataFrame(rows, "id int, sport string, title string, published_at timestamp, entity_ids array<string>, ordinal int").withColumn("slot", F.lit("x"))
    got = {(r["id"], r["other"]) for r in stories.story_candidates(base, base).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert stories.story_candidates(base.limit(0), base).collect() == []
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert {(r["item"], r["story"]) for r in stories.link_stories(pairs, base).collect()} == {(1, 3), (2, 3), (3, 3)}


def test_search(spark):
    rows = [("l", "football", "league", "Serie A", "serie-a", ["Italy"], 1), ("t", "football", "team", "Ängelholm", "angelholm", [], 2), ("z", "football", "team", "Zlatan FC", "zlatan", ["italy"], 3), ("p", "football", "player", "Ita Lund", "ita", None, 4)]
    entities = spark.createDataFrame(rows, "id string, sport string, type string, name string, slug string, aliases array<string>, ordinal int").withColumn("score", F.lit("own"))
    assert [(r["id"], r["score"]) for r in search.suggestions(entities, "football", "ITALY").orderBy("position").collect()] == [("l", 140), ("z", 140)]
    assert [r["id"] for r in search.search_entities(entities, "football", "", kind="team").collect()] == ["z", "t"]
    assert search.search_entities(entities, "football", "a").collect() == [] and search.suggestions(entities, "football", " ").collect() == []
    with pytest.raises(InvalidInput, match="sport"):
        search.search_entities(entities, "golf", "x")


def test_links_and_profiles(spark):
    columns = "item string, entity_id string, ordinal int"
    links = spark.createDataFrame([("i", "b", 2), ("i", "a", 1), ("i", "b", 3), ("j", "gone", 1)], columns)
    entities = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    got = {r["item"]: (r["entity_ids"], [e["name"] for e in r["entities"]]) for r in linking.item_entities(links, entities).collect()}
    assert got == {"i": (["a", "b"], ["A", "B"]), "j": (["gone"], [])}
    sources = spark.createDataFrame([("x sport x",), ("",), (None,)], "source string")
    profiles, aliases = spark.createDataFrame([("Sport", 2), ("X", 1)], "key string, ordinal int"), spark.createDataFrame([], "alias string, key string")
    assert {r["source"]: r["key"] for r in linking.source_profiles(sources, profiles, aliases, "d").collect()} == {"x sport x": "X", "": "d", None: "d"}


def test_favorites_and_regions(spark):
    assert column(spark, [["team:AIK, aik", None, "a,b,c,d,e"], [], None], linking.favorite_params, "v array<string>") == [["aik", "a", "b", "c", "d"], [], []]
    assert column(spark, ["IFK Göteborg", "Real Madrid Club", "AIK", "", None], linking.derived_aliases) == [["gifk", "goteborg"], ["rmc"], [], [], []]
    policies = F.struct(F.lit("regional").alias("scope"), F.lit("k").alias("region"), F.lit(True).alias("favorite_eligible"), F.array(F.lit("e")).alias("entity_ids"), F.array(F.lit("t")).alias("tokens"))
    none = F.array().cast("array<string>")
    assert column(spark, ["k", "m", None], lambda v: linking.regional_eligible(policies, v, none, none, F.lit(False))) == [True, False, False]


def test_duplicates_without_times_and_with_frequent_words(spark):
    m = lambda k: NOW - dt.timedelta(minutes=k)
    rows = [(1, "f", "Isak to Liverpool", "https://a.se/1", m(0)), (2, "f", "isak to liverpool!", "https://b.se/1", m(300)), (3, "f", "Isak to Liverpool", "https://c.se/1", m(400)), (4, "f", "Isak to Liverpool", "https://d.se/1", None), (5, "h", "Isak to Liverpool", "https://a.se/1?x", m(0)), (6, "f", "other words", "https://A.se/1/#y", m(10)), (7, "f", "", "", m(0))]
    articles = spark.createDataFrame(rows, "id int, sport string, title string, url string, published_at timestamp").withColumns({"key": F.lit(1), "slot": F.lit(1), "size": F.lit(1)})
    got = {(r["a"], r["b"], r["kind"]) for r in graph.similar_pairs(articles).collect()}
    assert got == {(1, 2, "title-similarity"), (2, 3, "title-similarity"), (1, 4, "title-similarity"), (2, 4, "title-similarity"), (3, 4, "title-similarity"), (1, 6, "canonical-url")}
    assert graph.similar_pairs(articles.limit(0)).collect() == []


def test_relevance_of_nothing(spark):
    articles = spark.createDataFrame([("1", "football", None, None, None, None)], "id string, sport string, title string, source string, tags array<string>, hits array<struct<entity_id:string,type:string,name:string,is_swedish:boolean>>")
    terms = spark.createDataFrame([], "sport string, kind string, term string")
    assert [tuple(r) for r in relevance.relevance(articles, terms).collect()] == [("1", 3, [])]
    assert column(spark, ['["a", ""]', "a|| b", " ", None, "[x"], relevance.label_list) == [["a"], ["a", "b"], [], [], ["[x"]]


def test_selections(spark):
    kind = "array<struct<type:string,is_swedish:boolean,confidence:double,name:string>>"
    hits = [[("team", True, 0.9, "t"), ("player", None, None, "p"), ("player", True, 0.1, "q"), ("player", True, 0.1, "r")], [("league", True, 1.0, "l")], [], None]
    assert column(spark, hits, lambda v: selection.anchor_entity(v)["name"], f"v {kind}") == ["q", None, None, None]
    choices = spark.createDataFrame([("d", "team", "1", "AIK", 1, 1), ("d", "team", "2", "aik", 2, 2), ("d", "team", "1", "Other", 3, 3), ("d", "player", "1", "AIK", 1, 4)], "device string, type string, entity_id string, label string, at int, ordinal int")
    got = [(r["ordinal"], r["position"]) for r in selection.recent_choices(choices, ["device"]).orderBy("position").collect()]
    assert got == [(3, 1), (2, 2), (4, 3)] and selection.recent_choices(choices.limit(0), ["device"]).collect() == []
