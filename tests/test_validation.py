"""Typed checks of plans' input."""

from __future__ import annotations

import math

import pytest

from newsloom.errors import InvalidArticle, InvalidConfig, InvalidInput
from newsloom.plans import validation as V


def test_candidates(spark):
    good = spark.createDataFrame([("https://a", ["x"]), ("https://b", None)], "url string, entities array<string>")
    assert V.candidates(good, "hockey").count() == 2
    with pytest.raises(InvalidInput, match="football or hockey"):
        V.candidates(good, "golf")
    with pytest.raises(InvalidInput, match="entities is string"):
        V.candidates(good.selectExpr("url", "'x' AS entities"), "hockey")
    with pytest.raises(InvalidInput, match="no column url"):
        V.candidates(good.select("entities"), "hockey")
    for url in (None, "", "  "):
        with pytest.raises(InvalidArticle, match="a url") as told:
            V.candidates(good.unionByName(spark.createDataFrame([(url, ["y"])], good.schema)), "football")
        assert told.value.code == "INVALID_ARTICLE" and told.value.details["row"]["entities"] == ["y"]


def test_ranked(spark):
    schema = "id string, source string, score double"
    assert V.ranked(spark.createDataFrame([("1", "", 0.0)], schema)).count() == 1
    for row, rule in ((("", "a", 1.0), "an id"), ((None, "a", 1.0), "an id"), (("1", None, 1.0), "a source"), (("1", "a", math.nan), "finite"), (("1", "a", math.inf), "finite"), (("1", "a", None), "finite")):
        with pytest.raises(InvalidArticle, match=rule):
            V.ranked(spark.createDataFrame([("0", "b", 1.0), row], schema))
    with pytest.raises(InvalidInput, match="score is string"):
        V.ranked(spark.createDataFrame([("1", "a", "1")], "id string, source string, score string"))


def test_balancing_options():
    assert V.SourceBalancing(gap=0, drop=0.5).lookahead == 10
    for bad in ({"gap": -1}, {"drop": math.inf}, {"lookahead": math.nan}, {"protect": "2"}, {"first": True}):
        with pytest.raises(InvalidConfig, match=next(iter(bad))):
            V.SourceBalancing(**bad)
