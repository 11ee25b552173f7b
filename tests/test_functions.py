from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import classify, editorial, policy, scoring
from newsloom.functions import text as X
from newsloom.operators.dedupe import NO_ASSESSMENT

NOW = dt.datetime(2026, 9, 21, 12)
HITS = "array<struct<entity_id:string,sport:string,type:string,name:string,is_swedish:boolean,is_abroad_core:boolean>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.normalize(F.lit("  Viktor Gyökeres—mål! 2-1 ")), "viktor gyokeres mal 2 1"),
        (lambda: X.normalize(F.lit(None).cast("string")), ""),
        (lambda: X.story_title(F.lit("JUST NU: Målet")), "malet"),
        (lambda: X.duplicate_title(F.lit("Breaking - Isak signs")), "isak signs"),
        (lambda: X.slug(F.lit(" Malmö FF!")), "malmo-ff"),
        (lambda: X.seed_slug(F.lit("Brighton & Hove")), "brighton-and-hove"),
        (lambda: X.canonical_url(F.lit("HTTPS://A.se/X/?q=1#f")), "https://a.se/x"),
        (lambda: X.contains_term(F.lit("the goal keeper"), F.lit("goal")), True),
        (lambda: X.contains_term(F.lit("the goals"), F.lit("goal")), False),
        (lambda: X.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")), 0.0),
        (lambda: X.title_similarity(F.lit("abc def"), F.lit("abc def")), 1.0),
        (lambda: X.distinct_ignoring_case(F.array(F.lit(" SHL"), F.lit("shl"), F.lit(""), F.lit("NHL"))), ["SHL", "NHL"]),
        (lambda: X.clamp_int(F.lit(float("nan")), 1, 9, 5), 5),
        (lambda: X.clamp_int(F.lit(-3.7), -3, 9, 5), -3),
        (lambda: X.time_ago(F.lit(125.0)), "2 h"),
        (lambda: X.is_uuid(F.lit("123e4567-e89b-42d3-a456-426614174000")), True),
        (lambda: X.round_half_up(F.lit(2.5)), 3),
        (lambda: X.match_score(F.lit("arsenal"), F.lit("ars")), 110),
        (lambda: classify.canonical_event(X.normalize(F.lit("Rött kort för Isak"))), "red_card"),
        (lambda: classify.angle(X.normalize(F.lit("Krönika: så var matchen"))), "analysis"),
        (lambda: classify.junior_team(F.lit("seger for u17 laget")), True),
        (lambda: editorial.event_key(F.lit(None).cast(NO_ASSESSMENT), F.lit("Nylander skadad"), F.array().cast("array<string>"), F.lit("2026-01-02").cast("date")), "william_nylander|injury|2026-01-02"),
        (lambda: policy.sport_of(F.lit("allsvenskan och straff")), "football"),
        (lambda: policy.sport_of(F.lit("ord utan sport")), None),
        (lambda: editorial.exceptional_success(F.lit("Årets mål")), True),
        (lambda: editorial.exceptional_success(F.lit("Krönika: en succé")), False),
        (lambda: editorial.exceptional_success(F.lit("Lista: topp 10")), False),
    ],
)
def test_text_functions(spark, column, want):
    assert value(spark, column()) == want


def article(spark, **changes):
    row = {
        "sport": "football", "title": "Alexander Isak discusses Liverpool ahead of Premier League match", "source": "BBC Sport", "tags": ["Premier League"], "priority": 0,
        "published_at": NOW - dt.timedelta(minutes=30), "editorial": None, "local_score": 0.0, "duplicate_count": 0, "event_intensity": 0, "profile_authority": 0.95, "profile_category": None,
        "entity_hits": [("p", "football", "player", "Alexander Isak", True, True), ("t", "football", "team", "Liverpool", False, False), ("l", "football", "league", "Premier League", False, False)],
    } | changes
    schema = f"sport string, title string, source string, tags array<string>, priority int, published_at timestamp, editorial struct<category:string,status:string,breaking:boolean>, local_score double, duplicate_count int, event_intensity int, profile_authority double, profile_category string, entity_hits {HITS}"
    names = [p.split(" ")[0] for p in "sport,title,source,tags,priority,published_at,editorial,local_score,duplicate_count,event_intensity,profile_authority,profile_category,entity_hits".split(",")]
    return spark.createDataFrame([tuple(row[n] for n in names)], schema)


def test_golden_score(spark):
    r = scoring.score_articles(article(spark), F.lit(NOW), profiles=True).first()
    got = (r["recency"], r["swedish_player"], r["swedish_abroad"], r["source_authority"], r["source_league_fit"], r["core_contribution"], r["score"])
    assert got == (18, 8, 14, 10, 8, 16, 74.0)


def test_favorites_and_penalties(spark):
    favorites = [{"entity_id": "t", "sport": "football", "type": "team", "label": "Liverpool"}, {"entity_id": "x", "sport": "football", "type": "league", "label": "X"}]
    r = scoring.score_articles(article(spark), F.lit(NOW), favorites=favorites, profiles=True).first()
    assert r["favorite_affinity"] == 26 and r["score"] == 100
    r = scoring.score_articles(article(spark, title="Top 10 greatest: mock draft", entity_hits=[], tags=[], duplicate_count=9), F.lit(NOW), profiles=True).first()
    assert (r["evergreen_penalty"], r["duplicate_penalty"], r["foreign_football_penalty"], r["source_multiplier"]) == (15, 12, 16, 0.05)


def test_league_name_keeps_its_case(spark):
    hit = lambda n: [("l", "football", "league", n, False, False)]
    assert scoring.score_articles(article(spark, entity_hits=hit("Allsvenskan")), F.lit(NOW)).first()["swedish_league"] == 0
    assert scoring.score_articles(article(spark, entity_hits=hit("allsvenskan")), F.lit(NOW)).first()["swedish_league"] == 12
