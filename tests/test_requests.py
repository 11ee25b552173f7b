"""Native folds against the frame functions, the funnel against a loop, standing queries against every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import folds, ingest_funnel, percolate, rank


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(1)
    rows = []
    for r in range(1000):
        for p in range(1, rng.choice([1, 2, 5, 17, 40]) + 1):
            rows.append((r, p, f"i{p}", rng.choice(["a", "b", " B ", "c", "", None]), rng.choice([0.0, 1.5, 7.0, 9.5, 30.0]), rng.choice([True, True, False, None])))
    return spark.createDataFrame(rows, "request int, position int, item string, source string, score double, favorite_match boolean").cache()


@pytest.mark.parametrize("name, options", [
    ("balance_sources", {}), ("balance_sources", {"gap": 0, "protect": 0, "lookahead": 2, "first": 10}), ("balance_favorites", {}), ("balance_favorites", {"streak": 1, "lookahead": 3}),
    ("interleave_sources", {}), ("interleave_sources", {"first": 4, "lookahead": 3, "block": 1}),
])
def test_folds_equal_frames(requests, name, options):
    order = lambda df: sorted((r["request"], r["position"], r["item"]) for r in df.collect())
    native = getattr(folds, name)(requests, ["request"], **options)
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert order(native) == order(getattr(rank, name)(requests, ["request"], **options))
    assert native.columns == requests.columns
    assert getattr(folds, name)(requests.limit(0), ["request"], **options).count() == 0


def funnel(items):
    """The stages item by item."""
    out: dict = {}
    for feed, ordinal, required, fresh, relevant, verified, resolution, existing, sample in sorted(items, key=lambda i: (str(i[0]), i[1])):
        f = out.setdefault(feed, {"raw": 0, "place": 0, "dup": 0, **{s: [] for s in ingest_funnel.STAGES}})
        f["raw"] += 1
        stage = None if required else "missing_required_fields"
        stage = stage or (None if fresh else "age") or (None if relevant else "irrelevant")
        if stage is None:
            f["place"] += 1
            stage = "cap" if f["place"] > 80 else None if verified else "source_sport_verification"
        if stage is None and resolution != "match":
            stage = {"no-signal": "no_sport_signal", "mismatch": "sport_mismatch"}.get(resolution, "unknown_sport_reason")
        if stage:
            f[stage].append(sample)
        else:
            f["dup"] += bool(existing)
    return out


def test_funnel_counts_and_samples(spark):
    rng = random.Random(4)
    flag = lambda p: rng.choices([True, False, None], [p, 1 - p, 0.02])[0]
    items = [(f, k, flag(0.95), flag(0.9), flag(0.9), flag(0.9), rng.choice(["match"] * 5 + ["no-signal", "mismatch", "odd", None]), flag(0.3), rng.choice([f"s{k}", None, ""])) for f in ("one", "two", None) for k in range(rng.randint(60, 260))]
    rng.shuffle(items)
    df = spark.createDataFrame(items, "feed string, ordinal int, required boolean, fresh boolean, relevant boolean, verified boolean, resolution string, existing boolean, sample string")
    c = F.col
    marked = ingest_funnel.staged(df, c("required"), c("fresh"), c("relevant"), c("verified"), c("resolution"))
    frame = ingest_funnel.counters(marked, c("existing"), c("sample"))
    assert frame._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2  # the plan as such and as it starts
    want = funnel(items)
    for r in frame.collect():
        f, left = want[r["feed"]], r["raw_fetched"]
        assert left == f["raw"] and r["duplicate_or_existing"] == f["dup"]
        names = {"missing_required_fields": "required_fields", "age": "age_filter", "irrelevant": "irrelevant_filter", "cap": "max_items_cap", "source_sport_verification": "source_sport_verification"}
        for s in ingest_funnel.STAGES:
            assert r["capped_away" if s == "cap" else f"blocked_by_{s}"] == len(f[s])
            left -= len(f[s])
            if s in names:
                assert r[f"after_{names[s]}"] == left
            if s in ingest_funnel.SAMPLED:
                assert r[f"sample_{s}"] == [x for x in f[s][:5] if x]
        assert r["after_resolved_sport"] == left
    kept, watch = ingest_funnel.observed(marked, c("existing"), "one run")
    kept = kept.collect()
    seen = watch.get
    assert (seen["raw_fetched"], seen["passed"], seen["duplicate_or_existing"]) == (len(items), len(kept), sum(f["dup"] for f in want.values()))
    assert all(seen[f"blocked_by_{s}"] == sum(len(f[s]) for f in want.values()) for s in ingest_funnel.STAGES)


def test_standing_queries_equal_every_pair(spark):
    rng = random.Random(6)
    words = ["ifk", "aik", "Malmö", "Real", "Madrid", "isak", "alex", "cup", "liga", "tre"]
    entities = [(i, ["league", "team", "player", "staff"][i % 4], " ".join(rng.sample(words, rng.randint(1, 2))), rng.choice([None, 1, 5, 9]), rng.choice([None, 0, 4, 8])) for i in range(24)]
    aliases = [(entities[i][2], rng.choice(words) + " fc") for i in (1, 5, 9)] + [("nobody", "isak")]
    articles = [(k, " ".join(rng.choices([*words, "och", "fc"], k=6)), rng.choice([None, [], ["Real Madrid"], ["AIK FC", "x"]])) for k in range(60)] + [(99, None, None)]
    links = [(rng.randrange(60), rng.randrange(24)) for _ in range(40)] + [(7, None), (1000, 3)]
    favorites = [(d, e, n) for n, (d, e) in enumerate({(f"d{rng.randrange(5)}", rng.randrange(30)) for _ in range(40)})]
    df = spark.createDataFrame
    e = df(entities, "id int, type string, name string, team_id int, league_id int")
    a, n, ln = df(aliases, "name string, alias string"), df(articles, "item int, title string, tags array<string>"), df(links, "item int, entity_id int")
    f, s = df(favorites, "device string, entity_id int, ordinal int"), df([("d1", True), ("d2", False)], "device string, enabled boolean")
    norm = lambda t: " ".join("".join(ch if ch.isalnum() else " " for ch in t.lower().replace("ö", "o")).split())
    of = {x[0]: x for x in entities}
    want = {}
    for key, title, tags in articles:
        said = f" {norm(' '.join([title or '', *(tags or [])]))} "
        tagged = {t for i, t in links if i == key}
        for fav in {x[1] for x in favorites} & of.keys():
            _, kind, name, team, _ = of[fav]
            more = [x for x in entities if kind == "team" and x[1] == "player" and x[3] == fav or kind == "league" and x[4] == fav or kind == "player" and x[1] == "team" and x[0] == team]
            names = {name, *(x[2] for x in more)} | {al for nm, al in aliases for x in [*more, of[fav]] if x[1] == "team" and x[2] == nm}
            if fav in tagged:
                want[key, fav] = "tagged"
            elif tagged & {x[0] for x in more}:
                want[key, fav] = "related"
            elif any(f" {norm(t)} " in said for t in names):
                want[key, fav] = "text"
    related, terms = percolate.standing_queries(f, e, a)
    got = percolate.matches(n, ln, related, terms)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["item"], r["entity_id"]): r["reason"] for r in got.collect()} == want and set(want.values()) == {"tagged", "related", "text"}
    for r in percolate.audience(n, ln, f, e, a, s).collect():
        mine = [(x, of[x][2]) for d, x, _ in sorted(favorites, key=lambda x: x[2]) if d == r["device"] and (r["item"], x) in want]
        assert r["entity_ids"] == [x for x, _ in mine] and r["names"] == list(dict.fromkeys(nm for _, nm in mine)) and r["subscribed"] == (r["device"] == "d1")
        assert r["reason"] == min((want[r["item"], x] for x, _ in mine), key=percolate.REASONS.index)


def test_audience_has_every_pair_across_slices_and_parts(spark, monkeypatch):
    """Null keys, repeated favourites, entities of several names, profiles of many articles and entities of many devices."""
    rng = random.Random(9)
    entities = [(e, "staff", n) for e in range(8) for n in ([f"n{e}", f"m{e}"] if e == 3 else [None] if e == 5 else ["same"] if e > 5 else [f"n{e}"])]
    links = [(item, e) for item in [*range(60), None] for e in rng.choice([[0], [1, 3], [2, 5, 6, 7], [3]])] + [(1, 99)]
    favorites = [(d, e, rng.choice([None, 1, 2, 3])) for d in [*(f"d{k}" for k in range(25)), None] for e in rng.choices([*range(8), None, 50], k=rng.randint(1, 9))]
    df = spark.createDataFrame
    ent = df([(e, k, n, None, None) for e, k, n in entities], "id int, type string, name string, team_id int, league_id int")
    articles, ln = df([(k, "", None) for k in [*range(60), None]], "item int, title string, tags array<string>"), df(links, "item int, entity_id int")
    # An article without a key is linked to nothing, but its title says terms.
    articles = articles.withColumn("title", F.when(F.col("item").isNull(), "om n1 och same"))
    f, s = df(favorites, "device string, entity_id int, ordinal int"), df([("d1", True), ("d1", True), ("d2", False), (None, True)], "device string, enabled boolean")
    about = {k: {e: "tagged" for i, e in links if i == k and e < 8} for k in range(60)} | {None: {1: "text", 6: "text", 7: "text"}}
    want = {}
    for item, of in about.items():
        for d in {x[0] for x in favorites}:
            ids = list(dict.fromkeys(e for _, e in sorted((-1 if o is None else o, e) for x, e, o in favorites if x == d and e in of)))
            names = list(dict.fromkeys(n for i in ids for n in sorted((n for e, _, n in entities if e == i), key=str)))
            if ids:
                want[d, item] = (ids, names, "tagged" if item is not None else "text", d == "d1")
    for sizes in ({}, {"SLICE": 3, "PART": 2, "PARTS": 4}):
        for name, value in sizes.items():
            monkeypatch.setattr(percolate, name, value)
        rows = percolate.audience(articles, ln, f, ent, df([], "name string, alias string"), s).collect()
        got = {(r["device"], r["item"]): (r["entity_ids"], r["names"], r["reason"], r["subscribed"]) for r in rows}
        assert got == want and len(rows) == len(want)
