"""Rewritten text rules say what the plain ones say, and work a text out once."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from newsloom.functions import classify, policy
from newsloom.functions import text as X


def test_normalising_equals_its_steps(spark):
    rng = random.Random(8)
    signs = [*"abzAZ09 \t\n\r'-_.,:!åäöÉǿİǆﬁﬃĲⅠ中б٣€  \U0001d400", "ß", "æ"]
    values = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(400)] + [None, "", " ", "plain text", "Å"]
    folded = F.translate(X.text(F.col("v")), X.ACCENTED, X.PLAIN)
    for letter, plain in X.LIGATURES.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    folded = F.regexp_replace(folded, "[\\u0300-\\u036f]", "")
    steps = lambda keep: X.collapse(F.regexp_replace(F.lower(folded), rf"[^\p{{L}}\p{{N}}\s{keep}]", " "))
    v = F.col("v")
    for r in spark.createDataFrame([(v,) for v in values], "v string").select(X.fold(v), folded, X.normalize(v), steps(""), X.normalize_policy(v), steps("'-")).collect():
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5]


def test_terms_equal_patterns(spark):
    rng = random.Random(9)
    terms = sorted({policy.plain(t) for t in policy.CONTENT_SIGNALS + policy.EXCLUDED_SPORTS})
    values = [" ".join(rng.choices([*terms, "x", "league", "death", "a"], k=rng.randrange(6))) for _ in range(300)]
    one, more = "|".join(t for t in terms if " " not in t), "|".join(t for t in terms if " " in t)
    signals = policy.DIRECT_SIGNALS["hockey"] + policy.DIRECT_SIGNALS["football"]
    some = ["golf", "nhl", "formel 1"]
    v = F.col("v")
    for said, many, few, n in spark.createDataFrame([(v,) for v in values], "v string").select("v", policy.contains_any(v, terms), policy.contains_any(v, some), policy.count_of(v, signals)).collect():
        assert many == bool(re.search(f"(?:^| )(?:{one})(?: |$)", said) or re.search(more, said))
        assert few == bool(re.search("(?:^| )(?:golf|nhl)(?: |$)|formel 1", said))
        assert n == sum(f" {policy.plain(t)} " in f" {said} " if " " not in policy.plain(t) else policy.plain(t) in said for t in signals)


def test_a_text_is_normalised_once(spark):
    rows = spark.createDataFrame([("Damallsvenskan startar",), ("AIK",), (None,)], "v string")
    found = rows.select(policy.irrelevant(F.col("v")).alias("irrelevant"), classify.substring_any(F.col("v"), ["a", "ab", "b", "b"]).alias("any"))
    assert [r["irrelevant"] for r in found.collect()] == [True, False, False]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2 and plan.count("Contains(v") == 2


def test_each_word_out_of_scope_has_a_stem():
    words = re.search(r"\((.*)\)", policy.OTHER_SCOPE_WORDS)[1].split("|")
    assert len(words) > 10 and all(any(stem in w for stem in policy.OTHER_SCOPE_STEMS) for w in words)
