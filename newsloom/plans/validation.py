"""Typed checks of what plans take: the schema before anything runs, rows by one job, options as they are made."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.errors import InvalidArticle, InvalidConfig, InvalidInput

#: A rule: its name in the error, and the condition that a row must meet; null doesn't meet it.
Rule = tuple[str, Column]


def require_types(rows: DataFrame, **kinds: type[T.DataType]) -> DataFrame:
    """rows, if it has these columns with data of these types."""
    for name, kind in kinds.items():
        if name not in rows.columns:
            raise InvalidInput(f"there is no column {name}", column=name)
        if not isinstance(rows.schema[name].dataType, kind):
            raise InvalidInput(f"{name} is {rows.schema[name].dataType.simpleString()}, not {kind.typeName()}", column=name)
    return rows


def broken(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break a rule, with the first one they break (`rule`)."""
    first = F
    for name, ok in rules:
        first = first.when(~F.coalesce(ok, F.lit(False)), name)
    return rows.withColumn("rule", first.otherwise(F.lit(None).cast("string"))).where("rule IS NOT NULL")


def require_rows(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows, if all keep the rules; else an error with the rule and one row that breaks it."""
    one = broken(rows, rules).limit(1).collect()
    if one:
        found = one[0].asDict(recursive=True)
        raise InvalidArticle(f"a row breaks the rule: {found.pop('rule')}", row=found)
    return rows


def filled(c: str) -> Column:
    return F.trim(F.col(c)) != ""


def candidates(rows: DataFrame, sport: str) -> DataFrame:
    """Candidates of one sport for ranking: every url is there; entities, if given, are an array."""
    if sport not in ("football", "hockey"):
        raise InvalidInput("the sport must be football or hockey", sport=sport)
    require_types(rows, url=T.StringType, **({"entities": T.ArrayType} if "entities" in rows.columns else {}))
    return require_rows(rows, [("a url", filled("url"))])


def ranked(rows: DataFrame) -> DataFrame:
    """Ranked articles for balancing: ids are there, sources are text, scores finite numbers."""
    require_types(rows, id=T.DataType, source=T.StringType, score=T.NumericType)
    score = F.col("score").cast("double")
    finite = ~F.isnan(score) & ~score.isin(math.inf, -math.inf)
    return require_rows(rows, [("an id", F.trim(F.col("id").cast("string")) != ""), ("a source", F.col("source").isNotNull()), ("a finite score", finite)])


@dataclass(frozen=True)
class SourceBalancing:
    """Options of `folds.balance_sources`; numbers from 0 on."""

    protect: int = 2
    gap: int = 1
    lookahead: int = 10
    drop: float = 8.0
    first: int = 30

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, (int, float)) or isinstance(value, bool) or not math.isfinite(value) or value < 0:
                raise InvalidConfig(f"{f.name} must be a finite number from 0 on", option=f.name, value=value)
