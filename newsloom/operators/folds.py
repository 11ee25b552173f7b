"""Greedy orders of a request's rows as JVM folds: a request is a sorted array, a fold over it takes one row after another.

State is a struct of the places still waiting and those taken; Spark's `aggregate` runs it inside the scan's tasks, without
Python. A request has as many rows as its limit, which bounds its array. They order as the functions of `rank` do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Choose = Callable[[Column, Column, Callable[[Column, str], Column]], Column]


def folded(rows: DataFrame, request: Sequence[str], columns: dict[str, Column], choose: Choose, first: int | None = None, least: int = 0) -> DataFrame:
    """rows with the new position. choose(waiting, taken, value) is the place in `waiting` to take; value(row, column).

    first: only the first so many rows are rearranged; least: requests of up to so many rows stay.
    """
    row = F.struct(F.col("position").alias("at"), *[c.alias(f"v_{k}") for k, c in columns.items()], F.struct(*rows.columns).alias("row"))
    lists = rows.groupBy(*request).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("list"))
    n = F.size("list")
    part = F.least(n, F.lit(first)) if first is not None else n
    part = F.when(n <= least, 0).otherwise(part) if least else part
    value = lambda k, name: F.get(F.col("list"), k)[f"v_{name}"]

    def step(state: Column, _: Column) -> Column:
        waiting, taken = state["waiting"], state["taken"]
        k = choose(waiting, taken, value)
        rest = F.concat(F.slice(waiting, F.lit(1), k), F.slice(waiting, k + 2, F.size(waiting)))
        return F.struct(rest.alias("waiting"), F.concat(taken, F.slice(waiting, k + 1, F.lit(1))).alias("taken"))

    numbers = lambda size: F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(numbers(part).alias("waiting"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate(numbers(part), start, step)["taken"]
    order = F.concat(taken, F.slice(numbers(n), part + 1, n))
    out = lists.select("list", F.posexplode(order).alias("to", "from")).select(F.get("list", F.col("from"))["row"].alias("row"), "to")
    return out.select("row.*", (F.col("to") + 1).alias("_to")).withColumn("position", F.col("_to")).drop("_to")


def nearest_behind(waiting: Column, lookahead: int, ok: Callable[[Column], Column]) -> Column:
    """The first of the next places behind the head whose row is ok, else the head."""
    last = F.least(F.lit(lookahead), F.size(waiting) - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda k: ok(F.get(waiting, k))), F.lit(0)), F.lit(0))


def last_of(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


def source_name() -> Column:
    return F.lower(F.trim(F.coalesce("source", F.lit(""))))


def balance_sources(rows: DataFrame, request: Sequence[str], protect: int = 2, gap: int = 1, lookahead: int = 10, drop: float = 8.0, first: int = 30) -> DataFrame:
    """A source that was just shown waits for another one near behind that scores little less. gap 0 looks at the last five."""

    def choose(waiting: Column, taken: Column, value: Callable[[Column, str], Column]) -> Column:
        head = F.get(waiting, F.lit(0))
        recent = last_of(F.filter(F.transform(taken, lambda t: value(t, "source")), lambda s: s != ""), gap or 5)
        fits = lambda x: ~F.array_contains(recent, value(x, "source")) & (value(head, "score") - value(x, "score") <= drop)
        held = (F.size(taken) >= protect) & F.array_contains(recent, value(head, "source"))
        return F.when(held, nearest_behind(waiting, lookahead, fits)).otherwise(0)

    return folded(rows, request, {"source": source_name(), "score": F.col("score").cast("double")}, choose, first)


def balance_favorites(rows: DataFrame, request: Sequence[str], streak: int = 2, lookahead: int = 8) -> DataFrame:
    """After a streak of favourites the nearest other row comes next."""

    def choose(waiting: Column, taken: Column, value: Callable[[Column, str], Column]) -> Column:
        run = F.forall(last_of(taken, streak), lambda t: value(t, "favorite")) & (F.size(taken) >= streak)
        full = value(F.get(waiting, F.lit(0)), "favorite") & run
        return F.when(full, nearest_behind(waiting, lookahead, lambda x: ~value(x, "favorite"))).otherwise(0)

    return folded(rows, request, {"favorite": F.coalesce("favorite_match", F.lit(False))}, choose)


def interleave_sources(rows: DataFrame, request: Sequence[str], first: int = 16, lookahead: int = 6, block: int = 2) -> DataFrame:
    """Of the next few rows, the best ranked whose source isn't among the last ones; lists of up to `first` stay."""

    def choose(waiting: Column, taken: Column, value: Callable[[Column, str], Column]) -> Column:
        recent = last_of(F.filter(F.transform(taken, lambda t: value(t, "source")), lambda s: s != ""), block)
        last = F.least(F.lit(lookahead), F.size(waiting)) - 1
        near = F.filter(F.sequence(F.lit(0), last), lambda k: ~F.array_contains(recent, value(F.get(waiting, k), "source")))
        ranked = F.transform(near, lambda k: F.struct(-value(F.get(waiting, k), "score"), k.alias("k")))
        return F.coalesce(F.array_min(ranked)["k"], F.lit(0))

    return folded(rows, request, {"source": source_name(), "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0))}, choose, first, least=first)
