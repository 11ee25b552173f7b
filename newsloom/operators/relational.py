"""Relational operators with the semantics of the feed: ordered distincts, merges, lookups, contains- and nearest-joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import haversine_km, normalize, tokens


def first_of(rows: DataFrame, keys: Sequence[str], *by: Column) -> DataFrame:
    """The first row of each key in the given order (first wins); order by a descending ordinal for last wins."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """All parts; of equal keys the row of the first part wins, then that with the smaller ordinal."""
    out = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    return first_of(out, keys, F.col("_part"), F.col(ordinal)).drop("_part")


def last_position_wins(rows: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key, at the ordinal of its first."""
    w = Window.partitionBy(*keys)
    return first_of(rows.withColumn("_first", F.min(ordinal).over(w)), keys, F.col(ordinal).desc()).withColumn(ordinal, F.col("_first")).drop("_first")


def single(rows: DataFrame) -> DataFrame:
    """rows, which must be exactly one; the check runs with the query."""
    counted = rows.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("row"))
    checked = F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("expected one row, found "), F.col("n").cast("string"))))
    return counted.select(checked.alias("row")).select("row.*")


def optional_filters(rows: DataFrame, **equals: object) -> DataFrame:
    """rows equal to the given values; a value of None is no filter."""
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def funnel(rows: DataFrame, stages: Sequence[tuple[str, Column]], keys: Sequence[str] = (), sample: str | None = None, samples: int = 5) -> DataFrame:
    """The first stage whose condition a row fails, counted; `kept` are those that pass all. With samples of each stage."""
    stage = F
    for name, ok in stages:
        stage = stage.when(~F.coalesce(ok, F.lit(False)), name)
    marked = rows.withColumn("stage", stage.otherwise("kept"))
    out = marked.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("n"))
    if sample:
        w = Window.partitionBy(*keys, "stage").orderBy(sample)
        few = marked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
        few = few.groupBy(*keys, "stage").agg(F.sort_array(F.collect_list(sample)).alias("samples"))
        out = out.join(few, [*keys, "stage"])
    return out


def bound_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Batches of rows go to Python with at most so many bytes, however long their texts are; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= limit:
        spark.conf.set(key, f"{limit}b")


@lru_cache(maxsize=4)
def _automaton(padded: tuple[str, ...]) -> ahocorasick.Automaton:
    """One for a worker process, whose tasks share it."""
    found = ahocorasick.Automaton()
    for phrase in padded:
        found.add_word(phrase, phrase[1:-1])
    found.make_automaton()
    return found


def _hits_by_automaton(said: Column, phrases: list[str]) -> Column:
    """The phrases that stand in a text, both between spaces, by one pass over it."""
    padded = tuple(f" {p} " for p in phrases)

    @F.pandas_udf("array<string>")
    def hits(texts: pd.Series) -> pd.Series:
        iterate = _automaton(padded).iter
        return texts.map(lambda text: sorted({p for _, p in iterate(text)}) if isinstance(text, str) else [])

    return hits(said) if phrases else F.array().cast("array<string>")


def _hits_by_rarest_word(texts: DataFrame, said: str, phrases: DataFrame, phrase: str, hits: str) -> DataFrame:
    """texts with the phrases that stand in them. A phrase is looked for where its rarest word is.

    Distinct words meet the phrases' keys under a hash of the text; a text comes in once, to the list of its candidates, and
    is searched for each. So no more than words, hashes and phrases is ever repeated.
    """
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    spoken = texts.select(F.xxhash64(said).alias("h"), F.explode(words(said)).alias("word"))
    often = spoken.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    of = phrases.select(phrase, F.size(words(phrase)).alias("size"), F.explode(words(phrase)).alias("word"))
    keys = of.join(often, "word").groupBy(phrase, "size").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word"))["word"].alias("word"))
    keys = keys.where("known = size").select(phrase, "word")
    near = spoken.join(keys, "word").groupBy("h").agg(F.collect_set(phrase).alias(hits))
    met = texts.join(near.withColumnRenamed("h", f"{hits}_h"), F.xxhash64(said) == F.col(f"{hits}_h")).drop(f"{hits}_h")
    return met.withColumn(hits, F.filter(hits, lambda p: F.contains(F.col(said), F.concat(F.lit(" "), p, F.lit(" ")))))


def phrase_join(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", most_words: int | None = None, on: Sequence[str] = (), most_chars: int = 2_000_000) -> DataFrame:
    """Pairs of texts and terms that stand in them between word boundaries, both normalised; terms of any length.

    A first job adds up the terms' characters. Up to most_chars, an Aho-Corasick automaton of all terms goes to the tasks,
    and a text is read once for all of them; beyond that, terms are looked for where their rarest word is. Nothing but
    hits is joined with the terms, so texts go along only if they are asked for. on: columns that must be equal too.
    most_words has no meaning any more. Helper columns have names of their own.
    """
    mark = f"_{uuid.uuid4().hex[:12]}_"
    said, phrase, hits = f"{mark}said", f"{mark}phrase", f"{mark}hits"
    t = terms.withColumn(phrase, F.array_join(tokens(normalize(F.col(term))), " ")).where(F.col(phrase) != "")
    for c in on:
        t = t.withColumnRenamed(c, f"{mark}on_{c}")
    x = texts.withColumn(said, F.concat(F.lit(" "), F.array_join(tokens(normalize(F.col(text))), " "), F.lit(" ")))
    phrases = t.select(phrase).distinct()
    chars = phrases.agg(F.coalesce(F.sum(F.length(phrase)), F.lit(0))).first()[0]
    if chars <= most_chars:
        bound_batches(texts.sparkSession)
        found = x.withColumn(hits, _hits_by_automaton(F.col(said), sorted(r[0] for r in phrases.collect())))
    else:
        found = _hits_by_rarest_word(x, said, phrases, phrase, hits)
    found = found.drop(said).withColumn(f"{mark}hit", F.explode(hits)).drop(hits)
    joined = found.join(t, [F.col(f"{mark}hit") == t[phrase], *[found[c] == t[f"{mark}on_{c}"] for c in on]])
    return joined.drop(f"{mark}hit", phrase, *[f"{mark}on_{c}" for c in on])


def longest_per(rows: DataFrame, keys: Sequence[str], term: str) -> DataFrame:
    """The longest term of each key, the first by name among equals."""
    return first_of(rows, keys, F.length(term).desc(), F.col(term))


def unique_lookup(names: DataFrame, key: str, value: str) -> DataFrame:
    """key, value for the keys that have exactly one value; ambiguous ones match nothing."""
    return names.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")


def two_hop(entities: DataFrame) -> DataFrame:
    """entities with league and team names: the team's league, else the entity's own."""
    up = lambda name: entities.select(F.col("id").alias(f"_{name}_id"), F.col("name").alias(f"{name}_name"), F.col("league_id").alias(f"_{name}_league"))
    with_team = entities.join(up("team"), F.col("team_id") == F.col("_team_id"), "left")
    with_team = with_team.withColumn("_league", F.coalesce("_team_league", "league_id"))
    return with_team.join(up("league"), F.col("_league") == F.col("_league_id"), "left").drop("_team_id", "_team_league", "_league", "_league_id", "_league_league")


def nearest(points: DataFrame, places: DataFrame, key: str, place: str, most_km: float = 50.0, cell_degrees: float = 1.0) -> DataFrame:
    """points with the nearest place within most_km and its distance; no row for points without one.

    Both sides are dealt to cells of latitude and longitude that cover most_km, so a point meets the places of nine cells;
    near the poles a band is one cell. Longitudes wrap around. Equal coordinates are compared once.
    """
    bands = max(cell_degrees, most_km / 110.0)
    # The cells of a band, by the latitude of its neighbours that is nearest to a pole.
    edge = (F.abs("_band") + 2) * bands
    count = F.when(edge >= 85, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (1.2 * most_km / (110 * F.cos(F.radians(edge))))))).cast("int")
    cell = lambda c: F.pmod(F.floor((F.col(c) + 180) / (360 / count)), count)
    # Points at one spot have one nearest place, and of places at one spot the first is it: spots meet spots.
    near = places.groupBy(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).agg(F.min(F.struct(place)).alias("_place")).select("_lat", "_lng", F.col(f"_place.{place}").alias(place))
    near = near.withColumn("_band", F.explode(F.array(*[F.floor(F.col("_lat") / bands) + d for d in (-1, 0, 1)])))
    near = near.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.pmod(cell("_lng") + d, count) for d in (-1, 0, 1)]))))
    spots = points.select("lat", "lng").distinct()
    joined = spots.withColumn("_band", F.floor(F.col("lat") / bands)).withColumn("_cell", cell("lng")).join(near, ["_band", "_cell"])
    joined = joined.withColumn("_km", haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).where(F.col("_km") <= most_km)
    best = joined.groupBy("lat", "lng").agg(F.min(F.struct("_km", place)).alias("_best"))
    met = points.select(key, "lat", "lng").join(best, ["lat", "lng"])
    return met.groupBy(key).agg(F.min("_best").alias("_best")).select(key, F.col(f"_best.{place}").alias(place), F.col("_best._km").alias("km"))


def merge_insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The rows of source to append: those whose key the target hasn't, once each, the first by ordinal."""
    return first_of(source, keys, F.col(ordinal)).join(target.select(*keys).distinct(), list(keys), "left_anti")


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The target after source: a key's latest source row replaces the target's."""
    latest = first_of(source, keys, F.col(ordinal).desc()).drop(ordinal)
    return target.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest, allowMissingColumns=True)


def merge_update_when(target: DataFrame, changes: DataFrame, keys: Sequence[str], column: str, guard: Column) -> DataFrame:
    """target with `column` set from changes where the guard holds for the target's row; other rows stay."""
    new = changes.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_found"))
    joined = target.withColumn("_guard", F.coalesce(guard, F.lit(False))).join(new, list(keys), "left")
    return joined.withColumn(column, F.when(F.col("_found") & F.col("_guard"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_found", "_guard")


def merge_delete(target: DataFrame, keys_to_delete: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(keys_to_delete.select(*keys).distinct(), list(keys), "left_anti")


def trailing_counts(log: DataFrame, key: str, time: str, windows: dict[str, int]) -> DataFrame:
    """log with a column for each window: the rows of the key in the seconds up to and with this row's time."""
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    out = log.withColumn("_s", seconds)
    for name, length in windows.items():
        w = Window.partitionBy(key).orderBy("_s").rangeBetween(-length, 0)
        out = out.withColumn(name, F.count(F.lit(1)).over(w))
    return out.drop("_s")
