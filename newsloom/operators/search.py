"""Search among entities by their names and aliases, and lookups of one entity by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.errors import InvalidInput
from newsloom.functions.text import is_uuid, match_score, normalize, normalize_browse
from newsloom.operators.relational import first_of

# Types in the order of suggestions, and the bounds of a search.
TYPE_ORDER = ["league", "team", "player"]
LIMIT, MOST, SUGGESTIONS = 30, 500, 30


def alias_records(aliases: DataFrame, entities: DataFrame, sport: str | None = None) -> DataFrame:
    """entity_id, name, type, sport, alias, normalized, length: aliases of players, teams and leagues, by length."""
    own = entities.where(F.col("type").isin("player", "team", "league"))
    if sport is not None:
        own = own.where(F.col("sport") == sport)
    own = own.select(F.col("id").alias("entity_id"), "name", "type", "sport")
    found = aliases.select("entity_id", "alias", "normalized").join(own, "entity_id")
    return found.withColumn("normalized", F.coalesce(F.nullif(F.trim("normalized"), F.lit("")), normalize(F.col("alias")))).withColumn("length", F.length("normalized"))


def merge_aliases(entities: DataFrame) -> DataFrame:
    """One row for each sport, type and id: the first by ordinal, with the distinct non-empty aliases of all, in order."""
    by = Window.partitionBy("sport", "type", "id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_of = F.array_distinct(F.filter(F.flatten(F.collect_list("aliases").over(by)), lambda a: a != ""))
    return first_of(entities.withColumn("aliases", all_of), ["sport", "type", "id"], F.col("ordinal"))


def direct_score(name: Column, aliases: Column, query: Column) -> Column:
    """By the first of name and aliases, in their order, that matches at all: 140 equal, 110 prefix, 90 contained; 0 for none."""
    strings = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), normalize_browse)
    q = normalize_browse(query)
    first = F.get(F.filter(F.transform(strings, lambda s: match_score(s, q)), lambda x: x.isNotNull()), F.lit(0))
    return F.when(q == "", 0).otherwise(F.coalesce(first, F.lit(0)))


def best_matches(entities: DataFrame, query: Column) -> DataFrame:
    """Of each sport and type the entities whose score is at most 20 below the best one's, and at least 90."""
    scored = entities.withColumn("score", direct_score(F.col("name"), F.col("aliases"), query)).where("score > 0")
    best = F.max("score").over(Window.partitionBy("sport", "type"))
    return scored.withColumn("_best", best).where(F.col("score") >= F.greatest(F.lit(90), F.col("_best") - 20)).drop("_best")


def suggestions(entities: DataFrame, sport: str, query: str, kind: str = "all", limit: int = SUGGESTIONS) -> DataFrame:
    """id, type, name, score, position: leagues, then teams, then players, each by score and Swedish collation of names.

    With a kind its matches alone, all of them; over all kinds each id once, up to the limit. entities: id, sport, type, name, aliases.
    """
    own = entities.where(F.col("sport") == sport)
    own = own.where(F.col("type").isin(TYPE_ORDER) if kind == "all" else F.col("type") == kind)
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("type"))
    order = [rank, F.col("score").desc(), F.collate("name", "sv"), F.col("id")]
    found = best_matches(own, F.lit(query))
    if kind == "all":
        found = first_of(found, ["id"], *order).orderBy(*order).limit(limit)
    # A catalog's matches of one query: a few rows.
    return found.select("id", "type", "name", "score", F.row_number().over(Window.partitionBy("sport").orderBy(*order)).alias("position"))


def search_entities(entities: DataFrame, sport: str, query: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """id, sport, type, name, slug, score: the search of the entity endpoint. An empty query with a kind lists that kind;
    otherwise a query needs two characters. limit: from 1 to 500, 30 by default."""
    if sport not in ("football", "hockey"):
        raise InvalidInput(f"unknown sport: {sport}", sport=sport)
    query, limit = query.strip()[:120], min(max(LIMIT if limit is None else int(limit), 1), MOST)
    own = entities.where(F.col("sport") == sport)
    own = own.where(F.col("type") == kind) if kind else own
    columns = ["id", "sport", "type", "name", "slug"]
    if not query and kind:
        return own.select(*columns, F.lit(0).alias("score")).orderBy(F.collate("name", "sv"), "id").limit(limit)
    if len(query) < 2:
        return own.select(*columns, F.lit(0).alias("score")).limit(0)
    found = own.withColumn("score", direct_score(F.col("name"), F.col("aliases"), F.lit(query))).where("score > 0")
    return found.orderBy(F.col("score").desc(), F.collate("name", "sv"), "id").limit(limit).select(*columns, "score")


def resolve_names(requests: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """requests with entity_id: a UUID stays; else, of the first `most` entities of the name (case doesn't count), the first
    whose normalised name is equal, else the first; null for none. requests: request, given, name, sport, type (nulls are
    no filter); entities: id, sport, type, name, ordinal."""
    by_name = requests.where(~is_uuid(F.col("given")) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    key = lambda c: F.lower(F.trim(F.col(c)))
    e = entities.select(F.col("id").alias("_id"), F.col("sport").alias("_sport"), F.col("type").alias("_type"), F.col("name").alias("_name"), F.col("ordinal").alias("_ordinal"), F.lower("name").alias("_key"))
    asked = lambda c: F.col(c).isNull() | (F.col(c) == F.col(f"_{c}"))
    found = by_name.withColumn("_key", key("name")).join(e, "_key").where(asked("sport") & asked("type"))
    w = Window.partitionBy("request").orderBy("_ordinal", "_id")
    found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    best = first_of(found, ["request"], (normalize(F.col("_name")) == normalize(F.col("name"))).desc(), F.col("_n")).select("request", F.col("_id").alias("_found"))
    return requests.join(best, "request", "left").withColumn("entity_id", F.when(is_uuid(F.col("given")), F.col("given")).otherwise(F.col("_found"))).drop("_found")
