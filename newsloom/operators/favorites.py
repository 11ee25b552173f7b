"""Favourites: expansion over the entity hierarchy, and the best favourite of an article."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.rank import ordered
from newsloom.operators.relational import first_of

# Weights of direct and expanded favourites by type, and the order of types.
DIRECT = {"player": 300, "team": 200, "league": 150, "staff": 100}
TEAM_PLAYER, LEAGUE_PLAYER = 180, 140
TYPE_ORDER = ["player", "team", "league", "staff"]


def by_type(kind: Column, weights: dict[str, int], otherwise: int) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), weights.items(), F).otherwise(otherwise)


def expand(favorites: DataFrame, entities: DataFrame) -> DataFrame:
    """device, entity_id, weight, direct: what a device follows, the largest weight of each entity.

    favorites: device, entity_id. entities: id, sport, type, team_id, league_id, is_swedish, team_is_swedish. A domestic
    team brings its players and staff, a foreign team the Swedish ones, a league its Swedish players.
    """
    own = favorites.join(entities, F.col("entity_id") == F.col("id")).select("device", "entity_id", "type", "is_swedish")
    direct = own.select("device", "entity_id", by_type(F.col("type"), DIRECT, DIRECT["staff"]).alias("weight"), F.lit(True).alias("direct"))
    people = entities.where(F.col("type").isin("player", "staff")).select(F.col("id").alias("person"), F.col("type").alias("kind"), "team_id", "league_id", F.col("is_swedish").alias("swedish"))
    teams = own.where("type = 'team'").withColumnsRenamed({"entity_id": "owner", "is_swedish": "home"})
    of_team = teams.join(people, F.col("owner") == F.col("team_id")).where(F.coalesce("home", F.lit(False)) | F.coalesce("swedish", F.lit(False)))
    team_league = entities.where("type = 'team'").select(F.col("id").alias("t"), F.col("league_id").alias("through"))
    placed = people.join(team_league, F.col("team_id") == F.col("t"), "left").withColumn("league", F.coalesce("through", "league_id"))
    leagues = own.where("type = 'league'").withColumnRenamed("entity_id", "owner")
    of_league = leagues.join(placed, F.col("owner") == F.col("league")).where("swedish AND kind = 'player'")
    parts = [direct, *(p.select("device", F.col("person").alias("entity_id"), F.lit(w).alias("weight"), F.lit(False).alias("direct")) for p, w in ((of_team, TEAM_PLAYER), (of_league, LEAGUE_PLAYER)))]
    return reduce(DataFrame.unionByName, parts).groupBy("device", "entity_id").agg(F.max("weight").alias("weight"), F.max("direct").alias("direct"))


def best_favorite(expanded: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """device, item, entity_id, weight: the best favourite of each item by weight, type, and longer name.

    links: item, entity_id, alias. A one-word alias doesn't count where another entity's longer alias of the item holds it.
    """
    words = F.split(F.lower("alias"), " ")
    named = links.withColumn("words", words)
    long = named.where(F.size("words") > 1).select(F.col("item").alias("i"), F.col("entity_id").alias("other"), F.explode("words").alias("word")).distinct()
    shadowed = named.join(long, (F.col("item") == F.col("i")) & (F.size("words") == 1) & (F.col("words")[0] == F.col("word")) & (F.col("entity_id") != F.col("other")), "left_anti")
    rows = shadowed.join(expanded, "entity_id").join(entities.select(F.col("id").alias("entity_id"), "type", "name"), "entity_id")
    rank = by_type(F.col("type"), {t: k for k, t in enumerate(TYPE_ORDER)}, len(TYPE_ORDER))
    return first_of(rows, ["device", "item"], F.col("weight").desc(), rank, F.length("name").desc(), F.col("entity_id")).select("device", "item", "entity_id", "weight")


def within_limit(favorites: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """favorites with allowed: the first `most` of each device and sport by ordinal."""
    rows = favorites.join(entities.select(F.col("id").alias("entity_id"), "sport"), "entity_id")
    return ordered(rows, ["device", "sport"], F.col("ordinal")).withColumn("allowed", F.col("position") <= most).drop("position")


def context_score(favorites: DataFrame, entities: DataFrame, score: int = 6) -> DataFrame:
    """device, entity_id, owner, score: teammates, staff and the team of a followed player; the first owner wins."""
    e = entities.select("id", "type", "team_id")
    players = favorites.join(e, F.col("entity_id") == F.col("id")).where("type = 'player' AND team_id IS NOT NULL").select("device", F.col("entity_id").alias("owner"), F.col("team_id").alias("club"))
    mates = players.join(e.where(F.col("type").isin("player", "staff")), F.col("club") == F.col("team_id")).where("id <> owner").select("device", "owner", F.col("id").alias("entity_id"))
    clubs = players.select("device", "owner", F.col("club").alias("entity_id"))
    return first_of(mates.unionByName(clubs), ["device", "entity_id"], F.col("owner")).withColumn("score", F.lit(score))
