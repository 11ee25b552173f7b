"""Stories: articles that report the same event, linked by confirmed pairs, and what readers have seen of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import story_title, title_similarity
from newsloom.operators.graph import connected_components
from newsloom.operators.rank import top_k
from newsloom.operators.relational import first_of


def story_candidates(articles: DataFrame, existing: DataFrame, seconds: int = 3 * 3600, least: float = 0.10, most: int = 3) -> DataFrame:
    """id, other, similarity, position: for each article the most similar existing ones of its sport, at most `seconds`
    away, that share an entity. Both: id, sport, title, published_at, entity_ids (array), ordinal.

    Pairs are found by an equi-join on sport, entity and a time slot, so an entity in any share of the articles is split
    by time. Of equal similarities the one with the smaller ordinal comes first. Rows without a date or entity match none.

    Articles of the same sport, time, story title and entities are one class, and classes meet, not articles: all of a class
    have the same candidates, of which it needs most + 1 (an article is none of its own), so no class gives more of its
    members than that. Titles are compared once for each pair of different ones.
    """
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    parts = F.struct("sport", micros.alias("at"), story_title(F.col("title")).alias("title"), F.array_sort(F.array_distinct("entity_ids")).alias("entities"))

    def classed(rows: DataFrame) -> DataFrame:
        told = rows.where(F.col("published_at").isNotNull()).withColumn("_of", parts)
        return told.select("id", "ordinal", "_of.*").withColumn("class", F.md5(F.to_json(F.struct("sport", "at", "title", "entities")).cast("binary")))

    def classes(rows: DataFrame) -> DataFrame:
        slot = F.floor(F.col("at") / (seconds * 1_000_000)).alias("slot")
        return rows.select("class", "sport", "at", "title", "entities").distinct().select("class", "sport", "at", "title", F.explode("entities").alias("entity"), slot)

    new, old = classed(articles.withColumn("ordinal", F.lit(0))), classed(existing)
    left = classes(new).withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    right = classes(old).select("sport", "entity", "slot", F.col("class").alias("other_class"), F.col("at").alias("other_at"), F.col("title").alias("other_title"))
    near = left.join(right, ["sport", "entity", "slot"]).where(F.abs(F.col("at") - F.col("other_at")) <= seconds * 1_000_000)
    pairs = near.select("class", "title", "other_class", "other_title").distinct()
    alike = pairs.select("title", "other_title").distinct().withColumn("similarity", title_similarity(F.col("title"), F.col("other_title"))).where(F.col("similarity") >= least)
    found = pairs.join(alike, ["title", "other_title"]).select("class", "other_class", "similarity")
    first = top_k(old, ["class"], most + 1, F.col("ordinal"), F.col("id")).select(F.col("class").alias("other_class"), F.col("id").alias("other"), "ordinal")
    order = [F.col("similarity").desc(), F.col("ordinal"), F.col("other")]
    best = top_k(found.join(first, "other_class"), ["class"], most + 1, *order).select("class", "other", "ordinal", "similarity")
    own = new.select("id", "class").join(best, "class").where(F.col("id") != F.col("other"))
    return top_k(own, ["id"], most, *order).select("id", "other", "similarity", "position")


def story_index(members: DataFrame, articles: DataFrame, most: int | None = None) -> DataFrame:
    """The members (item, story) of all stories that one of the articles (item) is in; `most` is a report's limit."""
    own = members.join(articles.select("item").distinct(), "item", "left_semi").select("story").distinct()
    found = members.join(own, "story", "left_semi")
    return found.orderBy("story", "item").limit(most) if most else found


def story_members(members: DataFrame) -> DataFrame:
    """story, items: the sorted distinct members of each story."""
    return members.groupBy("story").agg(F.sort_array(F.collect_set("item")).alias("items"))


def with_story(items: DataFrame, members: DataFrame, item: str = "item") -> DataFrame:
    """items with story_key: the story of an item, else the item itself."""
    of = first_of(members, ["item"], F.col("story")).select(F.col("item").alias(item), F.col("story").alias("_story"))
    return items.join(of, item, "left").withColumn("story_key", F.coalesce("_story", F.col(item).cast("string"))).drop("_story")


def hide_read(items: DataFrame, seen: DataFrame, members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """items of no story of which something was seen; keys: columns of readers, shared by items and seen."""
    known = with_story(seen.select(*keys, "item").distinct(), members).select(*keys, "story_key").distinct()
    return with_story(items, members).join(known, [*keys, "story_key"], "left_anti").drop("story_key")


def read_keys(item: Column, story: Column, members: Column) -> Column:
    """All keys under which an item may have been read: its own, its story's, and those of the story's members."""
    keys = F.concat(F.array(item.cast("string"), story), F.coalesce(members, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def pushed_unread(log: DataFrame, seen: DataFrame, news: DataFrame, latest: int = 200) -> DataFrame:
    """Of each device's latest deliveries the news not seen yet, each once. log: device, item, sent_at; seen: device, item;
    news: item and more."""
    few = top_k(log, ["device"], latest, F.col("sent_at").desc_nulls_last(), F.col("item")).select("device", "item").distinct()
    return few.join(seen.select("device", "item").distinct(), ["device", "item"], "left_anti").join(news, "item")


def link_stories(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """item, story: articles linked by confirmed pairs (a, b), under the id of the earliest one (published_at, id)."""
    linked = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "id").join(articles.select("id", "published_at"), "id")
    first = linked.groupBy("component").agg(F.min_by("id", F.struct("published_at", "id")).alias("story"))
    return linked.join(first, "component").select(F.col("id").alias("item"), "story")
