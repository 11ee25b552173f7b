"""Stories that grow batch by batch: confirmed pairs are merged into stored labels, touching only the stories they meet.

A story's label is its earliest member (published_at, then id), so labels don't depend on the order or the batches in
which pairs come. The store is a folder with a folder for each batch, which holds the rows that the batch changed; an
item's label is that of its last batch. A batch that comes again replaces its own folder and looks at earlier ones only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.graph import connected_components
from newsloom.operators.stories import story_candidates
from newsloom.sources.sink import hadoop_path


class StoryLabels:
    """The stored labels: item, story, story_at (when its earliest member was published)."""

    def __init__(self, spark: SparkSession, folder: str, item_type: str = "long") -> None:
        self.spark, self.folder, self.item_type = spark, folder.rstrip("/"), item_type

    def changes(self, before: int | None = None) -> DataFrame:
        """All rows that batches have written, with their batch; only of batches before a given one."""
        schema = f"item {self.item_type}, story {self.item_type}, story_at timestamp, batch long"
        path, fs = hadoop_path(self.spark, self.folder)
        found = self.spark.read.schema(schema).parquet(self.folder) if fs.exists(path) else self.spark.createDataFrame([], schema)
        return found if before is None else found.where(F.col("batch") < before)

    @staticmethod
    def latest(changes: DataFrame) -> DataFrame:
        return changes.groupBy("item").agg(F.max_by(F.struct("story", "story_at"), "batch").alias("now")).select("item", "now.*")

    def labels(self) -> DataFrame:
        return self.latest(self.changes())

    def merge(self, pairs: DataFrame, times: DataFrame, batch: int) -> DataFrame:
        """Merges pairs (a, b) and returns the rows that changed. times: item, published_at of the pairs' items."""
        changes = self.changes(batch)
        ends = pairs.select(F.col("a").alias("item")).unionByName(pairs.select(F.col("b").alias("item"))).distinct()
        known = self.latest(changes.join(ends, "item", "left_semi"))
        met = ends.join(times.select("item", "published_at").distinct(), "item", "left").join(known, "item", "left")
        met = met.select("item", F.col("story").isNull().alias("new"), F.coalesce("story", "item").alias("story"), F.coalesce("story_at", "published_at").alias("story_at"))
        # The pairs between stories, and the earliest story of each part that they make.
        of = lambda c, name: met.select(F.col("item").alias(c), F.col("story").alias(name))
        edges = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        part = connected_components(edges).select(F.col("node").alias("story"), "component")
        first = part.join(met.select("story", "story_at").distinct(), "story").groupBy("component").agg(F.min_by(F.struct("story", "story_at"), F.struct("story_at", "story")).alias("first"))
        moved = part.join(first, "component").select("story", F.col("first.story").alias("to"), F.col("first.story_at").alias("to_at"))
        told = met.where("new").join(moved, "story", "left").select("item", F.coalesce("to", "story").alias("story"), F.coalesce("to_at", "story_at").alias("story_at"))
        # Of stored stories only those that have another label now are written, all their members.
        gone = moved.where("story <> to")
        near = changes.join(gone.select("story"), "story", "left_semi").select("item").distinct()
        stored = self.latest(changes.join(near, "item", "left_semi")).select("item", "story").join(gone, "story").select("item", F.col("to").alias("story"), F.col("to_at").alias("story_at"))
        target = f"{self.folder}/batch={batch}"
        stored.unionByName(told).dropDuplicates(["item"]).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(f"item {self.item_type}, story {self.item_type}, story_at timestamp").parquet(target)


def link_batches(store: StoryLabels, stored: Callable[[], DataFrame], confirm: Callable[[DataFrame], DataFrame], hours: int = 7) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler for new articles (id, sport, title, published_at, entity_ids, ordinal).

    stored() gives the same of those stored so far, of which the last `hours` before the batch's newest are looked at;
    confirm(candidates) the pairs (id, other) that tell the same story.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        newest = rows.agg(F.max("published_at")).first()[0]
        if newest is None:
            return
        columns = ["id", "sport", "title", "published_at", "entity_ids", "ordinal"]
        recent = stored().select(*columns).where(F.col("published_at") >= F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS"))
        near = recent.unionByName(rows.select(*columns)).dropDuplicates(["id"])
        pairs = confirm(story_candidates(rows.select(*columns), near)).select(F.col("id").alias("a"), F.col("other").alias("b"))
        store.merge(pairs, near.select(F.col("id").alias("item"), "published_at"), batch)

    return handle
