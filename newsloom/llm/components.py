"""Connected components of an edge table: one contraction, then label propagation with shortcuts on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, materialized


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, to: the smallest of a node and its neighbours; and a, b: the edges that are left between those, which connect
    what edges connect. edges: distinct a, b with a < b. Each is met once, and most of a class of stars has few such `to`."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    to = materialized(both.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("to")).select("node", F.least("node", "to").alias("to")))
    met = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
    left = met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return to, materialized(left)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the smallest node of its component. edges: a, b of one type; direction doesn't count.

    Each round points every node to the smallest root among its own and its neighbours', then to that root's root.
    Only nodes and edges of the table are shuffled; labels are pre-aggregated per node.
    """
    once = materialized(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    to, left = contracted(once)
    discard(once)
    if left.isEmpty():
        discard(left)
        return to.withColumnRenamed("to", "root")
    roots = propagated(left, max_rounds)
    discard(left)
    out = materialized(to.join(roots.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    discard(to)
    discard(roots)
    return out


def propagated(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The same of edges that no contraction has made fewer, a row for each direction of them in each round."""
    both = materialized(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialized(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        # A node also tells its root what its neighbours' smallest root is.
        own = near.join(labels.select("node", F.col("root").alias("own")), "node")
        told = near.unionByName(own.select(F.col("own").alias("node"), "root")).unionByName(labels)
        least = told.groupBy("node").agg(F.min("root").alias("root"))
        up = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialized(least.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
