"""Trees as frames of (id, parent): ancestors and totals of subtrees by doubling joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of every node, itself at distance 0; ``nodes`` are (id, parent), roots have no parent.

    Each round doubles the distance that is covered, so a tree of depth d takes about log2 d joins. A ring of parents is an error.
    """
    edges = nodes.where("parent is not null and parent <> id").select("id", F.col("parent").alias("ancestor")).distinct()
    known = materialize(edges.withColumn("distance", F.lit(1)), "ancestors")
    reach = 1
    while True:
        far = known.where(f"distance = {reach}").select(F.col("id").alias("_from"), F.col("ancestor").alias("_mid"))
        step = far.join(known.withColumnRenamed("id", "_mid"), "_mid")
        step = step.select(F.col("_from").alias("id"), "ancestor", (F.col("distance") + reach).cast("int").alias("distance"))
        step = materialize(step, "ancestors")
        if step.isEmpty():
            break
        if not step.where("id = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        known, reach = materialize(known.unionByName(step), "ancestors"), 2 * reach
    own = nodes.select("id").distinct()
    return own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(known)


def subtree_totals(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, items, total): how many rows of ``sizes`` (id, size) lie in each node's subtree, and the sum of their sizes; 0 if none."""
    here = sizes.groupBy("id").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("size"))
    under = ancestors(nodes).join(here, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("items").alias("items"), F.sum("size").alias("total"))
    every = nodes.select("id").distinct().join(under, "id", "left")
    return every.select("id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("total", F.lit(0)).alias("total"))
