"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; a component is named by its smallest node.

    Each round hangs neighbours below the smallest node that is near them; the edges end as one star per component. A node's
    minimum is a partial aggregate, so a node with very many edges costs one row per task. Rows with a null endpoint are no
    edges; self loops only name a node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    e = materialize(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    seen = _state(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the nodes that are smallest among their own neighbours keep their edges through the line above
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = _state(e)
        if state == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).unionByName(loops).distinct()
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = roots.join(members, "node", "left_anti").select("node", F.col("node").alias("component"))
    return members.unionByName(alone)


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
