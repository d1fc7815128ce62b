"""Communities of a graph by the Leiden method, as rounds of joins: local moves, refinement, aggregation, and again within large communities.

Nodes move in rounds. In a round a hash deals communities into givers and takers, so that none is both; a giver lets one node go, and a
taker accepts nodes whose gain outweighs what the others that come with them could cost. So the gains of a round add up and modularity
never falls. Refinement starts from single nodes again and joins them only within their community and only along edges, so that
what is aggregated is connected. Many graphs, such as all large communities of a level, run at once: ``scope`` tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .components import connected_components

#: Most rounds of moves and of refinement at a level, most levels, and most divisions of a large community.
MOVES, REFINES, LEVELS, DEPTH = 6, 3, 2, 24
#: A gain below this is none.
LEAST = 1e-9


def arcs_of(edges: DataFrame) -> DataFrame:
    """(u, v, w): each edge (src, tgt, weight) both ways, weights of repeated ones summed; loops, null ends and weights that aren't positive are left out."""
    e = edges.where("src <> tgt and weight > 0")
    both = e.select(F.col("src").alias("u"), F.col("tgt").alias("v"), "weight").unionByName(e.select(F.col("tgt").alias("u"), F.col("src").alias("v"), "weight"))
    return both.groupBy("u", "v").agg(F.sum("weight").cast("double").alias("w"))


def modularity(nodes: DataFrame, arcs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, modularity) of nodes (scope, node, k, comm) and arcs (scope, u, v, w)."""
    of = nodes.select("scope", "node", "comm")
    ends = arcs.join(of.select("scope", F.col("node").alias("u"), F.col("comm").alias("a")), ["scope", "u"])
    ends = ends.join(of.select("scope", F.col("node").alias("v"), F.col("comm").alias("b")), ["scope", "v"]).where("a = b")
    inside = ends.groupBy("scope").agg(F.sum("w").alias("_in"))
    spread = nodes.groupBy("scope", "comm").agg(F.sum("k").alias("t")).groupBy("scope").agg(F.sum(F.col("t") * F.col("t")).alias("_sq"))
    both = scopes.join(spread, "scope").join(inside, "scope", "left")
    return both.select("scope", (F.coalesce("_in", F.lit(0.0)) / F.col("m2") - F.col("gamma") * F.col("_sq") / F.col("m2") / F.col("m2")).alias("modularity"))


def _gains(nodes: DataFrame, arcs: DataFrame, scopes: DataFrame, alone: bool) -> DataFrame:
    """(scope, u, k, own, to, gain, rate): the moves that raise modularity; with ``alone``, only of nodes that are a community by themselves."""
    total = nodes.groupBy("scope", "comm").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
    near = arcs.join(nodes.select("scope", F.col("node").alias("v"), F.col("comm").alias("to")), ["scope", "v"])
    near = near.groupBy("scope", "u", "to").agg(F.sum("w").alias("w"))
    mine = nodes.join(total, ["scope", "comm"]).join(scopes, "scope")
    if alone:
        mine = mine.where("n = 1")
    mine = mine.select("scope", F.col("node").alias("u"), "k", F.col("comm").alias("own"), F.col("t").alias("own_t"), (F.col("gamma") / F.col("m2")).alias("rate"))
    near = near.join(mine, ["scope", "u"])
    own = near.where("to = own").select("scope", "u", F.col("w").alias("own_w"))
    away = near.where("to <> own").join(own, ["scope", "u"], "left").join(total.select("scope", F.col("comm").alias("to"), "t"), ["scope", "to"])
    gain = F.col("w") - F.coalesce("own_w", F.lit(0.0)) - F.col("rate") * F.col("k") * (F.col("t") - F.col("own_t") + F.col("k"))
    return away.withColumn("gain", gain).where(F.col("gain") > LEAST).select("scope", "u", "k", "own", "to", "gain", "rate")


def _moved(nodes: DataFrame, gains: DataFrame, turn: int) -> DataFrame:
    """``nodes`` after the moves of a round."""
    role = lambda c: F.pmod(F.xxhash64(F.lit(turn), "scope", c), F.lit(2))
    open_ = gains.where((role("own") == 0) & (role("to") == 1))
    best = open_.groupBy("scope", "own").agg(F.max(F.struct("gain", "u", "to", "k", "rate")).alias("m")).select("scope", "m.*")
    taken = best.groupBy("scope", "to").agg(F.sum("k").alias("come"), F.max(F.struct("gain", "u")).alias("first"))
    sure = F.col("gain") - F.col("rate") * F.col("k") * (F.col("come") - F.col("k")) > LEAST
    moves = best.join(taken, ["scope", "to"]).where(sure | (F.col("first.u") == F.col("u"))).select("scope", F.col("u").alias("node"), "to")
    left = nodes.join(moves, ["scope", "node"], "left")
    return left.select("scope", "node", "k", F.coalesce("to", "comm").alias("comm"))


def _rounds(nodes: DataFrame, arcs: DataFrame, scopes: DataFrame, most: int, alone: bool) -> tuple[DataFrame, bool]:
    """Nodes after up to ``most`` rounds, fewer if no move gains, and whether any could."""
    for turn in range(most):
        gains = materialize(_gains(nodes, arcs, scopes, alone), "leiden-gains")
        if gains.isEmpty():
            return nodes, turn > 0
        nodes = materialize(_moved(nodes, gains, turn), "leiden-nodes")
    return nodes, True


def leiden(arcs: DataFrame, scopes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(scope, node, k, comm) for the nodes of ``arcs`` (scope, u, v, w); scopes: (scope, gamma).

    After each level the graph is made smaller by its refined communities, and starts from those that were found.
    """
    base = arcs = materialize(arcs.select("scope", "u", "v", "w"), "leiden-arcs")
    nodes = arcs.groupBy("scope", F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    degrees = nodes = materialize(nodes.withColumn("comm", F.col("node")), "leiden-nodes")
    scopes = materialize(nodes.groupBy("scope").agg(F.sum("k").alias("m2")).join(scopes.select("scope", "gamma"), "scope"), "leiden-scopes")
    of = nodes.select("scope", F.col("node").alias("base"), "node")
    for _ in range(levels):
        nodes, moved = _rounds(nodes, arcs, scopes, MOVES, False)
        if not moved:
            break
        label = nodes.select("scope", "node", "comm")
        within = arcs.join(label.select("scope", F.col("node").alias("u"), F.col("comm").alias("a")), ["scope", "u"])
        within = within.join(label.select("scope", F.col("node").alias("v"), F.col("comm").alias("b")), ["scope", "v"]).where("a = b")
        within = materialize(within.select("scope", "u", "v", "w"), "leiden-within")
        fine, _ = _rounds(nodes.withColumn("comm", F.col("node")), within, scopes, REFINES, True)
        to = materialize(fine.select("scope", "node", F.col("comm").alias("super")).join(label, ["scope", "node"]), "leiden-super")
        of = materialize(of.join(to.select("scope", "node", "super"), ["scope", "node"]).select("scope", "base", F.col("super").alias("node")), "leiden-of")
        nodes = nodes.drop("comm").join(to, ["scope", "node"]).groupBy("scope", "super").agg(F.sum("k").alias("k"), F.first("comm").alias("comm"))
        nodes = materialize(nodes.withColumnRenamed("super", "node"), "leiden-nodes")
        ends = arcs.join(to.select("scope", F.col("node").alias("u"), F.col("super").alias("a")), ["scope", "u"])
        ends = ends.join(to.select("scope", F.col("node").alias("v"), F.col("super").alias("b")), ["scope", "v"]).where("a <> b")
        arcs = materialize(ends.groupBy("scope", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "leiden-arcs")
    found = of.join(nodes.select("scope", "node", "comm"), ["scope", "node"]).select("scope", F.col("base").alias("node"), "comm")
    # single nodes once more, as aggregates can't let one go
    last, _ = _rounds(materialize(degrees.drop("comm").join(found, ["scope", "node"]), "leiden-nodes"), base, scopes, MOVES, False)
    found = last.select("scope", "node", "comm")
    return materialize(degrees.select("scope", "node", "k").join(_connected(found, base), ["scope", "node"]), "leiden")


def _connected(found: DataFrame, arcs: DataFrame) -> DataFrame:
    """(scope, node, comm) with each community cut into its connected parts, each named by its smallest node; nodes belong to one scope."""
    of = found.select("node", "comm")
    ends = arcs.join(of.select(F.col("node").alias("u"), F.col("comm").alias("_a")), "u").join(of.select(F.col("node").alias("v"), F.col("comm").alias("_b")), "v")
    parts = connected_components(ends.where("_a = _b and u < v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    return found.drop("comm").join(parts, "node", "left").select("scope", "node", F.coalesce("component", "node").alias("comm"))


def hierarchy(edges: DataFrame, most: int = 12) -> DataFrame:
    """(level, node, parent, community, size, final): communities of ``edges`` (src, tgt, weight), and those of larger ones, down to ``most`` nodes.

    Level 0 divides the whole graph; each further one divides what is larger than ``most``, as a graph of its own. A community that
    doesn't fall apart is divided at twice the resolution, so that in the end every ``final`` community has ``most`` nodes at most. A
    community is named by its smallest node; each is connected. Nodes that only loops or null ends name have no rows.
    """
    arcs = materialize(arcs_of(edges), "leiden-graph")
    kind = arcs.schema["u"].dataType.simpleString()
    scoped, scopes = arcs.withColumn("scope", F.lit("").cast(kind)), None
    rows = None
    for level in range(DEPTH):
        if scopes is None:
            scopes = scoped.select("scope").distinct().withColumn("gamma", F.lit(1.0))
        named = leiden(scoped, scopes).select("scope", "node", F.col("comm").alias("community"))
        sizes = named.groupBy("scope", "community").agg(F.count(F.lit(1)).alias("size"))
        now = named.join(sizes, ["scope", "community"]).withColumn("final", F.col("size") <= most)
        now = materialize(now.select(F.lit(level).alias("level"), "node", "scope", "community", "size", "final"), "leiden-level")
        parent = F.lit(None).cast(kind) if rows is None else F.col("scope")
        out = now.select("level", "node", parent.alias("parent"), "community", "size", "final")
        rows = out if rows is None else rows.unionByName(out)
        large = now.where("not final")
        if large.isEmpty():
            return rows
        parts = sizes.groupBy("scope").agg(F.count(F.lit(1)).alias("parts")).join(scopes, "scope")
        gamma = F.when(F.col("parts") > 1, F.col("gamma")).otherwise(F.col("gamma") * 2)
        scopes = large.select("scope", "community").distinct().join(parts, "scope").select(F.col("community").alias("scope"), gamma.alias("gamma"))
        scopes = materialize(scopes, "leiden-scopes")
        of = large.select("node", "community")
        inner = arcs.join(of.select(F.col("node").alias("u"), F.col("community").alias("scope")), "u").join(of.select(F.col("node").alias("v"), F.col("community").alias("_s")), "v")
        scoped = inner.where("scope = _s").select("scope", "u", "v", "w")
    raise RuntimeError(f"communities above {most} nodes after {DEPTH} divisions")
