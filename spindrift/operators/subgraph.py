"""Subgraphs of documents: tidied, merged, and rebuilt without some documents.

Nodes are rows (doc, id, description), edges rows (doc, src, tgt, weight, description, keywords); ``doc`` is where a row was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import SEPARATOR, degrees


def tidy(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that have a description and a doc; edges only between nodes left of the same doc, without keywords an empty list."""
    nodes = nodes.where("description is not null and doc is not null")
    known = nodes.select("doc", "id").distinct()
    edges = edges.where("description is not null and doc is not null")
    for end in ("src", "tgt"):
        edges = edges.join(known.withColumnRenamed("id", end), ["doc", end], "left_semi")
    return nodes, edges.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def _told(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., description, sources): different descriptions in order; each is counted once before it is shuffled."""
    different = rows.groupBy(*keys, "description").agg(F.count(F.lit(1)).alias("_n"))
    told = different.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("description")), SEPARATOR).alias("description"))
    sources = rows.select(*keys, "doc").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("sources"))
    return told.join(sources, keys)


def merge_subgraphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of all documents: nodes (id, description, sources, rank) and edges (src, tgt, weight, description, keywords, sources).

    Edges have no direction and no loops; weights are summed, different descriptions and keywords kept in order, documents counted; a
    node's rank is its number of edges.
    """
    pairs = edges.where("src <> tgt").withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    ends = ["src", "tgt"]
    weights = pairs.groupBy(*ends).agg(F.sum("weight").alias("weight"))
    words = pairs.select(*ends, F.explode("keywords").alias("keyword")).distinct().groupBy(*ends).agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    merged = weights.join(_told(pairs, ends), ends).join(words, ends, "left")
    merged = merged.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    merged = merged.select("src", "tgt", "weight", "description", "keywords", "sources")
    ranked = _told(nodes, ["id"]).join(degrees(merged), "id", "left")
    return ranked.select("id", "description", "sources", F.coalesce("degree", F.lit(0)).alias("rank")), merged


def rebuild(nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged graph of what is found outside the documents ``excluded`` (doc)."""
    out = excluded.select("doc").distinct()
    return merge_subgraphs(*tidy(nodes.join(out, "doc", "left_anti"), edges.join(out, "doc", "left_anti")))
