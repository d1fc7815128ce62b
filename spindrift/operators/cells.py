"""Exact cosine neighbours through a cell index: coarse centres, the distance of each vector to its own, and the triangle inequality.

Vectors are scaled to unit length, so the nearest by angle are the nearest by distance. A query's distance to a vector is at least the
difference between their distances to the vector's centre: cells and, within cells, rows that are further than the k-th hit so far are
left out without loss, whatever the centres. Hits are found in two passes: the closest cells give each query its reach, then all cells
within reach are read. The join is on filter and cell, so a filter value that most rows share is dealt over all its cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.scratch import materialize

#: Vectors drawn for each centre, most centres, and rounds of their fit on the driver; rows read first for each hit wanted.
DRAWN, MOST, FIT_ROUNDS, FIRST = 32, 1024, 6, 8
#: Cosines nearer than this may be equal once they are rounded.
ROUNDING = 2e-6


def unit(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``unit``, the vector at length 1, without those whose vector is null, has no length or holds null or non-finite numbers."""
    values = F.col(vector).cast("array<double>")
    long = rows.withColumn("_v", values).where(~F.exists("_v", lambda x: x.isNull())).withColumn("_n", norm(F.col("_v")))
    return long.where((F.col("_n") > 0) & (F.col("_n") < float("inf"))).withColumn("unit", F.transform("_v", lambda x: x / F.col("_n"))).drop("_v", "_n")


def fit_centres(rows: DataFrame, key: str, cells: int) -> np.ndarray:
    """Centres of a sample of ``unit`` vectors: ``DRAWN * cells`` at most, by the hash of their key, so that reruns draw the same."""
    drawn = rows.orderBy(F.xxhash64(key), key).limit(DRAWN * cells).select("unit").collect()
    x = np.array([r["unit"] for r in drawn], np.float64)
    centres = x[:cells]
    for _ in range(FIT_ROUNDS):
        at = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))[:, None]
        np.add.at(sums, at, x)
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def distances(rows: DataFrame, centres: np.ndarray, keep: list[str], nearest: bool) -> DataFrame:
    """``keep`` and ``unit`` with (cell, gap), the distance to a centre: to the nearest, or else a row for each centre."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "unit array<double>", "cell int", "gap double"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            x = _matrix(batch.column("unit"), centres.shape[1])
            gaps = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
            cells = gaps.argmin(1)[:, None] if nearest else np.tile(np.arange(len(centres)), (len(x), 1))
            gaps = np.take_along_axis(gaps, cells, 1)
            at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
            columns = [batch.column(c).take(at) for c in (*keep, "unit")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.ravel().astype(np.int32)), pa.array(gaps.ravel())], [*keep, "unit", "cell", "gap"])

    return rows.select(*keep, "unit").mapInArrow(work, schema)


def reachable(queries: DataFrame, rows: DataFrame, query: str, key: str, vector: str, k: int, within: str, floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(query, unit, within, cell, gap, reach), the cells that can hold one of a query's ``k`` hits, and the rows by cell: (key, unit, within, cell, gap).

    A query's cells are those of its own value of ``within`` (null has none). Its reach is the distance of its k-th hit in the cells read
    first, or that of the cosine ``floor``.
    """
    named = unit(rows, vector).where(F.col(within).isNotNull())
    placed, n = named.select(key, within, "unit"), named.count()
    cells = int(min(MOST, max(1, n**0.5)))
    if not n:
        none = placed.withColumn("cell", F.lit(0)).withColumn("gap", F.lit(0.0))
        return none.withColumnRenamed(key, query).withColumn("reach", F.lit(0.0)), none
    centres = fit_centres(placed, key, cells)
    placed = materialize(distances(placed, centres, [key, within], True), "cells")
    stats = placed.groupBy(within, "cell").agg(F.count(F.lit(1)).alias("_n"), F.min("gap").alias("_in"), F.max("gap").alias("_out"))
    asked = unit(queries, vector).where(F.col(within).isNotNull())
    asked = distances(asked.select(query, within, "unit"), centres, [query, within], False).join(stats, [within, "cell"])
    asked = asked.withColumn("_low", F.greatest(F.lit(0.0), F.col("gap") - F.col("_out"), F.col("_in") - F.col("gap")))
    before = Window.partitionBy(query).orderBy("_low", "gap", "cell").rowsBetween(Window.unboundedPreceding, -1)
    asked = materialize(asked.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "cell-queries")
    first = hits(asked.where(F.col("_before") < FIRST * k).withColumn("reach", F.lit(2.1)), placed, query, key, within)
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), key))
    kth = first.withColumn("nth", nth).where(F.col("nth") == k).select(query, F.col("similarity").alias("_kth"))
    least = F.greatest(F.coalesce("_kth", F.lit(-1.0)), F.lit(floor)) - ROUNDING
    reach = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - least * 2)) + 1e-9
    near = asked.join(kth, query, "left").withColumn("reach", reach).where(F.col("_low") <= F.col("reach"))
    return near.select(query, "unit", within, "cell", "gap", "reach"), placed


def in_reach(near: DataFrame, placed: DataFrame, query: str, key: str, within: str) -> DataFrame:
    """The pairs that must be measured: a query's cells' rows whose own gap doesn't put them out of reach; no row is paired with its own key."""
    rows = placed.select(key, within, "cell", F.col("unit").alias("_u"), F.col("gap").alias("_g"))
    return near.join(rows, [within, "cell"]).where((F.col(query) != F.col(key)) & (F.abs(F.col("gap") - F.col("_g")) <= F.col("reach")))


def hits(near: DataFrame, placed: DataFrame, query: str, key: str, within: str) -> DataFrame:
    """(query, key, similarity) of the pairs in reach."""
    return in_reach(near, placed, query, key, within).select(query, key, dot(F.col("unit"), F.col("_u")).alias("similarity"))


def neighbours(queries: DataFrame, rows: DataFrame, query: str, key: str, vector: str, k: int, within: str, floor: float = 0.0) -> DataFrame:
    """(query, key, similarity) with each query's ``k`` nearest by cosine to 6 digits among the rows of its ``within``, and some more.

    Only cosines of at least ``floor`` count. Vectors that are null, without length, or not finite take no part, and rows without
    ``within`` neither; all vectors must have one length. Ties at the k-th place are all there.
    """
    near, placed = reachable(queries, rows, query, key, vector, k, within, floor)
    found = hits(near, placed, query, key, within).withColumn("similarity", F.round("similarity", 6))
    return found.where(F.col("similarity") >= floor)
