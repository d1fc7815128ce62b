"""Whitening of embeddings onto their principal components.

Vectors become integers, so sums and squared deviations are exact. Each task adds up moments of its rows and sends one row per entry; the
covariance, whose size depends on the dimension alone, is split on the driver by polar decompositions (``qdwh``), and the few components
go back to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .qdwh import EPS, top_eigenvectors
from .topk import _matrix, floored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` (vec_id and ``vector``) as (vec_id, x), without those whose vector is null, empty or holds null or non-finite entries.

    Vectors shorter than the longest are filled up by entries of 0.
    """
    x = F.transform(floored(F.col(vector), SCALE), lambda v: v + F.lit(SHIFT).cast("long"))
    kept = rows.select(F.col("vec_id").cast("long"), x.alias("x")).where("size(x) > 0")
    least, most = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return kept
    return kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(most) - F.size("x"))))


def spread(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exactly: as 64-bit integers where they hold it, else as Python's."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return x * n - total
    return x.astype(object) * n - total.astype(object)


def squared(t: np.ndarray) -> np.ndarray:
    """Row sums of squares, exactly; an error where one exceeds a 64-bit integer."""
    if int(np.abs(t).max(initial=0)) ** 2 * t.shape[1] >= 1 << 63:
        t = t.astype(object)
    out = (t * t).sum(1)
    if out.dtype == object and len(out) and max(out) >= 1 << 63:
        raise OverflowError("a squared deviation exceeds 64 bits")
    return out.astype(np.int64)


def _sums(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all vectors of ``add`` (of a block of vectors), whose length must depend on the dimension alone.

    A task adds up its blocks and sends one row per position; positions are added up by a shuffle. Empty for an empty frame.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if len(batch):
                x = batch.column("x")
                total = total + add(_matrix(x, len(x[0])))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    parts = rows.select("x").mapInArrow(part, f"at long, v {kind}")
    found = sorted(parts.groupBy("at").agg(F.sum("v").alias("v")).collect())
    return np.array([r["v"] for r in found], np.int64 if kind == "long" else np.float64)


def whiten(rows: DataFrame, components: int = 16, vector: str = "embedding") -> DataFrame:
    """The columns of ``OUT``: a row for each vector and component, by falling eigenvalue.

    The fit list is each distinct integer vector once: ``n`` vectors. ``deviation`` is the sum over dimensions of (n * x - sum)^2, an
    error where 64 bits don't hold it. ``whitened`` is the centred vector on the component over the root of its eigenvalue.
    ``explained`` is the eigenvalue's share of the trace. ``identity_error`` is measured: the largest entry by which the covariance of
    the whitened fit list differs from the identity. Vectors that are null, empty or not finite are dropped; repeated rows and ids each
    give their rows; shorter vectors are filled up by zeros. Components without variance (an eigenvalue within rounding of 0) don't
    exist, so equal vectors, one vector or none give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = integers(rows, vector)
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    sums = _sums(fit, lambda x: np.append(x.sum(0), len(x)), "long")
    if not len(sums):
        return spark.createDataFrame([], OUT)
    total, n = sums[:-1], int(sums[-1])
    centred = lambda x: (spread(x, n, total) / n).astype(np.float64)
    upper = np.triu_indices(len(total))

    def products(x: np.ndarray) -> np.ndarray:
        d = centred(x)
        return (d.T @ d)[upper]

    covariance = np.zeros((len(total),) * 2)
    covariance[upper] = _sums(fit, products, "double") / n
    covariance = covariance + np.triu(covariance, 1).T
    values, vectors = top_eigenvectors(covariance, components)
    real = values > len(total) * EPS * max(values.max(initial=0), 0)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return spark.createDataFrame([], OUT)
    turn, explained, k = vectors / np.sqrt(values), values / np.trace(covariance), len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    m = _sums(fit, moments, "double") / n
    error = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(total))
            t = spread(x, n, total)
            at = np.repeat(np.arange(len(x)), k)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(at), n)),
                "deviation": pa.array(squared(t)[at]),
                "whitened": pa.array(((t / n).astype(np.float64) @ turn).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(at), error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return kept.mapInArrow(project, OUT)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
