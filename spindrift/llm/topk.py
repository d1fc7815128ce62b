"""Exact top-k search by MaxScore.

A vector's components are the weights of its terms. Queries go in blocks against shards of the rows. A shard keeps its rows longest
first and a posting list for each signed term (dimension, sign), cut into strides. A query's terms have score bounds in the shard.
Sorted by bound, they are split where the bounds' sum stays below the threshold: a row in no essential posting list cannot reach it.
Stride by stride, the essential lists are traversed, the rows found are scored on the essential terms, and the others are probed,
largest bound first, only while a row can still compete; then the threshold rises and the split is drawn anew, until no term is
essential. All shards start from the threshold that the longest rows of the whole table give. Shards are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, rows between two rises of the threshold, longest rows that give the first threshold.
SHARD, BLOCK, STRIDE, SEEDS = 16384, 16384, 1024, 2048


def floored(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _width(*columns: pa.Array | pa.ChunkedArray) -> int:
    return max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns)


def _exact(*matrices: np.ndarray) -> bool:
    """Whether doubles hold all inner products of the matrices' rows."""
    a, b = (int(np.abs(m).max(initial=0)) for m in matrices)
    return a * b * matrices[0].shape[1] < 1 << 53


class Shard:
    """Rows, longest first, and for each signed term the positions of its rows in order and where each stride begins among them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, stride: int, doubles: bool):
        order = np.argsort(-(rows.astype(np.float64) ** 2).sum(1), kind="stable")
        self.rows, self.ids = rows[order].astype(np.float64 if doubles else np.int64), ids[order]
        self.high, self.low = self.rows.max(0, initial=0), self.rows.min(0, initial=0)
        self.cuts = np.minimum(np.arange(0, len(rows) + stride, stride), len(rows))
        self.lists = {}
        for d in range(rows.shape[1]):
            for sign in (1, -1):
                at = np.flatnonzero(sign * self.rows[:, d] > 0)
                self.lists[d, sign] = at, np.searchsorted(at, self.cuts)

    def search(self, query: np.ndarray, own: int, floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows that reach ``floor`` (None: of all), but those with the id ``own``; ties to the smaller id."""
        query = query.astype(self.rows.dtype)
        sign = np.where(query < 0, -1, 1)
        bound = np.where(query < 0, query * self.low, query * self.high)
        order = np.argsort(bound, kind="stable")
        total = np.cumsum(bound[order])
        best, scores = np.empty(0, np.int64), np.empty(0, self.rows.dtype)
        for i, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            if floor is None or floor <= 0:  # rows in no list can compete
                weak, found = 0, np.arange(lo, hi)
            else:
                weak = int(np.searchsorted(total, floor, side="left"))  # so many terms sum to less than the threshold
                if weak == len(order):
                    break
                hit = np.zeros(hi - lo, bool)
                for d in order[weak:].tolist():
                    at, cut = self.lists[d, int(sign[d])]
                    hit[at[cut[i] : cut[i + 1]] - lo] = True
                found = lo + np.flatnonzero(hit)
            found = found[self.ids[found] != own]
            strong = order[weak:]
            score = self.rows[np.ix_(found, strong)] @ query[strong]
            for t in range(weak - 1, -1, -1):
                live = score + total[t] >= floor
                if not live.all():
                    found, score = found[live], score[live]
                score = score + self.rows[found, order[t]] * query[order[t]]
            if floor is not None:
                live = score >= floor
                found, score = found[live], score[live]
            best, scores = np.concatenate([best, found]), np.concatenate([scores, score])
            first = np.lexsort((self.ids[best], -scores))[:k]
            best, scores = best[first], scores[first]
            if len(best) == k and (floor is None or scores[-1] > floor):
                floor = scores[-1]
        return best, scores


def _first_thresholds(queries: DataFrame, rows: DataFrame, k: int, seeds: int) -> DataFrame:
    """``queries`` with the k-th best score among the ``seeds`` longest rows in ``floor``; null where they are too few."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = rows.orderBy(length.desc()).limit(seeds).toArrow()
    vectors, ids = longest["v"], longest["vec_id"].to_numpy()

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, len(b), 1024)):
            v, own = batch.column("v"), batch.column("query_id").to_numpy()
            width = _width(v, vectors)
            q, x = _matrix(v, width), _matrix(vectors, width)
            floor = pa.nulls(len(q), pa.int64())
            if len(ids) >= k and _exact(q, x):
                scores = np.where(own[:, None] == ids, -np.inf, q.astype(np.float64) @ x.astype(np.float64).T)
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                none = np.isneginf(kth)
                floor = pa.array(np.where(none, 0, kth).astype(np.int64), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), v, floor], ["query_id", "v", "floor"])

    return queries.select("query_id", "v").mapInArrow(start, "query_id long, v array<long>, floor long")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query.

    Both frames hold vec_id and v (array<long>). Rows with a null id or vector take no part; shorter vectors count as padded with
    zeros. A query skips every row of its own id. Queries that repeat an id count once (the smallest vector); rows that repeat an
    id are candidates each. Ties go to the smaller vec_id. Sums must stay below 2**63.
    """
    rows = rows.select(F.col("vec_id").cast("long"), "v").where("vec_id is not null and v is not null")
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), "v").where("query_id is not null and v is not null")
    queries = queries.groupBy("query_id").agg(F.min("v").alias("v"))
    stride = STRIDE
    shards, blocks = max(1, -(-rows.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _first_thresholds(queries, rows, k, SEEDS).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", spread(shards))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", spread(blocks))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        width = _width(a["v"], b["v"])
        q, x = _matrix(a["v"], width), _matrix(b["v"], width)
        shard = Shard(x, b["vec_id"].to_numpy(), stride, _exact(q, x))
        own, floors = a["query_id"].to_pylist(), a["floor"].to_pylist()
        got = [shard.search(*args, k) for args in zip(q, own, floors)]
        none = np.empty(0, np.int64)
        return pa.table(
            {
                "query_id": np.repeat(np.array(own, np.int64), [len(at) for at, _ in got]),
                "vec_id": np.concatenate([none, *(shard.ids[at] for at, _ in got)]),
                "score": np.concatenate([none, *(score.astype(np.int64) for _, score in got)]),
            }
        )

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_maxscore_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", floored(F.col("embedding")).alias("v"))
    return top_k(rows.where("vec_id % 100 = 0"), rows)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
