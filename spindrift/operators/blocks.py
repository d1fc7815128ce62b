"""Exact neighbours by all pairs, in blocks: each query meets each row of its filter once, as matrices of bounded size.

Rows of a filter value fall into blocks, and so do its queries. A pair of blocks is a unit of work: it holds one block of each and gives
each query's best rows there. All pairs are measured; what is shuffled grows with blocks times queries, not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..sources.scratch import materialize, spread_out
from .pruned import SENT

#: Rows and queries of a block, and queries that are measured at once; blocks of a filter value of few rows, and how small they may be.
ROWS, ASKED, AT_ONCE, SPREAD, SMALL = 8192, 4096, 256, 4, 512


def weighted_units(rows: DataFrame, parts: list[tuple[Column, int, float]]) -> DataFrame:
    """``rows`` with ``unit``: vectors (column, dimensions, weight) end to end, each at the length of its weight's root, so that the product
    of two units is the weighted sum of the parts' cosines. A part that is null, holds null, has no length or not its dimensions counts 0."""
    lengths = rows.withColumns({f"_v{i}": p[0].cast("array<double>") for i, p in enumerate(parts)})
    lengths = lengths.withColumns({f"_n{i}": norm(F.col(f"_v{i}")) for i in range(len(parts))})

    def scaled(i: int, width: int, weight: float) -> Column:
        v, length = F.col(f"_v{i}"), F.col(f"_n{i}")
        return F.when((F.size(v) == width) & (length > 0), F.transform(v, lambda x: x / length * weight**0.5)).otherwise(F.array_repeat(F.lit(0.0), width))

    return lengths.select(*rows.columns, F.concat(*(scaled(i, width, weight) for i, (_, width, weight) in enumerate(parts))).alias("unit"))


def _best(each: int, names: list[str]):
    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy()
        matrix = lambda t: t.column("unit").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 3 + [np.empty(0)]]
        if len(rows) and len(asked):
            order = np.lexsort((numbers(rows, "_key"), numbers(rows, "_group")))  # of equal scores the smaller key is met first
            keys, groups, units = numbers(rows, "_key")[order], numbers(rows, "_group")[order], matrix(rows)[order].T
            ends = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            ids, all_asked = numbers(asked, "_query"), matrix(asked)
            for at in range(0, len(ids), AT_ONCE):
                some = ids[at : at + AT_ONCE]
                scores = all_asked[at : at + AT_ONCE] @ units
                scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores) / 1e6
                scores[some[:, None] == keys] = -np.inf
                for a, b in zip(ends, ends[1:], strict=False):
                    part, line = scores[:, a:b], np.arange(len(some))
                    for _ in range(each):
                        to = part.argmax(1)
                        score = part[line, to]
                        kept = score != -np.inf
                        found.append([some[kept], keys[a + to[kept]], groups[a + to[kept]], score[kept]])
                        part[line, to] = -np.inf
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names)

    return best


def best_of_groups(queries: DataFrame, rows: DataFrame, query: str, key: str, group: str, within: str, each: int) -> DataFrame:
    """(query, key, group, score): of each block, a query's ``each`` best rows of each group by the product of units to 6 digits, ties to the
    smaller key. So each query's ``each`` best of a group are there, and some more.

    ``queries`` are (query, within, unit), ``rows`` (key, group, within, unit); ids and groups are whole numbers. Only rows of a query's own
    ``within`` count; null has none, and no row is paired with its own key.
    """
    queries = queries.dropna(subset=[query, within]).select(F.col(query).cast("long").alias("_query"), F.col(within).alias("_in"), "unit")
    rows = rows.dropna(subset=[key, within]).select(F.col(key).cast("long").alias("_key"), F.col(group).cast("long").alias("_group"), F.col(within).alias("_in"), "unit")
    # a number for each, so that equal keys don't meet in one block
    queries = materialize(spread_out(queries).withColumn("_at", F.monotonically_increasing_id()), "block-queries")
    rows = spread_out(rows).withColumn("_at", F.monotonically_increasing_id())
    blocks = lambda n, most: F.least(F.ceil(F.col(n) / SMALL), F.greatest(F.lit(SPREAD), F.ceil(F.col(n) / most))).cast("int")
    sizes = rows.groupBy("_in").agg(F.count(F.lit(1)).alias("_n")).join(queries.groupBy("_in").agg(F.count(F.lit(1)).alias("_q")), "_in")
    sizes = materialize(sizes.select("_in", blocks("_n", ROWS).alias("_rows"), F.ceil(F.col("_q") / ASKED).cast("int").alias("_asked")), "block-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= SENT else sizes
    own = lambda n: F.pmod(F.xxhash64("_at"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = rows.join(sizes, "_in").select("_key", "_group", "unit", "_in", own("_rows").alias("_r"), every("_asked").alias("_a"))
    asked = queries.join(sizes, "_in").select("_query", "unit", "_in", every("_rows").alias("_r"), own("_asked").alias("_a"))
    at = ["_in", "_r", "_a"]
    names = [query, key, group, "score"]
    schema = ", ".join(f"`{c}` long" for c in names[:3]) + ", score double"
    return placed.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_best(each, names), schema)
