"""Mixing sources to target weights: hash-random order, distributed prefix sums, and a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Weights of the sources by code point order, repeating; the mix's size over the sum of all sizes; most passes over a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows whose sizes one task sums up, on average.
RANGE_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from the sizes (source, source_size) of all sources.

    Sources share ``SHARE`` of all words by weight; a target stops at ``EPOCHS`` times its source's size and what is above is shared
    anew among the others by weight until none is above. Filled from the lowest cap a weight upward, that is one pass: a source
    is capped if its cap is within its share of what is then left. This orders the sources, not the documents, in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), nth + 1).cast("double")
    whole = Window.partitionBy()
    t = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * EPOCHS).cast("double"))
    t = t.withColumn("budget", F.sum("source_size").over(whole).cast("double") * SHARE)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    t = t.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, text; others are not read).

    A source's rows are ordered by the MD5 of doc_id. Its budget is the whole words of its target: as many full passes as fit,
    then the words of the first rows until the budget is spent, the last row in part. Sizes are summed per (source, range of
    keys) first, so no task holds a whole source. Null texts have size 0; a null source is a source; rows without doc_id come
    first; equal rows are interchangeable, so reruns agree.
    """
    digits = 1
    rows = docs.count()
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select("doc_id", F.col("source").cast("string"), words(F.col("text")).alias("size"), key.alias("key"))
    base = materialize(base.withColumn("range", F.substring("key", 1, digits)), "mixing")
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = base.withColumn("end", F.sum("size").over(order))
    r, t = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), "start"), targets.withColumnRenamed("source", "t_source")
    placed = summed.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    placed = placed.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("start") + F.col("end") - F.col("size"))))
    return placed.select("doc_id", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM l
), p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_passes FROM p)
SELECT doc_id, size, source_size, target,
       CAST(full_passes * size + greatest(0, least(size, budget - full_passes * source_size - start)) AS BIGINT) AS taken
FROM e
"""
