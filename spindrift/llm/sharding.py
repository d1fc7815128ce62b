"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Rows that one task numbers within a shard, on average.
SLOT_ROWS = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of 64-bit keys: with one more shard, a key stays or moves to the new one."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[live] = np.minimum(step, 1 << 62).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text; others are not read).

    The key is a hash of doc_id alone, so rows that share one share a shard; rows without doc_id count as one key. ``size`` is the
    text's UTF-8 bytes plus 8 and null counts as the empty text, with checksum 0. Slots number a shard's rows from 0 by a hash
    bucket and then doc_id: buckets are counted first, so no task orders a whole shard. Equal rows take neighbouring slots.
    """

    @F.pandas_udf("int")
    def placed(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(), int(n.iloc[0])) if len(key) else [], dtype="int32")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    buckets = max(1, docs.count() // (SLOT_ROWS * shards))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)))
    base = base.withColumn("shard", placed("key", F.lit(shards))).withColumn("grown_shard", placed("key", F.lit(shards + 1)))
    base = materialize(base, "sharding")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return base.join(counts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op5_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
