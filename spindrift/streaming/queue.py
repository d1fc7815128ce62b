"""The work queue as a stream: an at-least-once file source, deduplicated and upserted per batch, with heartbeats by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import ChunkStore


def read_tasks(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_tasks(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], store: ChunkStore, index: str, checkpoint: str, key: str = "id"):
    """Start a query that works each batch, highest priority first, and upserts what it gives; replays change nothing."""

    def each(batch: DataFrame, _: int) -> None:
        ordered = batch.sortWithinPartitions(F.desc("priority")) if "priority" in batch.columns else batch
        store.upsert(index, work(ordered), key)

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeats(events: DataFrame, worker: str, time: str, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, worker, beats, last): works on static and streaming frames alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, every), worker).agg(F.count(F.lit(1)).alias("beats"), F.max(time).alias("last"))
