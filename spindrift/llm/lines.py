"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference counts.

The index keeps, for each document, the keys of its lines; for each key, how many documents hold it and which is the last; and for each
shard of the keys a cuckoo filter of those that enough documents hold. Adding documents raises counts, deleting them lowers counts, and
keys that pass the threshold on the way go into the filter of their shard or come out of it. A line whose key is in no filter stays: only
the others ask the exact table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .cuckoo import SLOTS, Cuckoo, other, prints, words

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Code points of the shortest key that is counted.
SHORTEST = 20
#: Keys of a shard's filter when shards are dealt, and bytes of all filters that may be sent to every task.
SHARD_KEYS, FILTER_BYTES = 200_000, 64 << 20


@dataclass(frozen=True)
class LineIndex:
    """``lines`` (doc_id, keys), ``counts`` (key, refs, owner), ``filters`` (shard, slots): written tables. ``least``: documents that make a key repeated."""

    lines: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int


def line_keys(text: Column) -> Column:
    """The different keys of a text's lines as 16-byte hashes: lines stripped of ``BLANK`` and lower-cased in A-Z, of ``SHORTEST`` code points or more."""
    long = F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(BLANK))), lambda s: F.length(s) >= SHORTEST)
    # for ASCII alone, lower() does the same, faster
    lower = F.transform(long, lambda s: F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER)))
    return F.transform(F.array_distinct(lower), lambda s: F.unhex(F.md5(s)))


def key_of(line: str) -> bytes | None:
    """``line_keys`` of one line."""
    key = line.strip(BLANK)
    return hashlib.md5(key.translate(_FOLD).encode()).digest() if len(key) >= SHORTEST else None


def _pairs(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", F.explode("keys").alias("key"))


def _shard(shards: int) -> Column:
    """A key's shard, from its first word, as ``words`` reads it."""
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _changed(filters: DataFrame | None, keys: DataFrame, shards: int, remove: bool = False) -> DataFrame | None:
    """Filters with ``keys`` put in or taken out, each shard in a task of its own; None if a shard is too full for its keys."""

    def work(old: list[bytes], w: np.ndarray) -> tuple[bytes, bool]:
        found = Cuckoo.read(old[0]) if old else Cuckoo.sized(len(w))
        if remove:
            found.remove(w)
            return found.slots.tobytes(), False
        full = found.used + len(w) > 0.9 * found.slots.size or not found.insert(w)
        return found.slots.tobytes(), full

    def grouped(shard: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        slots, full = work(a["slots"].to_pylist(), words(b["key"].to_pylist()))
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "slots": pa.array([slots], pa.binary()), "full": [full]})

    spark = keys.sparkSession
    if filters is None:
        filters = spark.createDataFrame([], "shard int, slots binary")
    dealt = keys.select("key").withColumn("shard", _shard(shards))
    both = filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(grouped, "shard int, slots binary, full boolean")
    both = materialize(both, "line-filters")
    return None if both.where("full").count() else both.drop("full")


def _filters(counts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Filters of all repeated keys, and how many shards."""
    repeated = counts.where(F.col("refs") >= least)
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    built = _changed(None, repeated, shards)
    if built is None:  # half-filled at most, so a key without a place means very many equal hashes
        raise RuntimeError("a filter has no place for its keys")
    return built, shards


def _grown(index: LineIndex, keys: DataFrame) -> LineIndex:
    """The index, its counts up to date, with the newly repeated ``keys`` in its filters; dealt anew where a shard overflows."""
    filters = _changed(index.filters, keys, index.shards)
    if filters is None:
        filters, shards = _filters(index.counts, index.least)
        return replace(index, filters=filters, shards=shards)
    return replace(index, filters=filters)


def build(docs: DataFrame, least: int = 3) -> LineIndex:
    """The index of ``docs`` (doc_id, text): see ``insert``."""
    lines = _lines(docs)
    counts = materialize(_counted(_distinct(lines)), "line-counts")
    filters, shards = _filters(counts, least)
    return LineIndex(lines, counts, filters, shards, least)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents. Rows without doc_id are no documents and hold no key; rows that share one are one document, also with rows
    indexed before. Null and empty texts hold no key. Reruns and any order of insertions give the same counts."""
    lines = _lines(docs)
    held = _pairs(index.lines.join(lines.select("doc_id").distinct(), "doc_id", "left_semi"))
    fresh = _distinct(lines).join(held, ["doc_id", "key"], "left_anti")
    delta = materialize(_counted(fresh), "line-delta")
    merged = index.counts.unionByName(delta).groupBy("key").agg(F.sum("refs").alias("refs"), F.max("owner").alias("owner"))
    counts = materialize(merged, "line-counts")
    now = counts.join(delta.select("key", F.col("refs").alias("more")), "key").where(F.col("refs") >= index.least)
    crossed = now.where(F.col("refs") - F.col("more") < index.least)
    return _grown(replace(index, lines=index.lines.unionByName(lines), counts=counts), crossed)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (doc_id), as if they had never been put in; unknown ids are passed over."""
    ids = ids.select("doc_id").distinct()
    left = materialize(index.lines.join(ids, "doc_id", "left_anti"), "lines")
    gone = _distinct(index.lines.join(ids, "doc_id", "left_semi")).groupBy("key").agg(F.count(F.lit(1)).alias("less"))
    touched = materialize(index.counts.join(gone, "key"), "line-delta")
    owners = _pairs(left).join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("last"))
    kept = touched.where("refs > less").join(owners, "key").select("key", (F.col("refs") - F.col("less")).alias("refs"), F.col("last").alias("owner"))
    counts = materialize(index.counts.join(touched.select("key"), "key", "left_anti").unionByName(kept), "line-counts")
    crossed = touched.where((F.col("refs") >= index.least) & (F.col("refs") - F.col("less") < index.least))
    filters = _changed(index.filters, crossed, index.shards, remove=True)
    return replace(index, lines=left, counts=counts, filters=filters)


def _lines(docs: DataFrame) -> DataFrame:
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), line_keys(F.col("text").cast("string")).alias("keys"))
    return materialize(keyed.where("size(keys) > 0"), "lines")


def _distinct(lines: DataFrame) -> DataFrame:
    """(doc_id, key), each once. A row's keys differ, so only rows that share a doc_id can repeat a pair."""
    shared = lines.groupBy("doc_id").count().where("count > 1")
    return _pairs(lines) if shared.isEmpty() else _pairs(lines).distinct()


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("owner"))


def candidates(index: LineIndex, lines: DataFrame) -> DataFrame:
    """The (doc_id, key) of ``lines`` whose key may be repeated: those that their shard's filter holds.

    Filters go to all tasks if they have ``FILTER_BYTES`` at most; beyond that all pairs are candidates, which changes no result.
    """
    size = index.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    if size > FILTER_BYTES:
        return _pairs(lines)
    tables = {r["shard"]: np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS) for r in index.filters.collect()}
    none = np.zeros((1, SLOTS), np.uint16)
    parts = [tables.get(s, none) for s in range(index.shards)]
    start = np.cumsum([0, *(len(p) for p in parts)])[:-1]
    mask = np.array([len(p) for p in parts]) - 1
    sent = lines.sparkSession.sparkContext.broadcast(np.concatenate(parts))
    shards = index.shards

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten()
            w = words(flat.to_pylist())
            shard, mark = w[:, 0] % shards, prints(w)
            first = w[:, 1].astype(np.int64) & mask[shard]
            second = other(first, mark, mask[shard])
            hit = ((slots[start[shard] + first] == mark[:, None]) | (slots[start[shard] + second] == mark[:, None])).any(1)
            owner = np.repeat(np.arange(len(batch)), np.diff(keys.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner[hit])), flat.filter(pa.array(hit))], ["doc_id", "key"])

    return lines.select("doc_id", "keys").mapInArrow(probe, "doc_id long, key binary")


def deduplicate(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the texts of indexed ``docs`` without the lines that a later document repeats.

    A key of at least ``SHORTEST`` code points that ``index.least`` documents hold loses its lines in all of them but the one of largest
    doc_id, where all stay. Other lines stay, joined by \\n. A null text is one empty line. Rows without doc_id keep all lines; rows that
    share one are one document, so lines of one may go because of the other's. Texts go whole to the task that cuts them.
    """
    found = candidates(index, index.lines).join(index.counts.where(F.col("refs") >= index.least), "key").where("doc_id < owner")
    drops = found.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))

    @F.pandas_udf("kept string, dropped int")
    def cut(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(text, drops):
            if t is None:
                out.append((None, 0))
                continue
            d, lines = set(d), t.split("\n")
            kept = [line for line in lines if key_of(line) not in d]
            out.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "dropped"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(drops, "doc_id", "left")
    # a text that loses nothing isn't sent to Python
    rows = rows.withColumn("cut", cut(F.when(F.col("drops").isNotNull(), F.col("text")), F.col("drops")))
    return rows.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.col("cut.dropped").cast("long").alias("n_dropped"),
        F.coalesce("cut.kept", "text").alias("kept"),
    )


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(build(docs), docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), h AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < owner) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR doc_id >= owner), '')) AS kept_sha256
FROM l LEFT JOIN h USING (key) GROUP BY doc_id
"""
