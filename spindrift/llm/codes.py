"""Vector codes: the nearest entry of a codebook for each part of a vector, learned in rounds with stamped bounds.

A row carries, for each part, its code, its squared distance to that entry and to the second nearest, each with the round in which it was
measured. All codebooks so far are kept, so the way an entry has gone since a bound's round is known as one net displacement: never more
than the sum of its steps, and nothing if it came back. A code is safe while the distance to its entry, plus that entry's displacement,
stays below the distance to the second, less the largest displacement of the others. Else the distance to its own entry is measured
anew, and where that isn't enough all entries are scanned.

A round reads the table of the round before, and writes the next one with each task's sums of parts in a last row. All is integers, so sums
don't depend on their order and a repeated task gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize
from .topk import _matrix, floored

SCALE = 4096
#: Relative slack of bounds against rounding of roots and sums.
SLACK = 1e-9
STATE = ("code", "near", "near_at", "next", "next_at")


class Books:
    """The codebooks of all rounds so far: an array of rounds, parts, entries and components."""

    def __init__(self, history: np.ndarray):
        self.all = history
        self.now = history[-1]
        gone = np.sqrt(((history - history[-1]).astype(np.float64) ** 2).sum(-1))  # rounds, parts, entries
        self.own = gone
        #: For each entry, the largest displacement among the others.
        self.rest = np.zeros_like(gone)
        if gone.shape[2] > 1:
            order = np.argsort(-gone, axis=2)
            first, second = (np.take_along_axis(gone, order[:, :, i : i + 1], 2) for i in (0, 1))
            self.rest = np.where(np.arange(gone.shape[2]) == order[:, :, :1], second, first)


def check_range(x: np.ndarray, books: Books) -> None:
    """An error where 64 bits don't hold a squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books.now).max(initial=0)))
    if (2 * most) ** 2 * books.now.shape[2] >= 1 << 63:
        raise OverflowError("a squared distance may exceed 64 bits")


def assign(x: np.ndarray, state: dict[str, np.ndarray] | None, books: Books, measure: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """New state of rows ``x`` (rows, parts, components), each array (rows, parts), and how many parts of each row were scanned.

    ``measure`` asks for every distance to the own entry in the present round.
    """
    rows, parts, _ = x.shape
    entries, at = books.now.shape[1], len(books.all) - 1
    if state is None:
        state = {name: np.zeros((rows, parts), np.int64) for name in STATE}
        doubt = np.ones((rows, parts), bool)
    else:
        state = {name: state[name].astype(np.int64) for name in STATE}
        doubt = np.zeros((rows, parts), bool)
        for p in range(parts):
            code, far = state["code"][:, p], np.sqrt(state["next"][:, p].astype(np.float64))
            gone = books.rest[state["next_at"][:, p], p, code]

            def unsafe(reach: np.ndarray, far: np.ndarray, gone: np.ndarray) -> np.ndarray:
                return reach + gone + SLACK * (reach + gone + far) >= far

            reach = np.sqrt(state["near"][:, p].astype(np.float64)) + books.own[state["near_at"][:, p], p, code]
            loose = unsafe(reach, far, gone) if entries > 1 else np.zeros(rows, bool)
            fresh = np.flatnonzero(loose | measure)
            state["near"][fresh, p] = ((x[fresh, p] - books.now[p, code[fresh]]) ** 2).sum(1)
            state["near_at"][fresh, p] = at
            loose = np.flatnonzero(loose)
            reach = np.sqrt(state["near"][loose, p].astype(np.float64))
            doubt[loose[unsafe(reach, far[loose], gone[loose])], p] = True
    for p in range(parts):
        scan = np.flatnonzero(doubt[:, p])
        if not len(scan):
            continue
        distance = ((x[scan, p, None] - books.now[p]) ** 2).sum(2)
        best = distance.argmin(1)
        state["code"][scan, p] = best
        state["near"][scan, p] = distance[np.arange(len(scan)), best]
        if entries > 1:
            state["next"][scan, p] = np.partition(distance, 1, axis=1)[:, 1]
        state["near_at"][scan, p] = state["next_at"][scan, p] = at
    return state, doubt.sum(1)


def part_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """For each part and entry, the component sums of the parts coded so and, last, their count."""
    hot = (code[:, :, None] == np.arange(entries)).astype(np.int64)
    return np.concatenate([np.einsum("npk,npw->pkw", hot, x), hot.sum(0)[:, :, None]], axis=2)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()).cast(kind))


def _round(rows: DataFrame, books: Books, width: int, first: bool) -> DataFrame:
    """Rows with their new state, and for each task a row that holds only ``sums``."""
    parts, entries = books.now.shape[:2]
    kinds = {"x": pa.int64(), "code": pa.int32(), "near": pa.int64(), "near_at": pa.int32(), "next": pa.int64(), "next_at": pa.int32()}
    spark_kinds = {pa.int64(): "array<long>", pa.int32(): "array<int>"}
    keep = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}"
    schema = ", ".join([keep, *(f"{c} {spark_kinds[k]}" for c, k in kinds.items()), "scans int", "sums array<long>"])

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, label = 0, None
        for batch in batches:
            if not len(batch):
                continue
            flat = _matrix(batch.column("x"), width)
            x = flat.reshape(len(batch), parts, -1)
            check_range(x, books)
            old = None if first else {c: batch.column(c).flatten().to_numpy().reshape(len(batch), parts) for c in STATE}
            state, scans = assign(x, old, books)
            total = total + part_sums(x, state["code"], entries)
            label = batch.column("label").type
            scans = scans + (0 if first else batch.column("scans").to_numpy())
            lists = [_lists(flat if c == "x" else state[c], k) for c, k in kinds.items()]
            none = pa.nulls(len(batch), pa.list_(pa.int64()))
            columns = [batch.column("vec_id"), batch.column("label"), *lists, pa.array(scans.astype(np.int32)), none]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", *kinds, "scans", "sums"])
        if label is not None:
            sums = pa.array([total.ravel().tolist()], pa.list_(pa.int64()))
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, label), *(pa.nulls(1, pa.list_(k)) for k in kinds.values()), pa.nulls(1, pa.int32()), sums]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", *kinds, "scans", "sums"])

    return rows.mapInArrow(step, schema)


def _moved(written: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebook: floored means of the parts of each entry, from the tasks' sums; entries without parts stay."""
    found = written.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    parts, entries, width = books.shape
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    for r in found.collect():
        sums[r["at"]] = r["v"]
    sums = sums.reshape(parts, entries, width + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, scans): a row for each vector that is not null and holds finite numbers only.

    Components become floor(4096 * c). Vectors are cut into ``parts`` equal parts; shorter ones, and a last part that falls short, are
    filled up with zeros. The first codebooks are the parts of the ``entries`` smallest vec_ids (null is largest, of equal ones the
    smaller vector first), fewer if there are fewer rows. ``code`` has two hex digits a part (``entries`` up to 256), ``error`` is the squared distance to the
    coded vector, ``label_error`` its sum over all rows of the label (null is a label too), ``scans`` how many times all entries were
    compared with a part of the vector: at most ``parts * (rounds + 1)``. Repeated rows each count. No rows give no rows; distances that
    64 bits don't hold are an error. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long"), F.col(label).alias("label"), floored(F.col(vector), SCALE).alias("x")).where("size(x) > 0")
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    if not longest:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, scans int")
    width = -(-longest // parts) * parts
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] + [0] * (width - len(r["x"])) for r in seeds], np.int64)
    history = start.reshape(len(seeds), parts, -1).transpose(1, 0, 2)[None]
    table = None
    for number in range(rounds):
        before, source = table, kept if table is None else table.where("sums is null").drop("sums")
        table = materialize(_round(source, Books(history), width, before is None), f"codes-{number}")
        history = np.concatenate([history, _moved(table, history[-1])[None]])
        if before is not None:
            discard(before)
    books = Books(history)
    digest = hashlib.sha256(",".join(map(str, books.now.ravel().tolist())).encode()).hexdigest()

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width).reshape(len(batch), parts, -1)
            check_range(x, books)
            old = {c: batch.column(c).flatten().to_numpy().reshape(len(batch), parts) for c in STATE}
            state, scans = assign(x, old, books, measure=True)
            code = pa.array([bytes(c).hex() for c in state["code"].astype(np.uint8)], pa.string())
            scans = pc.add(batch.column("scans"), pa.array(scans.astype(np.int32)))
            columns = [batch.column("vec_id"), batch.column("label"), code, pa.array(state["near"].sum(1)), scans]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "scans"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = table.where("sums is null").drop("sums").mapInArrow(last, f"vec_id long, label {kind}, code string, error long, scans int")
    coded = materialize(coded, "codes")
    discard(table)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "scans")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("scans")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rows by measuring all distances in every round."""
    squares = "list_sum(list_transform(list_zip(s, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT rid, p, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM (SELECT rid, x.p, k, {squares} AS d FROM x JOIN e{t} ON x.p = e{t}.p) GROUP BY ALL)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT p, k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT p, k, i, sum(c)::BIGINT AS t, count(*) AS n FROM (SELECT p, k, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM a{t} JOIN x USING (rid, p)) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"e{t + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, e) AS e FROM e{t} LEFT JOIN m{t} USING (p, k))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (SELECT rid, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS s FROM v, range({parts}) r(p)),
e0 AS MATERIALIZED (SELECT p, rid - 1 AS k, s AS e FROM x WHERE rid <= {entries}),
{", ".join(steps)},
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} JOIN v USING (rid) GROUP BY rid, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


OP12_SQL = _sql()
