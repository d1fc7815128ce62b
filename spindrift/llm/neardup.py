"""MinHash near-duplicates by a signature-coordinate inverted join.

Every different shingle set gets a signature of ``COORDINATES`` minima. A set is posted under each (coordinate, value) pair; pairs
that one set alone holds are dropped. What is left is counted as in a prefix and skip merge: two sets that collide in ``MATCHES``
coordinates meet in the shortest ``held - MATCHES + 1`` lists of each, so only those are joined (the prefix) and the long lists
are skipped; for the pairs that meet, the signatures are compared whole (the probe). Of a list's members, the smallest is its head,
and a document is paired first with the ``HEADS`` heads that it meets most often. Where members of a list are in different
components afterwards, those that can have a partner at all are compared in blocks. All links are confirmed on full sets.

A pair at similarity 0.75 collides in fewer than ``MATCHES`` of the 64 coordinates with a chance of about 2e-5; above it, less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.scratch import materialize
from .flatbytes import LOWER, SPACE, Hasher, flat, mix, pieces, runs

#: Words of a shingle; least similarity, in hundredths.
WORDS, SIMILAR = 5, 75
COORDINATES, MATCHES = 64, 33
#: List heads that a document is paired with; documents of a block.
HEADS, BLOCK = 2, 512

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text: A-Z lower-cased, words parted by x20 and x09 to x0D.

    A text with fewer than five words is one shingle; a text without words or a null has none.
    """
    data, ends = flat(column)
    data = LOWER[data]
    starts, stops = runs(~SPACE[data])
    words = Hasher(data)(starts, stops)
    counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(column))
    first = np.cumsum(counts) - counts
    if len(words) >= WORDS:
        last = len(words) - WORDS + 1
        rows = sum((words[i : last + i] * _STEP[i] for i in range(1, WORDS)), words[:last] * _STEP[0])
        rows = mix(rows)
    out = []
    for at, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(rows[at : at + n - WORDS + 1]))
        elif n:
            out.append(mix(np.add.reduce(words[at : at + n] * _STEP[:n], keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of coordinate keys for each set, none of which may be empty; a key stands for a coordinate and its minimum."""
    items = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((items ^ _XOR[k]) * _MUL[k], first)
    return mix(out ^ _MUL)


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        full = sizes > 0
        h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        keys = np.empty((0, COORDINATES), np.uint64)
        if full.any():
            some = [s for s in sets if len(s)]
            keys = signatures(some)
            first = np.cumsum(sizes[full]) - sizes[full]
            items = np.concatenate(some)
            h1[full], h2[full] = np.add.reduceat(items, first), np.add.reduceat(mix(items), first)
        offsets = np.concatenate([[0], np.cumsum(full)]) * COORDINATES
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes),
                pa.array(h1.view(np.int64), mask=~full),
                pa.array(h2.view(np.int64), mask=~full),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64).ravel())),
            ],
            ["doc_id", "n_shingles", "h1", "h2", "sig"],
        )


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text_a"):
        left, right = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
        keep = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both) and both > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        items = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("comp"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))],
            ["doc", "comp", "items"],
        )


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full shingle sets."""
    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _sharing(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``members`` (doc, comp) of whose shingles at least ``SIMILAR`` hundredths occur in another member, as (doc, comp, n).

    The others hold too much that is theirs alone to be similar to any member. Exact, and linear in the members' shingles.
    """
    sets = texts.join(members, "doc").select("doc", "comp", "text").mapInArrow(_shingles, "doc long, comp long, items array<long>")
    items = sets.select("doc", "comp", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("item")
    shared = items.join(often, "item", "left_semi").groupBy("doc").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.count(F.lit(1)).alias("shared"))
    return shared.where(f"100 * shared >= {SIMILAR} * n").select("doc", "comp", "n")


def _compare(table: pa.Table) -> pa.Table:
    """Links between documents of different components in a cluster, which comes whole or as two of its blocks.

    Pairs that collide in ``MATCHES`` coordinates are confirmed on their full sets at once; a link makes its two components one, so
    that the links found are a forest and no pair within a component is looked at.
    """
    cluster, doc, comp, n, block = (table[c].to_numpy() for c in ("cluster", "doc", "comp", "n", "block"))
    sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    items = table["items"].combine_chunks()
    at, items = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    found: list[tuple[int, int]] = []
    order = np.argsort(cluster, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        left, right = rows[block[rows] == low], rows[block[rows] == high]
        label = comp[right].copy()
        for i in left:
            own = comp[i] if low != high else label[np.flatnonzero(right == i)[0]]
            fits = (label != own) & (100 * n[i] >= SIMILAR * n[right]) & (100 * n[right] >= SIMILAR * n[i])
            near = np.flatnonzero(fits)
            near = near[(sig[right[near]] == sig[i]).sum(1) >= MATCHES]
            mine = items[at[i] : at[i + 1]]
            for k in near.tolist():
                if label[k] == own:
                    continue
                j = right[k]
                both = len(np.intersect1d(mine, items[at[j] : at[j + 1]], assume_unique=True))
                if 100 * both >= SIMILAR * (n[i] + n[j] - both):
                    found.append((int(doc[i]), int(doc[j])))
                    label[label == label[k]] = own
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _across(rest: DataFrame, prefix: DataFrame, sig: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``rest`` (doc, comp, n) that join components, between documents that meet in lists.

    Documents are clustered by the lists they meet in. A cluster goes in blocks of ``BLOCK`` documents, each pair of blocks to a
    task; small clusters share tasks. Pairs are compared and confirmed in the task, and only links become rows.
    """
    held = prefix.join(rest, "doc")
    lists = held.groupBy("key").agg(F.min("doc").alias("b"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    clusters = connected_components(held.join(lists, "key").select(F.col("doc").alias("a"), "b"))
    clusters = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held = rest.join(clusters, "doc").join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    sets = texts.join(rest, "doc").select("doc", "comp", "text").mapInArrow(_shingles, "doc long, comp long, items array<long>")
    held = held.join(sets.select("doc", "items").dropDuplicates(["doc"]), "doc")
    held = held.join(sig.select(F.col("doc_id").alias("doc"), "sig").where("size(sig) > 0").dropDuplicates(["doc"]), "doc")
    groups = max(1, 4 * rest.count() // BLOCK)
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    held = held.withColumn("group", F.pmod("cluster", F.lit(groups))).drop("other", "blocks")
    return held.groupBy("group", "low", "high").applyInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; further columns are not read).

    Null and empty texts have no shingles and stay alone, as do rows without doc_id, whose component_id is null and which are kept.
    Equal sets are one vertex. Rows that share a doc_id are one document, linked by any of its sets; where blocks are compared, one stands for it. An empty table gives an
    empty result. Long texts are read whole.
    """
    sig = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign, _SIGNED), "neardup-sig")
    reps = sig.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))

    own = sig.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    posts = own.select(F.col("doc_id").alias("doc"), F.explode("sig").alias("key"))
    each = Window.partitionBy("doc")
    # counted before the shuffle and joined back, so that a list which many sets share meets in no one task
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    prefix = (
        posts.join(often, "key")
        .withColumn("held", F.count(F.lit(1)).over(each))
        .where(f"held >= {MATCHES}")
        .withColumn("at", F.row_number().over(each.orderBy("df", "key")))
        .where(f"at <= held - {MATCHES} + 1")
    )
    prefix = materialize(prefix.select("doc", "key"), "neardup-prefix")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    texts = materialize(texts.join(prefix.select("doc").distinct(), "doc", "left_semi"), "neardup-texts")

    lists = prefix.groupBy("key").agg(F.min("doc").alias("b"), F.max("doc").alias("z")).where("b < z")
    met = prefix.join(lists, "key").where("doc <> b").groupBy(F.col("doc").alias("a"), "b").agg(F.count(F.lit(1)).alias("met"))
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b"))
    met = materialize(met.withColumn("at", most).where(f"at <= {HEADS}").select("a", "b"), "neardup-met")
    side = lambda c: sig.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    probed = met.join(side("a"), "a").where("n_a > 0").join(side("b"), "b")
    probed = probed.where(f"100 * n_a >= {SIMILAR} * n_b and 100 * n_b >= {SIMILAR} * n_a")
    probed = probed.where(F.size(F.array_intersect("sig_a", "sig_b")) >= MATCHES).select("a", "b").distinct()
    links = materialize(_links(probed, texts), "neardup-links")
    labels = connected_components(links)

    members = prefix.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
    ends = F.max("doc").alias("a"), F.min("doc").alias("b")
    apart = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n"), *ends).where("x < y")
    # two members need no more only if they were paired above
    apart = apart.join(met.withColumn("paired", F.lit(True)), ["a", "b"], "left").where("n > 2 or paired is null")
    rest = materialize(members.join(apart.select("key"), "key").select("doc", "comp").distinct(), "neardup-rest")
    if not rest.isEmpty():
        rest = materialize(_sharing(rest, texts), "neardup-sharing")
        more = materialize(_across(rest, prefix, sig, texts), "neardup-links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    labels = materialize(labels, "neardup-labels")

    out = sig.join(reps, ["h1", "h2"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
