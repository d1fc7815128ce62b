"""Language identification of words by a linear-chain conditional random field.

A word's features are its affixes (first and last 2 to 4 bytes), its byte trigrams and itself (the lexicon), all hashed; labels
chain by learned transitions. Forward-backward gives every word's label distribution, so code-switched text is labelled word by
word; a document takes the label with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .flatbytes import Hasher, flat, pieces, runs

#: The model: hashed weights a label; the sample it is fitted on: windows a label and the characters of one; passes.
BUCKETS, SAMPLE, SAMPLE_CHARS, PASSES = 1 << 18, 200, 6000, 6
STEP = 64  # words of a block of the chain
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_SALTS = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(1 << 40, 1 << 62, 8)]


class Words:
    """The words of a text column: where they are, their row, and their hashed features."""

    def __init__(self, column: pa.Array):
        data, ends = flat(pc.utf8_lower(column))
        inside = _LETTER[data]
        starts, stops = runs(inside)
        self.starts, self.stops = starts, stops
        self.row = np.searchsorted(ends, starts, side="right")
        self.counts = np.bincount(self.row, minlength=len(column))
        size = stops - starts
        plain = np.where(inside, data, 32).astype(np.uint64)
        hasher = Hasher(data)
        self.features = np.empty((7, len(starts)), np.int32)
        self.features[0] = self._bucket(hasher(starts, stops), 0)
        for i, n in enumerate((2, 3, 4)):
            cut = np.minimum(size, n)
            self.features[1 + i] = self._bucket(hasher(starts, starts + cut), 1 + i)
            self.features[4 + i] = self._bucket(hasher(stops - cut, stops), 4 + i)
        at = np.flatnonzero(inside)
        before = np.where(at > 0, plain[at - 1], np.uint64(32))
        self.trigrams = self._bucket(before << np.uint64(16) | plain[at] << np.uint64(8) | plain[at + 1], 7)
        self.size, self.first = size, np.cumsum(size) - size

    @staticmethod
    def _bucket(key: np.ndarray, kind: int) -> np.ndarray:
        return (((key ^ _SALTS[kind]) * _SALTS[kind]) >> np.uint64(64 - 18)).astype(np.int32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(weights[self.trigrams], self.first, axis=0) / self.size[:, None].astype(np.float32)
        for f in self.features:
            total += weights[f]
        return total


def chain(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Each word's label distribution, and with ``pairs`` the expected transitions, for chains of ``counts`` words.

    Chains are cut into blocks of ``STEP`` words. A block's product of step matrices carries forward and backward sums over it,
    so all blocks are worked through side by side however long a chain is.
    """
    n, labels = scores.shape
    psi = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) + 1e-30
    move = np.exp(moves)
    blocks = -(-counts // STEP)
    total, of = int(blocks.sum()), np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * STEP
    held = np.minimum(np.repeat(counts, blocks) - nth * STEP, STEP)
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(STEP):
        on = np.flatnonzero(held > t)
        if not len(on):
            break
        part = product[on]
        if t == 0:
            rest = nth[on] > 0
            part[rest] = part[rest] @ move
        else:
            part = part @ move
        part *= psi[begin[on] + t][:, None, :]
        product[on] = part / part.max((1, 2), keepdims=True)
    into, out = np.ones((total, labels)), np.ones((total, labels))
    last = np.r_[of[1:] != of[:-1], True] if total else np.zeros(0, bool)
    by_nth = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by_nth], np.arange(1, int(nth.max(initial=0)) + 2))
    groups = np.split(by_nth, cuts)
    for g in groups:
        g = g[~last[g]]
        if len(g):
            v = (into[g][:, None, :] @ product[g])[:, 0]
            into[g + 1] = v / v.max(1, keepdims=True)
    for g in reversed(groups):
        g = g[nth[g] > 0]
        if len(g):
            v = (product[g] @ out[g][:, :, None])[:, :, 0]
            out[g - 1] = v / v.max(1, keepdims=True)
    ahead, back = np.empty((n, labels)), np.empty((n, labels))
    a, b = into.copy(), out.copy()
    for t in range(STEP):
        on = np.flatnonzero(held > t)
        if not len(on):
            break
        v = a[on]
        v = np.where((nth[on] > 0)[:, None], v @ move, v) if t == 0 else v @ move
        v *= psi[begin[on] + t]
        a[on] = ahead[begin[on] + t] = v / v.max(1, keepdims=True)
    for t in range(STEP - 1, -1, -1):
        on = np.flatnonzero(held > t)
        if not len(on):
            continue
        back[begin[on] + t] = b[on]
        v = (psi[begin[on] + t] * b[on]) @ move.T
        b[on] = v / v.max(1, keepdims=True)
    post = ahead * back
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post
    start = np.zeros(n, bool)
    start[(np.cumsum(counts) - counts)[counts > 0]] = True
    now = np.flatnonzero(~start)
    joint = ahead[now - 1][:, :, None] * move * (psi[now] * back[now])[:, None, :]
    return post, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def train(texts: list[str], labels: list[int], n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions), by passes of scaled gradient steps over small groups of documents; words take their document's label.

    In every second group, two neighbouring documents make one chain, so that transitions between labels are learned from too.
    """
    weights, moves = np.zeros((BUCKETS, n_labels), np.float32), np.zeros((n_labels, n_labels))
    seen, seen_moves = np.full((BUCKETS, n_labels), 1e-6, np.float32), np.full((n_labels, n_labels), 1e-6)
    order = np.random.default_rng(11).permutation(len(texts))
    groups = [order[i : i + 40] for i in range(0, len(order), 40)]
    ready = [(Words(pa.array([texts[i] for i in g], pa.string())), np.array([labels[i] for i in g])) for g in groups]
    for _ in range(PASSES):
        for nth, (words, gold) in enumerate(ready):
            if not len(words.starts):
                continue
            truth, counts = gold[words.row], words.counts
            if nth % 2:
                counts = np.add.reduceat(counts, np.arange(0, len(counts), 2))
            post, expected = chain(words.scores(weights), counts, moves, pairs=True)
            delta = -post
            delta[np.arange(len(truth)), truth] += 1
            # (bucket, word) pairs in order of bucket: a bucket's gradient is the sum over its stretch
            bucket = np.concatenate([*words.features, words.trigrams])
            of = np.concatenate([np.tile(np.arange(len(truth)), len(words.features)), np.repeat(np.arange(len(truth)), words.size)])
            part = np.ones(len(bucket))
            part[len(truth) * len(words.features) :] = np.repeat(1 / words.size, words.size)
            by = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(bucket[by]) > 0])
            gradient = np.add.reduceat(delta[of[by]] * part[by, None], first) / len(gold)
            at = bucket[by][first]
            seen[at] += gradient**2
            weights[at] += (0.3 * gradient / np.sqrt(seen[at])).astype(np.float32)
            inner = np.ones(len(truth), bool)
            inner[(np.cumsum(counts) - counts)[counts > 0]] = False
            inner = np.flatnonzero(inner)
            made = np.bincount(truth[inner - 1] * n_labels + truth[inner], minlength=n_labels**2).reshape(n_labels, n_labels)
            step = (made - expected) / len(gold)
            seen_moves += step**2
            moves = np.clip(moves + 0.1 * step / np.sqrt(seen_moves), -3, 3)
    return weights, moves


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Train on a bounded sample of the rows where ``learn`` holds, lang and doc_id are given and the text has a letter.

    The sample: texts are cut into windows of ``SAMPLE_CHARS`` characters, and of every label ``SAMPLE`` windows are drawn in hash order,
    so each part of a text has the same chance, however long the text is. Windows are chosen by their keys first; only the chosen
    ones come to the driver. Of rows that share doc_id and lang, the one with the shortest, then the first text counts.
    """
    fine = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("langid"), "doc_id", "part"), "doc_id", "part"))
    keys = fine.groupBy("doc_id", "lang").agg(F.min(F.length("text")).alias("n"))
    keys = keys.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {SAMPLE_CHARS} as int)"))).alias("part"))
    chosen = materialize(keys.withColumn("at", rank).where(F.col("at") <= SAMPLE).select("doc_id", "lang", "part"), "langid-sample")
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0))
    window = F.substring("text", F.col("part") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("text")
    rows = fine.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # SAMPLE rows a label
    rows = rows.select("doc_id", "lang", "part", F.length("text").alias("n"), window)
    rows = rows.groupBy("doc_id", "lang", "part").agg(F.min(F.struct("n", "text")).alias("x"))
    rows = sorted(rows.select("doc_id", "lang", "part", "x.text").collect(), key=lambda r: (r["doc_id"], r["lang"], r["part"]))
    return names, *train([r["text"] for r in rows], [names.index(r["lang"]) for r in rows], len(names))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, word_langs) for each row of ``docs`` (doc_id, text; further columns are not read).

    ``word_langs`` counts the words by their most likely label. The document takes the label of largest mean probability, which is
    its score; ties go to the first label in order. ``und`` with score 0 if the text is null, empty or without a letter, or if
    nothing could be learned. Repeated rows are predicted alike. The model is ``BUCKETS`` weights a label, so it is broadcast. A text
    stands whole in a task, with some 80 bytes of working memory a byte.
    """
    names = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = shared.value
        for batch in pieces(batches, "text", (1 << 19) // max(1, (len(names) // 8) ** 2)):
            n = batch.num_rows
            mean, votes = np.zeros((n, max(1, len(names)))), np.zeros((n, max(1, len(names))), np.int64)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if names and lettered.any():
                words = Words(batch.column("text"))
                if len(words.starts):
                    post = chain(words.scores(weights), words.counts, moves)
                    top = post.argmax(1)
                    for k in range(len(names)):
                        mean[:, k] = np.bincount(words.row, post[:, k], n)
                        votes[:, k] = np.bincount(words.row, top == k, n)
                    mean /= np.maximum(words.counts, 1)[:, None]
            best = mean.argmax(1)
            score = np.clip(mean[np.arange(n), best], 0, 1)
            known = lettered & (score > 0)
            said = pa.array([names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            counted = pa.array(
                [[(names[k], int(v[k])) for k in range(len(names)) if v[k]] if ok else [] for v, ok in zip(votes, known.tolist(), strict=True)],
                pa.map_(pa.string(), pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), said, pa.array(np.where(known, score, 0.0)), counted], ["doc_id", "lang_pred", "score", "word_langs"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, word_langs map<string,long>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
