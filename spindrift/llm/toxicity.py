"""Toxicity by a noisy channel: obfuscated words are restored under a character language model, then the restored text is scored.

A token in disguise (digits or signs for letters, letters repeated or set apart by signs or spaces) opens a lattice: each sign
may stand for one of its letters or for nothing, each run of a letter for one or two of it, each gap between single characters
for nothing or for the end of a word. Viterbi takes the likeliest path under a character trigram model that is counted over all
texts. Plain tokens have one path and are taken as they are. The score is a naive Bayes sum over the words and word beginnings that
labelled documents show to be significant.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .flatbytes import LOWER, SPACE, Hasher, flat, mix, pieces, runs

#: Labelled documents that the classifier learns from; a feature's log odds must lie above LEAST_ODDS by LEAST_Z
#: deviations, so that words which are merely commoner in long texts stay out.
SAMPLE, LEAST_Z, LEAST_ODDS = 20_000, 2.2, 1.05
#: Remembered restorations of a task.
MEMO = 100_000
#: What a sign can stand for.
SUBSTITUTES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
#: Symbols of the language model: 0 anything that is no letter, 1-26 a-z, 27 a byte of another letter.
SYMBOLS = 28
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
_LETTER = _SYMBOL > 0
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in SUBSTITUTES]] = True
_SIGN = _LEET & ~_ALNUM
#: Bytes of a word's beginning; least log odds of one, as many harmless words may share it.
PREFIXES, PREFIX_ODDS = (4, 5, 6), 4.0
#: Log probability that a sign which may stand for a letter stands for nothing.
DROPPED = -3.0
#: Word pair minima of a labelled document; it counts as one over how many sampled documents have such a minimum too, taking the
#: minimum that is SHARED-most often had, so that a group of near copies, or of texts around one passage, counts about once.
SKETCH, SHARED = 16, 3


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each symbol trigram occurs in all texts; at most SYMBOLS**3 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in pieces(batches, "text"):
            s = _SYMBOL[LOWER[flat(batch.column("text"))[0]]]
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["gram", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) of symbols. Only the table of SYMBOLS**3 sums reaches the driver."""
    counts = np.full(SYMBOLS**3, 0.5)
    for r in count_trigrams(docs).collect():
        counts[r["gram"]] += r["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(counts / counts.sum(2, keepdims=True))


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest plain words behind a lower-case token, by Viterbi over its lattice; '' if nothing is left of it.

    A blank in the token is a gap between single characters, at which a word may end or go on. A letter beyond ASCII is a symbol
    for each of its bytes, as in the model.
    """
    table = model.tolist() if isinstance(model, np.ndarray) else model
    symbol = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 if c >= "\x80" else 0
    symbols = lambda text: [symbol(c) for c in text for _ in range(len(c.encode()))]
    run_of = lambda x, n: [x] if n == 1 else [x, x + x]
    states = {(0, 0): (0.0, None)}
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        n, spaced = 1, False
        while token[j : j + 1] == c or token[j : j + 2] == " " + c:
            spaced = spaced or token[j] == " "
            n, j = n + 1, j + (1 if token[j] == c else 2)
        if c == " ":
            choices = ["", " "]
        elif c.isalpha():
            choices = run_of(c, n)
            if spaced:  # a word may end within the run
                choices = choices + [f"{x} {y}" for x in run_of(c, n - 1) for y in run_of(c, n - 1)]
        else:
            choices = [x for y in SUBSTITUTES.get(c, "") for x in run_of(y, n)]
            if not c.isdigit() or not choices:
                choices.append("")
        drop = DROPPED if len(choices) > 1 and c != " " else 0.0
        following: dict = {}
        for (a, b), (cost, path) in states.items():
            goes_on = c.isalpha() and i > 0 and b == symbol(c)  # a run that began as a sign, as in 0ooo
            for text in (*choices, "") if goes_on else choices:
                x, y, total = a, b, cost if text or goes_on else cost + drop
                for z in symbols(text):
                    total += table[x][y][z]
                    x, y = y, z
                if (x, y) not in following or total > following[x, y][0]:
                    following[x, y] = (total, (path, text))
        states, i = following, j
    _, path = max((cost + table[a][b][0], k, path) for k, ((a, b), (cost, path)) in enumerate(states.items()))[0::2]
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Tokens:
    """The tokens of a text column: plain ones as stretches of ``data``, those in disguise as (row, token).

    Three single characters or more in a row are one token in disguise, with blanks between them. Of restored texts all tokens are plain.
    """

    def __init__(self, column: pa.Array, restored: bool = False):
        self.raw, ends = flat(column)
        self.data = data = LOWER[self.raw]
        starts, stops = runs(~SPACE[data])
        row = np.searchsorted(ends, starts, side="right")
        self.hasher = Hasher(data)
        none = np.empty(0, np.int64)
        self.row, self.starts, self.stops, self.odd = none, none, none, []
        if not len(starts):
            return
        place = np.arange(len(data))
        first = np.minimum.reduceat(np.where(_ALNUM[data], place, len(data)), starts)
        last = np.maximum.reduceat(np.where(_ALNUM[data], place, -1), starts) + 1
        has = last > 0
        starts, stops, row, first, last = starts[has], stops[has], row[has], first[has], last[has]
        if restored or not len(starts):
            self.row, self.starts, self.stops = row, first, last
            return
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        thrice = np.zeros(len(data), bool)
        thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]] & (data[2:] < 128)
        thrice = np.r_[0, np.cumsum(thrice)]
        inner = letters[last] - letters[first]
        repeats = thrice[last] - thrice[np.minimum(first + 2, last)] > 0
        lead = (first > starts) & _SIGN[data[np.maximum(first - 1, 0)]] & ((first - starts) == 1)
        after = data[np.minimum(last, len(data) - 1)]
        trail = (stops - last == 1) & _SIGN[after] & (after != ord("!"))
        odd = (inner > 0) & ((inner < last - first) | repeats | lead | trail)
        raw = data.tobytes()
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        single = (points[last] - points[first] == 1) & ((stops - starts) - (last - first) <= 1)
        for i in np.flatnonzero(single & (data[first] >= 128)):
            single[i] = raw[first[i] : last[i]].decode("utf-8", "ignore").isalnum()  # no dash or the like
        follows = single & np.r_[False, single[:-1] & (row[1:] == row[:-1])]
        edge = np.diff(follows.astype(np.int8), prepend=0, append=0)
        spaced = np.zeros(len(starts), bool)
        for lo, hi in zip(np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1), strict=True):
            word = " ".join(raw[first[i] : last[i]].decode("utf-8", "ignore") for i in range(lo, hi))
            if hi - lo >= 3 and any(c.isalpha() for c in word):
                self.odd.append((int(row[lo]), word))
                spaced[lo:hi] = True
        for i in np.flatnonzero(odd & ~spaced):
            lo, hi = int(first[i]) - int(lead[i]), int(last[i]) + int(trail[i])
            self.odd.append((int(row[i]), raw[lo:hi].decode("utf-8", "ignore")))
        plain = ~odd & ~spaced
        self.row, self.starts, self.stops = row[plain], first[plain], last[plain]

    def features(self):
        """(row, feature) arrays, one pair for the words (even) and one for each length of word beginnings (odd)."""
        yield self.row, self.hasher(self.starts, self.stops) & ~np.uint64(1)
        for n in PREFIXES:
            longer = self.stops - self.starts > n
            s = self.starts[longer]
            yield self.row[longer], mix(self.hasher(s, s + n) + np.uint64(n)) | np.uint64(1)


def all_features(column: pa.Array, table: list, memo: dict[str, str]):
    """(row, feature) arrays of the whole restored texts. ``memo`` holds restorations under this table, by the caller's task."""
    tokens = Tokens(column)
    yield from tokens.features()
    if tokens.odd:
        if len(memo) > MEMO:
            memo.clear()
        for _, word in tokens.odd:
            if word not in memo:
                memo[word] = restore(word, table)
        rows = np.array([r for r, _ in tokens.odd])
        again = Tokens(pa.array([memo[w] for _, w in tokens.odd], pa.string()), restored=True)
        for row, feature in again.features():
            yield rows[row], feature


def restored_words(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, token, restored): the tokens of each text that are in disguise and what they stand for, in text order by kind."""
    table = model.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            odd = Tokens(batch.column("text")).odd
            ids = batch.column("doc_id").take(pa.array([r for r, _ in odd], pa.int64()))
            columns = [ids, pa.array([w for _, w in odd], pa.string()), pa.array([restore(w, table) for _, w in odd], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "token", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, token string, restored string")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hash_id(x) -> int:
    return int(x) % (1 << 64) if isinstance(x, int) else abs(hash(x))


def fit(docs: DataFrame, labels: DataFrame, language: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, features, weights) from ``labels`` (doc_id, toxic), of which at most ``SAMPLE`` are taken, in hash order.

    A kept feature's weight is one deviation less than its log odds. Of rows that share a labelled doc_id, the one with the first text
    is learned from. The counts stay distributed; all significant features of the sample come to the driver.
    """
    few = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = few.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE)
    table = language.tolist()

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, words = next(iter(Tokens(batch.column("text")).features()))
            pair = row[1:] == row[:-1]
            words, row = mix(words[:-1] * np.uint64(3) + words[1:])[pair], row[1:][pair]
            marks = np.zeros((batch.num_rows, SKETCH), np.uint64)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            for k in range(SKETCH if len(row) else 0):
                marks[row[first], k] = np.minimum.reduceat(mix(words + np.uint64(k)), first)
            # texts of fewer than two words are no copies of each other
            alone = (marks == 0).all(1)
            marks[alone] = mix(np.array([hash_id(x) for x in batch.column("doc_id").to_pylist()], np.uint64))[alone, None]
            items = pa.FixedSizeListArray.from_arrays(pa.array(marks.view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items], ["doc_id", "marks"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in pieces(batches, "text"):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            share = batch.column("share").to_numpy(zero_copy_only=False)
            rows, features = zip(*all_features(batch.column("text"), table, memo), strict=True)
            rows, features = np.concatenate(rows), np.concatenate(features)
            order = np.lexsort((features, rows))
            rows, features = rows[order], features[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
            rows, features = rows[new], features[new]
            kinds, of = np.unique(features, return_inverse=True)
            a, n = np.bincount(of, share[rows] * toxic[rows], len(kinds)), np.bincount(of, share[rows], len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(a), pa.array(n)], ["feature", "a", "n"])

    sample = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most SAMPLE rows
    sample = materialize(sample, "toxicity-sample")
    id_kind = sample.schema["doc_id"].dataType.simpleString()
    marks = sample.mapInArrow(sketch, f"doc_id {id_kind}, marks array<long>").orderBy("doc_id").collect()  # a row of SKETCH numbers for each sampled label
    if not marks:
        return -20.0, np.empty(0, np.uint64), np.empty(0)
    values, of, often = np.unique(np.array([r["marks"] for r in marks]), return_inverse=True, return_counts=True)
    copies = np.sort(often[of].reshape(len(marks), SKETCH), axis=1)[:, -SHARED]
    shares = {r["doc_id"]: float(1 / c) for r, c in zip(marks, copies, strict=True)}
    shares = docs.sparkSession.createDataFrame(list(shares.items()), f"doc_id {id_kind}, share double")
    sample = sample.join(F.broadcast(shares), "doc_id")
    sums = sample.agg(F.sum(F.when(F.col("toxic") == 1, F.col("share")).otherwise(0.0)).alias("a"), F.sum("share").alias("n")).first()
    na, nb = sums["a"], sums["n"] - sums["a"]
    if na < 1e-9 or nb < 1e-9:
        return (-20.0 if na < 1e-9 else 20.0), np.empty(0, np.uint64), np.empty(0)
    counts = sample.mapInArrow(count, "feature long, a double, n double").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    b = F.greatest(F.col("n") - F.col("a"), F.lit(0.0))
    odds = F.log((F.col("a") + 0.5) / (na + 1)) - F.log((b + 0.5) / (nb + 1))
    deviation = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (b + 0.5))
    kept = counts.select("feature", odds.alias("odds"), deviation.alias("sd")).where(F.col("odds") - LEAST_Z * F.col("sd") > LEAST_ODDS)
    kept = kept.where((F.col("feature") % 2 == 0) | (F.col("odds") > PREFIX_ODDS))
    rows = kept.collect()
    rows.sort(key=lambda r: r["feature"] % (1 << 64))
    features = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    return math.log((na + 1) / (nb + 1)), features, np.array([r["odds"] - r["sd"] for r in rows])


def score_documents(docs: DataFrame, language: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs`` (doc_id, text; further columns are not read).

    Null and empty texts have no features and so the score of the prior. Repeated rows score alike.
    """
    prior, features, weights = model
    table = language.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in pieces(batches, "text"):
            n, hits = batch.num_rows, []
            for row, feature in all_features(batch.column("text"), table, memo) if len(features) else ():
                at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
                same = features[at] == feature
                hits.append(row[same] * len(features) + at[same])
            hits = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
            total = prior + (np.bincount(hits // len(features), weights[hits % len(features)], n) if len(hits) else np.zeros(n))
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    language = language_model(docs)
    scored = score_documents(docs, language, fit(docs, labels, language))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
