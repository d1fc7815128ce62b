"""Segmentation of text without spaces by a dictionary that is learned from a corpus.

A run's substrings meet the dictionary by a join on the substring, so the dictionary is never sent whole to a task, whatever its size.
What comes back is each run's lattice of dictionary words. Longest match from the front and from the back are read from it; where
they differ, the best-scored way through that stretch is taken. Runs are segmented once, however often they come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import fold_width, stem
from ..functions.text import tokens

# The score's share for few words, the log frequency of an unknown character, what frequencies are counted in, and the
# longest word that is cut once more into finer ones.
FEW, UNKNOWN, FREQUENCY_OF, FINE = 30, -12.0, 1_000_000, 10
#: Code points of the longest word that is learned.
LONGEST = 16
#: Characters that are written without spaces between words.
HAN = r"[\x{4e00}-\x{9fa5}]"


def normalise(text: Column) -> Column:
    """Marks as spaces, half width, lower case; the empty text for null."""
    return F.lower(fold_width(F.coalesce(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(""))))


def learn_dictionary(chunks: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(term, weight, n): the words of up to ``LONGEST`` code points that come ``least`` times or more, with the log of their share of all words."""
    words = chunks.select(F.explode(tokens(fold_width(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(words.agg(F.sum("n").alias("_total")))  # one row
    kept = words.where((F.col("n") >= least) & (F.length("term") <= LONGEST)).join(total, F.lit(True))
    return kept.select("term", F.log(F.col("n") / F.col("_total")).alias("weight"), "n")


def term_frequency(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``terms`` with ``freq``, in millionths of all words; 0 for words that the dictionary lacks."""
    known = dictionary.select("term", F.floor(F.exp("weight") * FREQUENCY_OF + 0.5).alias("freq"))
    return terms.join(known, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def lattice(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, words): each different run with the dictionary words in it, as (start, end, weight)."""
    runs = runs.select("run").where("run <> ''").distinct()
    ends = F.expr(f"explode(sequence(start + 1, least(start + {LONGEST}, length(run))))")
    parts = runs.select("run", F.expr("explode(sequence(0, length(run) - 1))").alias("start")).select("run", "start", ends.alias("end"))
    parts = parts.withColumn("term", F.expr("substring(run, start + 1, end - start)"))
    found = parts.join(dictionary.select("term", "weight"), "term").groupBy("run").agg(F.collect_list(F.struct("start", "end", "weight")).alias("words"))
    return runs.join(found, "run", "left")


class Ways:
    """The words of a run: ``at[start]`` holds the ends and weights of those that begin there."""

    def __init__(self, run: str, words: Iterable[tuple[int, int, float]]):
        self.run = run
        self.at: list[dict[int, float]] = [{} for _ in run]
        for start, end, weight in words:
            self.at[start][end] = weight

    def forward(self) -> list[int]:
        """Where words begin by longest match from the front; single characters where none fits."""
        cuts, s = [], 0
        while s < len(self.run):
            cuts.append(s)
            s = max(self.at[s], default=s + 1)
        return cuts

    def backward(self) -> list[int]:
        """The same from the back."""
        starts: list[list[int]] = [[] for _ in range(len(self.run) + 1)]
        for s, ends in enumerate(self.at):
            for e in ends:
                starts[e].append(s)
        cuts, e = [], len(self.run)
        while e:
            e = min(starts[e], default=e - 1)
            cuts.append(e)
        return cuts[::-1]

    def steps(self, s: int, end: int) -> dict[int, float]:
        """The words from ``s`` that end by ``end``, and the single character there, known or not."""
        return {s + 1: UNKNOWN} | {e: w for e, w in self.at[s].items() if e <= end}

    def best(self, start: int, end: int) -> list[int]:
        """Where words begin on the best-scored way from ``start`` to ``end``: ``score`` over all ways, by their counts of words and of long words."""
        n = end - start
        reach = np.full((n + 1, n + 1, n + 1), -np.inf)  # at, words, words of two characters or more
        came = np.zeros((n + 1, n + 1, n + 1), np.int64)
        reach[0, 0, 0] = 0
        for s in range(n):
            for e, weight in sorted(self.steps(start + s, end).items()):
                e -= start
                long = int(e - s > 1)
                to, new = reach[e, 1:, long:], reach[s, :-1, : n + 1 - long] + weight
                better = new > to
                came[e, 1:, long:][better] = s
                to[better] = new[better]
        words = np.arange(1, n + 1)[:, None]
        value = FEW / words + np.arange(n + 1)[None] / words + reach[n, 1:]
        count, long = (int(x) for x in np.unravel_index(value.argmax(), value.shape))
        count, at, cuts = count + 1, n, []
        while at:
            before = int(came[at, count, long])
            long, count, at = long - (at - before > 1), count - 1, before
            cuts.append(start + at)
        return cuts[::-1]

    def ways(self, start: int, end: int) -> Iterator[list[int]]:
        """All ways from ``start`` to ``end``."""
        if start == end:
            yield []
        for e in sorted(self.steps(start, end)) if start < end else ():
            for rest in self.ways(e, end):
                yield [start, *rest]

    def score(self, cuts: list[int], end: int) -> float:
        """``FEW`` over the words, plus the share of words of two characters or more, plus the sum of log frequencies."""
        spans = list(zip(cuts, [*cuts[1:], end]))
        return FEW / len(cuts) + sum(e - s > 1 for s, e in spans) / len(cuts) + sum(self.steps(s, e)[e] for s, e in spans)

    def segmented(self) -> list[str]:
        front, back = self.forward(), self.backward()
        shared = sorted(set(front) & set(back)) + [len(self.run)]
        cuts: list[int] = []
        for s, e in zip(shared, shared[1:]):
            one, two = ([c for c in way if s <= c < e] for way in (front, back))
            cuts += one if one == two else self.best(s, e)
        return [self.run[s:e] for s, e in zip(cuts, [*cuts[1:], len(self.run)])]

    def fine(self, start: int, end: int) -> list[str]:
        """The second-best way through a word of 3 to ``FINE`` characters; the word itself if it has one way or falls into characters."""
        whole = [self.run[start:end]]
        if not 3 <= end - start <= FINE:
            return whole
        ways = sorted(self.ways(start, end), key=lambda c: (-self.score(c, end), c))
        if len(ways) < 2 or len(ways[1]) == end - start:
            return whole
        return [self.run[s:e] for s, e in zip(ways[1], [*ways[1][1:], end])]


def segment(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, tokens, fine): each different run cut into words, and those words cut once more.

    Null and empty runs have no row. Every token is a dictionary word or a single character, and tokens join to the run. A stretch on
    which the two longest matches differ takes memory by the cube of its length.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, fine = [], []
            for run, words in zip(batch.column("run").to_pylist(), batch.column("words").to_pylist()):
                ways = Ways(run, ((w["start"], w["end"], w["weight"]) for w in words or ()))
                tokens.append(ways.segmented())
                at, cut = 0, []
                for token in tokens[-1]:
                    cut += ways.fine(at, at + len(token))
                    at += len(token)
                fine.append(cut)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(tokens, kind), pa.array(fine, kind)], ["run", "tokens", "fine"])

    return lattice(runs, dictionary).mapInArrow(work, "run string, tokens array<string>, fine array<string>")


def tokenize(chunks: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, pos, token): the words of each text in order: Han runs segmented, other words stemmed.

    Texts are normalised first; null and empty ones have no rows. Rows that share a key each have theirs, with positions of their own.
    """
    parts = F.regexp_extract_all(normalise(F.col(text)), F.lit(rf"{HAN}+|[\p{{L}}\p{{N}}_&&[^{HAN[1:-1]}]]+"), F.lit(0))
    words = chunks.select(key, F.posexplode(parts).alias("_at", "_word"))
    words = words.withColumn("_han", F.col("_word").rlike(f"^{HAN}"))
    different = words.select("_word", "_han").distinct()
    cut = segment(different.where("_han").select(F.col("_word").alias("run")), dictionary).select(F.col("run").alias("_word"), "tokens")
    stems = different.where("not _han").select("_word", F.array(stem("_word")).alias("tokens"))
    joined = words.select(key, "_at", "_word").join(cut.unionByName(stems), "_word")
    return joined.select(key, "_at", F.posexplode("tokens").alias("_in", "token")).select(key, F.struct("_at", "_in").alias("pos"), "token")

