"""Top-k full-text search that leaves most pairs of query and document unscored, with the result of scoring all.

Postings are kept by impact: a word's postings fall into blocks by their share of the word's idf. Each word of a query has a cut level:
blocks below it aren't read, and none of their postings exceeds it. A document found in no block that was read scores no more than the
sum of all levels; one that was found scores at most that sum plus what its postings exceed their levels by. The best documents found give
a threshold, their k-th best whole score. Only documents whose bound reaches it are scored. Queries whose levels sum to more than the
threshold are read again, with levels that stay below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import raw_term_weight, tokens
from ..sources.scratch import materialize, spread_out
from .search import query_postings, top

#: Blocks of a word's postings; the share of a query's postings that is read first; the share of the threshold that levels may take then.
BLOCKS, FIRST, MARGIN = 32, 0.3, 0.6
#: Words of all queries, in rows, that may be sent to every task; more are shuffled with the postings.
SENT = 200_000
#: Scores nearer than this may be equal once they are rounded.
ROUNDING = 2e-6


def impact_blocks(share: Column) -> Column:
    """The block of a posting whose share, between 0 and 1, is ``share``: 0 is the weakest."""
    return F.least(F.floor(share * BLOCKS), F.lit(BLOCKS - 1)).cast("int")


def cut_steps(terms: DataFrame, held: DataFrame, query: str) -> DataFrame:
    """(query, term, block, idf, top, postings, cost, rate): for each word of a query, the blocks that can be given up, weakest first.

    ``cost`` is by how much giving up the block raises the word's level. ``rate`` is the order in which a query gives up blocks: the
    level that is reached for each posting spared, at this block or the best one after it.
    """
    blocks = held.groupBy("term", "block").agg(F.count(F.lit(1)).alias("postings"), F.max("share").alias("top"))
    of = Window.partitionBy("term").orderBy("block")
    blocks = blocks.withColumn("_spared", F.sum("postings").over(of.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rise", F.col("top") - F.coalesce(F.lag("top").over(of), F.lit(0.0)))
    blocks = blocks.withColumn("_rate", F.min(F.col("top") / F.col("_spared")).over(of.rowsBetween(0, Window.unboundedFollowing)))
    steps = terms.select(query, "term", "idf").join(blocks, "term")
    return steps.select(query, "term", "block", "idf", "top", "postings", (F.col("idf") * F.col("_rise")).alias("cost"), (F.col("idf") * F.col("_rate")).alias("rate"))


def given_up(steps: DataFrame, query: str, floors: DataFrame | None) -> DataFrame:
    """``steps`` with ``given``: whether the block is given up. Without ``floors``, while ``FIRST`` of the query's postings remain; with
    them (query, floor), while its levels stay within ``MARGIN`` of the floor; none if that is null."""
    up_to = Window.partitionBy(query).orderBy("rate", "term", "block").rowsBetween(Window.unboundedPreceding, 0)
    if floors is None:
        all_postings = F.sum("postings").over(Window.partitionBy(query))
        return steps.withColumn("given", F.sum("postings").over(up_to) <= all_postings * (1 - FIRST))
    spent = F.sum("cost").over(up_to)
    return steps.join(floors, query).withColumn("given", F.coalesce(spent <= F.col("floor") * MARGIN, F.lit(False)))


def read_blocks(steps: DataFrame, held: DataFrame, query: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(query, base), the sum of a query's levels, and (query, key, over, part): by how much the postings read exceed their levels, and their sum."""
    given = lambda c: F.coalesce(F.max(F.when(F.col("given"), c)), F.lit(0.0))
    # the blocks given up are a word's weakest
    read = steps.groupBy(query, "term").agg(F.first("idf").alias("idf"), given(F.col("block") + 1).alias("_from"), given(F.col("idf") * F.col("top")).alias("level"))
    base = read.groupBy(query).agg(F.sum("level").alias("base"))
    if read.count() <= SENT:  # postings stay with their chunk and are summed up there
        read = F.broadcast(read)
    found = held.select(key, "term", "block", "share").join(read, "term").where(F.col("block") >= F.col("_from"))
    found = found.withColumn("impact", F.col("idf") * F.col("share"))
    sums = F.sum(F.col("impact") - F.col("level")), F.sum("impact")
    return base, found.groupBy(query, key).agg(sums[0].alias("over"), sums[1].alias("part"))


def survivors(terms: DataFrame, held: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key): the pairs that can be among a query's ``k`` best by BM25; see the head of the module."""
    held = held.withColumn("block", impact_blocks(F.col("share")))
    steps = materialize(given_up(cut_steps(terms, held, query), query, None), "search-steps")
    base, found = read_blocks(steps, held, query, key)
    found = materialize(found, "search-found")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("part"), key))
    seeds = found.withColumn("nth", nth).where(F.col("nth") <= k).select(query, key)
    scored = score_pairs(seeds, terms, held, query, key).groupBy(query, key).agg(F.sum(F.col("idf") * F.col("share")).alias("score"))
    floors = scored.groupBy(query).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    state = materialize(base.join(floors, query, "left"), "search-floors")
    sure = F.col("base") < F.col("floor") - ROUNDING
    again = state.where(~F.coalesce(sure, F.lit(False))).select(query, "floor")
    lower, more = read_blocks(given_up(steps.drop("given"), query, again), held, query, key)
    reach = F.col("base") + F.col("over") >= F.col("floor") - ROUNDING
    first = found.join(state.where(sure), query).where(reach).select(query, key)
    second = more.join(lower, query).join(again, query).where(F.col("floor").isNull() | reach).select(query, key)
    return first.unionByName(second)


def score_pairs(pairs: DataFrame, terms: DataFrame, held: DataFrame, query: str, key: str) -> DataFrame:
    """The words of each pair's query that its chunk has, with the columns of ``terms`` and ``held``.

    Few words are sent to the tasks: then pairs meet the postings of their chunk and only hits go on. Many words are paired off first.
    """
    if terms.count() <= SENT:
        return held.join(pairs, key).join(F.broadcast(terms), [query, "term"])
    return pairs.join(terms, query).join(held, [key, "term"])


def top_hits(queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The rows of ``search.query_hits`` for all pairs that can be among a query's ``k`` best by BM25 to 6 digits, and some more; with each
    word's ``raw`` weight and the ``total`` of its query's words.

    Queries or chunks without words have no rows; ties at the k-th place are all there. Words that very many chunks hold cost only their
    strong postings. Queries that repeat an id are one query of all their words.
    """
    terms, held = query_postings(queries, query, query_text, chunks, key, text)
    terms = terms.withColumn("raw", raw_term_weight(F.col("term"))).withColumn("total", F.sum("raw").over(Window.partitionBy(query)))
    terms = materialize(terms, "search-terms")
    pairs = materialize(survivors(terms, held, query, key, k), "search-pairs")
    return score_pairs(pairs, terms, held, query, key)


def all_pairs(queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(query, key, score, got, total): BM25 of every pair that shares a word, and the raw weight of the words it shares and of its query's.

    Where words are few they are sent to the postings, so that a chunk's hits are summed up before they are shuffled.
    """
    terms, held = query_postings(queries, query, query_text, chunks, key, text)
    terms = materialize(terms.select(query, "term", "idf", raw_term_weight(F.col("term")).alias("raw")), "search-terms")
    totals = terms.groupBy(query).agg(F.sum("raw").alias("total"))
    read = F.broadcast(terms) if terms.count() <= SENT else terms
    found = held.where(F.col(key).isNotNull()).select(key, "term", "share").join(read, "term")
    found = found.groupBy(query, key).agg(F.sum(F.col("idf") * F.col("share")).alias("score"), F.sum("raw").alias("got"))
    return found.join(materialize(totals, "search-totals"), query)


#: Dimensions of a text's vector.
DIMENSIONS = 64


def hashed_vectors(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, v): each text as a sparse vector of signed word counts, by the first 32 bits of the words' MD5: the dimension, then the sign."""
    words = spread_out(chunks).select(key, F.explode(tokens(F.col(text))).alias("w"))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.floor(h / DIMENSIONS) % 2 == 0, 1).otherwise(-1)
    return words.groupBy(key, (h % DIMENSIONS).alias("dim")).agg(F.sum(sign).alias("v"))


def sparse_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``pairs`` with the cosine of the sparse vectors of their sides in ``name``; 0 where one has no length."""
    length = lambda v, c: v.groupBy(c).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(f"_{c}"))
    dots = pairs.select(a, b).join(left.select(a, "dim", F.col("v").alias("_u")), a).join(right, [b, "dim"])
    dots = dots.groupBy(a, b).agg(F.sum(F.col("_u") * F.col("v")).alias("_dot"))
    near = pairs.join(dots, [a, b], "left").join(length(left, a), a, "left").join(length(right, b), b, "left")
    lengths = F.col(f"_{a}") * F.col(f"_{b}")
    return near.withColumn(name, F.when((lengths > 0) & F.col("_dot").isNotNull(), F.col("_dot") / lengths).otherwise(0.0)).drop("_dot", f"_{a}", f"_{b}")


def dense_vectors(sparse: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, name_length): ``hashed_vectors`` with a row for each text that has words, all dimensions in an array."""
    at = lambda d: F.coalesce(F.sum(F.when(F.col("dim") == d, F.col("v"))), F.lit(0))
    return sparse.groupBy(key).agg(F.array(*(at(d) for d in range(DIMENSIONS))).alias(name), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(f"{name}_length"))


def dense_cosine(a: str, b: str) -> Column:
    """The cosine of two columns of ``dense_vectors``; 0 where one is missing or has no length."""
    dot = F.expr(" + ".join(f"{a}[{d}] * {b}[{d}]" for d in range(DIMENSIONS)))
    lengths = F.col(f"{a}_length") * F.col(f"{b}_length")
    return F.when(lengths > 0, dot / lengths).otherwise(0.0)


def mixed_survivors(scored: DataFrame, left: DataFrame, right: DataFrame, query: str, key: str, terms: str, k: int, weight: float = 0.3, first: int = 70) -> DataFrame:
    """The rows of ``scored`` that can be among a query's ``k`` best by ``search.mix_similarity``, and some more, with vector_similarity to 6 digits.

    ``left`` and ``right`` are the ``dense_vectors`` a and b of queries and chunks. No cosine exceeds 1. So the ``first`` best by ``terms``
    give a threshold, their k-th best similarity, and only rows that reach it with a cosine of 1 are measured. All rows of a query are
    measured if its first ones are fewer than ``k`` or have no cosine but 0, since then its similarity may be that of the terms alone.
    """

    def measured(rows: DataFrame) -> DataFrame:
        near = rows.join(right, key, "left").join(F.broadcast(left) if few else left, query, "left")
        return near.withColumn("vector_similarity", F.round(dense_cosine("a", "b"), 6)).select(*scored.columns, "vector_similarity")

    few = left.count() <= SENT // DIMENSIONS
    mixed = F.round(F.col("vector_similarity") * weight + F.col(terms) * (1 - weight), 7)
    best = measured(top(scored, query, first, terms, key).drop("rank")).withColumn("_mixed", mixed)
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_mixed"), key))
    floors = best.withColumn("_nth", nth).groupBy(query).agg(
        F.min(F.when(F.col("_nth") == k, F.col("_mixed"))).alias("_floor"), F.max(F.abs("vector_similarity")).alias("_near"), F.min(terms).alias("_least")
    )
    # the first rows are measured again with the others
    least = F.least(F.col("_least"), (F.col("_floor") - ROUNDING - weight) / (1 - weight))
    floors = materialize(floors.select(query, F.when((F.col("_near") > 0) & F.col("_floor").isNotNull(), least).alias("_least")), "search-floors")
    return measured(scored.join(floors, query).where(F.col("_least").isNull() | (F.col(terms) >= F.col("_least"))).select(*scored.columns))
