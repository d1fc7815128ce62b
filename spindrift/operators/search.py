"""Full-text and dense matching, fusion, reranking and paging, as joins over postings.

Queries are a frame of their own: every operator scores many queries in one job. Postings meet query terms by an equi-join on the
term; ranking is per query, so tops are cut per partition before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_total, tokens
from ..functions.vectors import cosine
from ..sources.scratch import materialize, spread_out


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): how often each chunk has each of its words, and its words in all."""
    words = chunks.select(key, tokens(F.col(text)).alias("w"))
    terms = words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """One row (n, avgdl): chunks, and their mean count of words over those that have any."""
    sized = chunks.select(token_total(F.col(text)).alias("dl"))
    return sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))


def query_postings(
    queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """The words of queries and the postings that hold them, to be joined on term.

    First (query, term, df, n, terms, idf): each word of a query that the corpus has; ``terms`` counts a query's different ones, ``n``
    the corpus's chunks. Then (key, term, tf, dl, avgdl, share). BM25 is the sum of ``idf * share``, so that a hit costs one product.
    Only postings of words that some query has are kept; they are written once, those of a chunk together, and document frequencies
    come from them. The words keep all shuffle partitions: they are few rows, but each meets all its postings.
    """
    chunks = spread_out(chunks.select(key, text))
    stats = corpus_stats(chunks, key, text).first()
    n, avgdl = F.lit(stats["n"]), F.lit(stats["avgdl"]).cast("double")
    asked = queries.select(query, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    words = chunks.select(key, tokens(F.col(text)).alias("w"))
    held = words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    held = held.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    held = materialize(held.repartition(key), "search-postings")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    spread = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = asked.join(df, "term").repartition(spread, query).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy(query)))
    terms = terms.withColumn("n", n).withColumn("idf", bm25_idf(F.col("df"), n))
    return terms, held.withColumn("avgdl", avgdl).withColumn("share", bm25_share(F.col("tf"), F.col("dl"), avgdl, k1, b))


def query_hits(queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Every word of a query in every chunk that has it, with the columns of both tables of ``query_postings``."""
    terms, held = query_postings(queries, query, query_text, chunks, key, text)
    return terms.join(held, "term")


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_share(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_idf(df, n) * bm25_share(tf, dl, avgdl, k1, b)


def presence_score(df: Column, n: Column) -> Column:
    """The store's own similarity for plain word fields: a normalised inverse frequency, whatever the term frequency."""
    return F.log1p((n - df + 0.5) / (df + 0.5)) / F.log1p((n - 0.5) / F.lit(1.5))


def match(found: DataFrame, query: str, chunk: str, score: Column, least_share: float = 0.0) -> DataFrame:
    """(query, chunk, matched, score) from rows (query, chunk, term, terms): sums over terms, with a least share of matched terms."""
    sums = [F.count(F.lit(1)).alias("matched"), F.sum(score).alias("score")]
    if not least_share:
        return found.groupBy(query, chunk).agg(*sums)
    summed = found.groupBy(query, chunk).agg(*sums, F.first("terms").alias("terms"))
    return summed.where(F.col("matched") >= F.floor(F.col("terms") * least_share)).drop("terms")


def hybrid_similarity(scored: DataFrame, query: str, terms: str, a: str, b: str, weight: float = 0.3) -> DataFrame:
    """``scored`` with vector_similarity (cosine of the vectors ``a`` and ``b``, 0 where one is missing) and similarity: ``weight`` of it
    and the rest of ``terms``; a query none of whose rows has a vector similarity goes by its terms alone."""
    near = scored.withColumn("vector_similarity", F.coalesce(cosine(F.col(a), F.col(b)), F.lit(0.0)))
    return mix_similarity(near, query, terms, weight).drop(a, b)


def mix_similarity(near: DataFrame, query: str, terms: str, weight: float = 0.3) -> DataFrame:
    """``near``, which has vector_similarity, with ``weight`` of it and the rest of ``terms`` in similarity, as ``hybrid_similarity``."""
    any_near = near.groupBy(query).agg(F.sum(F.abs("vector_similarity")).alias("_near"))
    mixed = F.col("vector_similarity") * weight + F.col(terms) * (1 - weight)
    return near.join(any_near, query).withColumn("similarity", F.when(F.col("_near") == 0, F.col(terms)).otherwise(mixed)).drop("_near")


def rerank_window(page_size: int, limit: int = 64) -> int:
    """How many first hits are ranked anew: about ``limit``, as whole pages."""
    return max(page_size, -(-limit // page_size) * page_size) if page_size > 1 else limit


def top(scored: DataFrame, query: str, k: int, score: str = "score", tie: str = "doc_id", page: int = 1) -> DataFrame:
    """A page of each query's rows by falling score, with their rank from 1; ties go to the smaller ``tie``."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where((F.col("rank") > (page - 1) * k) & (F.col("rank") <= page * k))


def rescale(scored: DataFrame, query: str, score: str, name: str) -> DataFrame:
    """Scores from 0 to 1 within each query; 0 where they don't differ."""
    ends = materialize(scored.groupBy(query).agg(F.min(score).alias("_low"), F.max(score).alias("_high")), "search-ends")
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return scored.join(ends, query).withColumn(name, scaled).drop("_low", "_high")


def facets(hits: DataFrame, query: str, name: str) -> DataFrame:
    """(query, name, hits): how many of a query's hits each value has; for arrays, each value of a hit once."""
    values = F.explode(F.array_distinct(name)) if dict(hits.dtypes)[name].startswith("array") else F.col(name)
    return hits.select(query, values.alias(name)).groupBy(query, name).agg(F.count(F.lit(1)).alias("hits"))


def pack_budget(ranked: DataFrame, query: str, rank: str, tokens_column: str, budget: int, share: float = 0.97) -> DataFrame:
    """The leading rows of each query whose tokens before them stay below the share of the budget, with the running sum."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumn("used", F.sum(tokens_column).over(w))
    return summed.where(F.col("used") - F.col(tokens_column) <= budget * share)


def gather(tables: list[DataFrame], k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` best rows over several tables; each is asked for its own ``k`` best first."""
    best = [t.orderBy(F.desc(score), tie).limit(k) for t in tables]
    rows = best[0]
    for more in best[1:]:
        rows = rows.unionByName(more)
    return rows.orderBy(F.desc(score), tie).limit(k)


def label_questions(matched: DataFrame, tagged: DataFrame, query: str, chunk: str, tag: str, k: int) -> DataFrame:
    """(query, tag, score, rank): each query's ``k`` most telling tags among the chunks it matched, against all chunks of ``tagged``."""
    every = tagged.groupBy(tag).agg(F.count(F.lit(1)).alias("_all"))
    total = F.broadcast(every.agg(F.sum("_all").alias("_total")))  # one row
    prior = every.join(total, F.lit(True)).select(tag, ((F.col("_all") + 1) / (F.col("_total") + 1000)).alias("_prior"))
    counts = matched.join(tagged, chunk).groupBy(query, tag).agg(F.count(F.lit(1)).alias("_c")).join(prior, tag)
    score = F.lit(10) * (F.col("_c") + 1) / (F.sum("_c").over(Window.partitionBy(query)) + 1000) / F.greatest(F.lit(1e-6), F.col("_prior"))
    scored = counts.withColumn("score", F.bround(score, 0).cast("long")).where("score > 0")
    return top(scored.select(query, tag, "score"), query, k, "score", tag)


#: The first threshold of citations, its decay while nothing is cited, where it ends, and how near the best a citation is.
CITE_FROM, CITE_DECAY, CITE_ABOVE, CITE_NEAR = 0.63, 0.8, 0.3, 0.99


def cite(near: DataFrame, answer: list[str], sentence: str, chunk: str, score: str, each: int = 4) -> DataFrame:
    """The rows (answer, sentence, chunk, score) that are citations.

    A sentence whose best score reaches the threshold cites the chunks close to that best, at most ``each``, by order of chunk; the
    threshold of an answer falls until a sentence reaches it. Within an answer, a chunk is cited by its first sentence only.
    """
    steps, at = [], CITE_FROM
    while at > CITE_ABOVE:
        steps.append(at)
        at *= CITE_DECAY
    near = near.withColumn("_near", F.max(score).over(Window.partitionBy(*answer, sentence)) * CITE_NEAR)
    near = near.withColumn("_best", F.max("_near").over(Window.partitionBy(*answer)))
    floor = F.coalesce(*(F.when(F.col("_best") >= t, F.lit(t)) for t in steps))
    cited = near.where((F.col("_near") >= floor) & (F.col(score) > F.col("_near"))).drop("_near", "_best")
    cited = cited.withColumn("_i", F.row_number().over(Window.partitionBy(*answer, sentence).orderBy(chunk))).where(F.col("_i") <= each)
    first = F.row_number().over(Window.partitionBy(*answer, chunk).orderBy(sentence))
    return cited.withColumn("_i", first).where("_i = 1").drop("_i")
