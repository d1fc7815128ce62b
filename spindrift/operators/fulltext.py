"""Full-text search over several fields: weighted words with synonyms, neighbouring words as phrases, best field.

Chunks are dealt by their key once, as they are. After that a chunk's words, its phrases and its scores for all questions are counted
where it stands: the tables of words and phrases that are asked for go to the chunks. Each clause is scored by BM25 in its field; the
best field counts, by its boost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import raw_term_weight, tokens
from ..sources.scratch import materialize, spread_out
from .pruned import SENT
from .search import bm25_idf, bm25_share

#: How much a synonym counts beside its word, and a phrase beside the heavier of its words.
SYNONYM, PHRASE = 0.25, 2.0


def field_words(chunks: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, w, dl): the words of each field and how many; a null or empty field has no row."""
    arrays = [F.struct(F.lit(name).alias("field"), tokens(text).alias("w")) for name, text in fields.items()]
    split = chunks.select(key, F.explode(F.array(*arrays)).alias("f")).select(key, "f.field", "f.w")
    return split.where("size(w) > 0").withColumn("dl", F.size("w"))


def field_idf(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(field, term, idf, avgdl) of the ``asked`` (term) that ``field_words`` have; each row counts as a chunk."""
    none = asked.select("term").distinct().unionByName(asked.sparkSession.sql("SELECT '' AS term"))  # stands for all words
    terms = words.select("field", "dl", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term")).join(_sent(none), "term", "left_semi")
    counts = materialize(terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("avgdl")), "search-df")
    sizes = F.broadcast(counts.where("term = ''").select("field", F.col("df").alias("n"), "avgdl"))  # a row for each field
    return counts.where("term <> ''").drop("avgdl").join(sizes, "field").select("field", "term", bm25_idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")


def _sent(table: DataFrame) -> DataFrame:
    """``table``, marked to be sent to every task if it is short."""
    return F.broadcast(table) if table.count() <= SENT else table


def word_clauses(queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, word, weight): each question's different words; their raw weights times their counts, which sum to 1 over a question."""
    words = queries.select(query, F.explode(tokens(F.col(query_text))).alias("word")).groupBy(query, "word").agg(F.count(F.lit(1)).alias("_n"))
    words = words.withColumn("_raw", raw_term_weight(F.col("word")) * F.col("_n"))
    return words.select(query, "word", (F.col("_raw") / F.sum("_raw").over(Window.partitionBy(query))).alias("weight"))


def phrase_clauses(queries: DataFrame, query: str, query_text: str, clauses: DataFrame) -> DataFrame:
    """(query, a, b, weight): each question's different pairs of neighbouring words, at ``PHRASE`` times the heavier word's weight."""
    w = tokens(F.col(query_text))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = queries.where(F.size(w) > 1).select(query, F.explode(F.array_distinct(pairs)).alias("p")).select(query, "p.a", "p.b")
    for side in ("a", "b"):
        pairs = pairs.join(clauses.select(query, F.col("word").alias(side), F.col("weight").alias(f"_{side}")), [query, side])
    return pairs.select(query, "a", "b", (F.greatest("_a", "_b") * PHRASE).alias("weight"))


def phrase_frequency(first: Column, second: Column, slop: int) -> Column:
    """How often two words stand together: for each position of the first, 1 / (1 + moves) of the nearest second within ``slop`` moves.

    A move shifts the second word by a place towards the one after the first; a word is no neighbour of itself.
    """

    def share(p: Column) -> Column:
        moves = F.array_min(F.transform(F.filter(second, lambda q: (q != p) & (F.abs(q - p - 1) <= slop)), lambda q: F.abs(q - p - 1)))
        return F.coalesce(F.lit(1.0) / (moves + 1), F.lit(0.0))

    return F.aggregate(F.transform(first, share), F.lit(0.0), lambda s, x: s + x)


def neighbours(words: DataFrame, key: str, asked: DataFrame, slop: int | None) -> DataFrame:
    """(key, field, dl, a, b, share): a row for each place of a word a that is ``asked`` (a), with b empty, and one for each different word b
    within ``slop`` moves of it, none if that is None; ``share`` is 1 / (1 + moves), as in ``phrase_frequency``."""
    moves = [] if slop is None else sorted((o for o in range(-slop, slop + 1) if o != -1), key=abs)
    size = F.size("w")
    at = lambda o: F.slice("w", 2 + o, size) if o >= 0 else F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), -1 - o), "w"), 1, size)
    near = words.select(key, "field", "dl", F.col("w").alias("a"), *(at(o).alias(f"_{i}") for i, o in enumerate(moves)))
    near = near.select(key, "field", "dl", F.inline(F.arrays_zip("a", *(f"_{i}" for i in range(len(moves))))))
    near = near.join(_sent(asked.select("a").distinct()), "a", "left_semi")
    beside = [F.struct(F.lit("").alias("b"), F.lit(1.0).alias("share"))]
    for i, o in enumerate(moves):  # the nearest of equal words counts
        new = F.lit(True)
        for j in range(i):
            new = new & ~F.col(f"_{i}").eqNullSafe(F.col(f"_{j}"))
        beside.append(F.struct(F.when(new, F.col(f"_{i}")).alias("b"), F.lit(1 / (1 + abs(o))).alias("share")))
    return near.select(key, "field", "dl", "a", F.inline(F.array(*beside))).where("b is not null")


def best_fields(
    queries: DataFrame, query: str, query_text: str, chunks: DataFrame, key: str, fields: dict[str, tuple[Column, float]],
    synonyms: DataFrame | None = None, slop: int = 0, least_share: float = 0.0, phrases: bool = True,
) -> DataFrame:
    """(query, key, field, matched, score): each pair's best field (the first by name among equals) and its score times its boost.

    ``fields`` gives each field's text and boost. A field's score sums the BM25 of all clauses in it. ``matched`` counts the question's
    words that the chunk has in any field, by themselves or a synonym; fewer than ``floor(least_share * words)`` are no match. Questions
    without words match nothing. Keys of chunks are unique.

    Where the clauses are few, only the chunks are shuffled: a chunk's clauses, found once for all questions, meet the questions' weights
    in its task. Words count their synonyms before that.
    """
    texts = {name: text for name, (text, _) in fields.items()}
    words = materialize(word_clauses(queries, query, query_text), "search-words")
    asks = words.select(query, F.col("word").alias("first"), F.lit("").alias("second"), "weight")
    if phrases:
        pairs = phrase_clauses(queries, query, query_text, words)
        asks = asks.unionByName(pairs.select(query, F.col("a").alias("first"), F.col("b").alias("second"), "weight"))
    asks = materialize(asks.join(words.groupBy(query).agg(F.count(F.lit(1)).alias("words")), query), "search-clauses")
    # what each clause is found by, (a, b): a word by itself and its synonyms, a phrase by its words
    clauses = materialize(asks.select("first", "second").distinct().withColumn("clause", F.monotonically_increasing_id()), "search-ids")
    by = clauses.select("clause", F.col("first").alias("a"), F.col("second").alias("b"), F.lit(1.0).alias("part"))
    if synonyms is not None:
        more = synonyms.select(F.col("term").alias("first"), F.col("synonym").alias("a")).distinct().join(clauses.where("second = ''"), "first")
        by = by.unionByName(more.select("clause", "a", F.lit("").alias("b"), F.lit(SYNONYM).alias("part")))
    by = materialize(by, "search-parts")
    idf = field_idf(field_words(spread_out(chunks), key, texts), by.select(F.col("a").alias("term")).unionByName(by.select(F.col("b").alias("term"))))
    of = lambda side: idf.select("field", F.col("term").alias(side), F.col("idf").alias(f"_{side}"), "avgdl")
    rates = by.join(of("a"), "a").join(of("b").drop("avgdl"), ["field", "b"], "left").where("b = '' or _b is not null")
    rates = materialize(rates.select("field", "a", "b", "clause", "avgdl", (F.col("part") * (F.col("_a") + F.coalesce("_b", F.lit(0.0)))).alias("rate")), "search-rates")
    marks = materialize(rates.select("field", "a", "b").distinct().withColumn("mark", F.monotonically_increasing_id()), "search-marks")
    rates = rates.join(marks, ["field", "a", "b"]).select("mark", "field", "clause", "avgdl", "rate")

    dealt = field_words(chunks.where(F.col(key).isNotNull()).repartition(key), key, texts)
    found = neighbours(dealt, key, marks, slop if phrases else None).join(_sent(marks), ["field", "a", "b"])
    found = found.groupBy(key, "mark").agg(F.sum("share").alias("tf"), F.max("dl").alias("dl")).join(_sent(rates), "mark")
    s = F.col("rate") * bm25_share(F.col("tf"), F.col("dl"), F.col("avgdl"))
    found = found.groupBy(key, "clause").agg(*(F.sum(F.when(F.col("field") == name, s)).alias(f"_{name}") for name in fields))
    hits = found.join(_sent(asks.join(clauses, ["first", "second"]).select(query, "clause", "weight", "words", (F.col("second") == "").alias("word"))), "clause")
    matched = F.sum(F.col("word").cast("int"))
    sums = [F.sum(F.col("weight") * F.col(f"_{name}")).alias(f"_{name}") for name in fields]
    hits = hits.groupBy(query, key).agg(matched.alias("matched"), F.first("words").alias("words"), *sums)
    hits = hits.where(F.col("matched") >= F.floor(F.col("words") * least_share))
    score = lambda name, boost: F.round(F.col(f"_{name}") * float(boost), 6)
    best = F.array_min(F.array(*(F.when(F.col(f"_{name}").isNotNull(), F.struct((-score(name, b)).alias("s"), F.lit(name).alias("field"))) for name, (_, b) in fields.items())))
    return hits.withColumn("best", best).select(query, key, "best.field", "matched", (-F.col("best.s")).alias("score"))
