"""Stemming, segmentation and dictionary lookups over documents and the items of benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import segment as sg
from ..sources.scratch import materialize, spread_out
from .base import TOKEN, query


@query()
def w1_stems(t):
    """How often each stem occurs in all documents, and from how many different words."""
    words = spread_out(t("documents").select("text")).select(F.explode(tx.tokens(sg.normalise(F.col("text")))).alias("term"))
    words = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", sg.stem("term"))
    return words.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


@query()
def w1_w2_segmented(t):
    """The words of each item, written together, cut anew by a dictionary of all documents, in one and in finer words, and how many were found again."""
    dictionary = materialize(sg.learn_dictionary(spread_out(t("documents").select("text")), "text"), "dictionary")
    parts = t("benchmark").select("item_id", F.posexplode(F.split("text", r"[.?!,;:]\s*")).alias("part", "said"))
    runs = parts.select("item_id", "part", tx.tokens(F.col("said")).alias("words")).withColumn("run", F.array_join("words", ""))
    cut = sg.segment(runs, dictionary)
    found = F.size(F.array_intersect("words", "tokens")) / F.size(F.array_distinct("words"))
    return runs.join(cut, "run").select("item_id", "part", "run", F.array_join("tokens", " ").alias("tokens"), F.array_join("fine", " ").alias("fine"), F.round(found, 6).alias("found"))


@query(rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM w GROUP BY term), s AS (SELECT sum(n) AS total FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark)
SELECT item_id, term, CAST(coalesce(floor(n / total * 1000000 + 0.5), 0) AS BIGINT) AS freq FROM q LEFT JOIN (SELECT term, n, total FROM c, s WHERE n >= 2 AND length(term) <= 16) USING (term)""")
def w3_frequencies(t):
    """Each word of an item with its frequency in all documents, in millionths."""
    dictionary = sg.learn_dictionary(spread_out(t("documents").select("text")), "text")
    terms = t("benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return sg.term_frequency(terms, dictionary).select("item_id", "term", "freq")
