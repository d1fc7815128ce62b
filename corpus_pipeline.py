"""From documents to token digests: language, toxicity, near-duplicates, mixing, byte-level BPE.

Each stage reads all rows that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import bpe, langid, mixing, neardup, toxicity
from spindrift.sources.scratch import materialize

#: Least share of a document's words in its language.
LEAST_LANGUAGE = 0.4
ORACLE_SQL = None  # learned models, signatures and BPE are no SQL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of which no language holds ``LEAST_LANGUAGE``; learns from the rows' own lang.

    Null and empty texts go. Rows are judged by their text, whatever their doc_id, so rows without doc_id, with a shared one, and
    repeated rows are judged like others and stay as often as they come.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out(F.col("doc_id")))
    rows = _keyed(docs)
    found = langid.predict(rows.select(F.col("_key").alias("doc_id"), "text"), model)
    return _drop(docs, rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic. Rows are judged by their text, as in ``language``; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    lm = toxicity.language_model(docs)
    rows = _keyed(docs)
    model = toxicity.fit(docs.select("doc_id", "text"), labels, lm)
    scored = toxicity.score_documents(rows.select(F.col("_key").alias("doc_id"), "text"), lm, model)
    return _drop(docs, rows, scored.where("predicted = 1"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one of smallest doc_id, once.

    Of rows that share a doc_id, the one of smallest key (a hash of doc_id and text) stays. Rows without doc_id are in no group; of
    those that are equal in text, one stays.
    """
    found = neardup.near_duplicates(docs)
    rows = _keyed(docs).join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_key"))).orderBy("_key")
    return rows.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents by the mix: a row for each whole pass, and the words of the part where a budget ends.

    Rows are known by a hash of doc_id, text and source, so rows without doc_id or with a shared one take part like others; equal rows
    count as one whose passes are added up. Documents without words are left out, as no budget is spent on them.
    """
    rows = _keyed(docs, "source")
    taken = mixing.mix_sources(rows.select(F.col("_key").alias("doc_id"), "source", "text")).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_key")).agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_copies"))
    repeats = not taken.where("_copies > 1").isEmpty()
    rows = (rows.dropDuplicates(["_key"]) if repeats else rows).join(taken, "_key")
    rows = rows.withColumn("_nth", F.explode(F.expr("sequence(1L, (_taken + _size - 1) div _size)")))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_nth") - 1) * F.col("_size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < F.col("_size"), head).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and decode its ids, as digests; null is the empty text, and every row gives one."""
    return bpe.digests(docs, *bpe.public_tokenizer())


STAGES = [("language", language), ("toxicity", clean), ("near-duplicates", unique), ("mixing", mix), ("tokens", tokens)]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` with a hash of doc_id, text and further columns in ``_key``; nulls differ from all values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", *more, "text")]
    return docs.withColumn("_key", F.md5(F.concat_ws("\x1f", *parts)))


def _drop(docs: DataFrame, rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The ``rows`` whose key is no doc_id of ``bad``, with the columns of ``docs``."""
    return rows.join(bad.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
