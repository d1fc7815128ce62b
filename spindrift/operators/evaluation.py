"""Retrieval metrics over a run (qid, doc_id, rank from 1) and judgments (qid, doc_id, rel > 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, hit, mrr, ap, ndcg, ndcg_flat) at k for every judged query; 0 where the run has nothing.

    ``ndcg`` divides by the best possible order; ``ndcg_flat`` by the plain sum of gains, without a discount.
    """
    seen = judged(run, qrels).where(F.col("rank") <= k)
    hit = F.col("rel") > 0
    discount = F.log2(F.col("rank") + 1)
    from pyspark.sql import Window

    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("precision", F.sum(hit.cast("int")).over(before) / F.col("rank"))
    got = seen.groupBy("qid").agg(
        F.sum(hit.cast("int")).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, F.col("precision")).otherwise(0.0)).alias("precisions"),
        F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / discount).alias("dcg"),
    )
    best = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("at", F.row_number().over(best))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    ideal = ideal.groupBy("qid").agg(
        F.count(F.lit(1)).alias("relevant"),
        F.sum(F.when(F.col("at") <= k, gain / F.log2(F.col("at") + 1)).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(F.col("at") <= k, gain).otherwise(0.0)).alias("gains"),
    )
    both = ideal.join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "qid",
        zero(F.col("hits") / F.col("relevant")).alias("recall"),
        zero(F.when(F.col("hits") > 0, 1.0)).alias("hit"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("precisions") / F.least(F.col("relevant"), F.lit(k))).alias("ap"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(F.col("dcg") / F.col("gains")).alias("ndcg_flat"),
    )


def confusion(rows: DataFrame, predicted: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """Counts tp, fp, fn, tn with precision and recall (0 if undefined), whole or by keys; both columns are 0 or 1."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    count = lambda c: F.sum(c.cast("int"))
    out = rows.groupBy(*(keys or [])).agg(count(p & a).alias("tp"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"), count(~p & ~a).alias("tn"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
