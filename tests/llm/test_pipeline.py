"""The pipeline against its parts on a small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_pass_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        from spindrift.sources.scratch import materialize

        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        seen.append(docs)
    kept = [d.select("doc_id").distinct().count() for d in seen]
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0
    unique = seen[2]
    assert unique.count() == unique.select("doc_id").distinct().count()
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    got = sorted((r["doc_id"], r["decoded_sha256"]) for r in pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert got == want


def test_mixing_repeats_and_cuts_by_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(10)), "en", "a", 0) for i in range(6)] + [(10, "x " * 400, "en", "b", 0), (11, None, "en", "b", 0), (None, "no id", "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mix(spark, docs, SF)
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.expr("filter(split(text, ' '), x -> x <> '')"))).alias("n")).collect()}
    assert words["a"] == 120 and out.columns == docs.columns
    assert out.where("source = 'a'").count() == 12


ODD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", "en", None, 0, "x"),
    (3, "the and of that thing with the and of that thing", "en", "a", 0, "x"),
    (3, "the and of that thing with the and of that thing", "en", "a", 0, "x"),
    (3, "another text with the same id and of that thing", "en", "a", 0, "x"),
    (None, "the text without an id and of that with the thing", "en", "a", 0, None),
    (None, "the text without an id and of that with the thing", "en", "a", 0, None),
    (4, "the long and of " * 20000, "en", None, 0, "x"),
]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_on_odd_rows_and_clashing_columns(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    odd, none = spark.createDataFrame(ODD, schema), spark.createDataFrame([], schema)
    odd = odd.withColumn("key", F.lit("k")).withColumn("taken", F.lit(7))
    rows = stage(spark, odd, SF).collect()
    assert stage(spark, none, SF).count() == 0
    if name == "tokens":
        assert len(rows) == len(ODD)
        return
    ids = sorted((r["doc_id"] or 0) for r in rows)
    assert ids == {"language": [0, 0, 3, 3, 3, 4], "toxicity": [0, 0, 1, 2, 3, 3, 3, 4], "near-duplicates": [0, 1, 2, 3, 4], "mixing": ids}[name]
    if name == "mixing":
        assert {0, 3, 4} == set(ids)


def test_toxicity_is_the_same_before_and_after_the_pipeline(spark):
    from spindrift.llm import toxicity

    before = sorted(map(tuple, toxicity.op3_toxicity(spark, SF).collect()))
    pipeline.clean(spark, spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0"), SF).count()
    assert sorted(map(tuple, toxicity.op3_toxicity(spark, SF).collect())) == before
