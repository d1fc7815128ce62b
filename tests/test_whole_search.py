"""Queries over all hits of an item, where the best by BM25 alone are not the best by similarity."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import registry
from spindrift.operators import pruned, search
from tests.test_queries import rows

LOUD, PLAIN = 80, 200


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One item; ``LOUD`` documents repeat its rare word of little weight, ``PLAIN`` ones have its heavy word once."""
    at = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, "zz " * 5, "loud") for i in range(LOUD)]
    docs += [(LOUD + i, "alpha " + " ".join(f"word{i}x{n}" for n in range(i % 7 + 1)), "plain") for i in range(PLAIN)]
    docs += [(900, None, "loud"), (901, "other words", "plain")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "zz alpha"), (2, "zz"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def found(spark, tables, name):
    """The query's rows, which its SQL gives too."""
    ours = registry.QUERIES[name](spark, tables).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    assert rows(ours) == rows(con.execute(registry.ORACLES[name]).df())
    return ours.to_dict("records")


def test_second_page_counts_all_documents_that_pass(spark, tables):
    got = [r for r in found(spark, tables, "m14_second_page") if r["item_id"] == 1]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [6, 7, 8, 9, 10]
    assert all(r["doc_id"] >= LOUD and r["total"] == LOUD + PLAIN for r in got)


def test_facets_are_of_the_best_of_all_hits(spark, tables):
    got = {(r["item_id"], r["source"]): r["hits"] for r in found(spark, tables, "a1_page_facets")}
    assert got == {(1, "plain"): 10, (2, "loud"): 10}


def test_packing_takes_the_best_of_all_hits(spark, tables):
    got = [r for r in found(spark, tables, "m26_prompt_packing") if r["item_id"] == 1]
    assert len(got) == 10 and all(r["doc_id"] >= LOUD for r in got)


def test_vector_rerank_ranks_all_hits(spark, tables):
    got = [r for r in found(spark, tables, "m10_m11_vector_rerank") if r["item_id"] == 1]
    assert len(got) == 10 and all(r["doc_id"] >= LOUD and r["term_similarity"] > 0.9 for r in got)


@pytest.mark.parametrize(("k", "first"), [(1, 1), (3, 5), (5, 4), (10, 70)])
def test_rows_left_out_are_not_among_the_best(spark, k, first):
    """Signs, zero vectors, missing sides, and queries none of whose first rows, or no row at all, has a cosine."""
    rng = np.random.default_rng(k)
    a = {q: rng.integers(-2, 3, 64).tolist() for q in range(6)} | {4: [0] * 64}
    b = {d: rng.integers(-2, 3, 64).tolist() if d % 5 else [-x for x in a[d % 6]] for d in range(60)}
    pairs = [(q, d, round(float(rng.random()), 6)) for q in range(7) for d in range(64) if q != 5 or d >= 60 or d == 7]
    pairs = [(q, d, 0.9 + d / 1000 if q == 3 and d >= 60 else t) for q, d, t in pairs]
    length = lambda v: math.sqrt(sum(x * x for x in v))
    near = lambda q, d: round(float(np.dot(a[q], b[d])) / (length(a[q]) * length(b[d])), 6) if q in a and d in b and any(a[q]) and any(b[d]) else 0.0
    want = []
    for q in range(7):
        mine = [(d, t, near(q, d)) for p, d, t in pairs if p == q]
        alone = not any(v for _, _, v in mine)
        best = sorted((-round(t if alone else 0.3 * v + 0.7 * t, 7), d) for d, t, v in mine)[:k]
        want += [(q, n + 1, d) for n, (_, d) in enumerate(best)]
    vectors = lambda vs, key, name: spark.createDataFrame([(i, v, length(v)) for i, v in vs.items()], f"{key} long, {name} array<long>, {name}_length double")
    scored = spark.createDataFrame(pairs, "q long, d long, tok double")
    left = pruned.mixed_survivors(scored, vectors(a, "q", "a"), vectors(b, "d", "b"), "q", "d", "tok", k, first=first)
    mixed = search.mix_similarity(left, "q", "tok").withColumn("similarity", F.round("similarity", 7))
    assert sorted((r["q"], r["rank"], r["d"]) for r in search.top(mixed, "q", k, "similarity", "d").collect()) == want
