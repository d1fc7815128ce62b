"""Rules of the surveyed operators on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.functions import citations, evaluation
from spindrift.operators import chunking, search, store, subgraph, trees


def test_citation_marks_are_mended_within_bounds(spark):
    said = {"see (ID: 3) now": "see ##3$$ now", "a ID 12 b": "a  b", "$[2]$": "##2$$", "x##5$ $y": "x ##5$$ y", "【1】【9】": "##1$$", "ref 4.": "##4$$.", "so 6== .": "so ##6$$ .", "# ID # 7": " 7", "plain 1": "plain 1"}
    df = spark.createDataFrame([(a, 8) for a in said] + [(None, 8)], "a string, n int")
    got = df.select("a", citations.mend_citations(F.col("a"), F.col("n")).alias("m")).collect()
    assert {r["a"]: r["m"] for r in got} == {**said, None: None}
    places = spark.createDataFrame([("##1$$ ##2$$ ##1$$",)], "a string").select(citations.cited_places(F.col("a")).alias("p"))
    assert places.first()["p"] == [1, 2]


def test_contents_go_until_the_first_entry_returns(spark):
    lines = ["Title", "con tents", "", "1. A ... 3", "2. B ... 5", "1. A", "text", "2. B"]
    assert chunking.drop_contents(lines) == ["Title", "1. A", "text", "2. B"]
    assert chunking.drop_contents(["contents", "x y"]) == [] and chunking.drop_contents(["a", "目录"]) == ["a"]
    df = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>").select(chunking.without_contents(F.col("l")).alias("k"))
    assert [r["k"] for r in df.collect()] == [["Title", "1. A", "text", "2. B"], None, []]


def test_sections_that_stand_alone_and_methods(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "#f", "c", "d"])], "id long, s array<string>")
    got = chunking.merge_sections(docs, "s", 10, alone=lambda x: x.startswith("#")).collect()
    assert [(r["chunk_no"], r["content"]) for r in got] == [(0, "ab"), (1, "#f"), (2, "cd")]
    docs = spark.createDataFrame([(1, "one", "a\nb"), (2, "lines", "a\n\nb"), (3, None, "a\nb c d\ne"), (4, "one", None)], "id long, m string, t string")
    got = chunking.chunk_by_method(docs, "m", "t", 4).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["chunk_no"], r["content"]) for r in got] == [(1, 0, "a\nb"), (2, 0, "a"), (2, 1, "b"), (3, 0, "ab c d"), (3, 1, "e"), (4, 0, None)]


def test_trees_of_any_depth_and_rings(spark):
    chain = [(i, i - 1 if i else None) for i in range(11)] + [(20, 5), (30, None)]
    nodes = spark.createDataFrame(chain, "id long, parent long")
    got = {(r["id"], r["ancestor"]): r["distance"] for r in trees.ancestors(nodes).collect()}
    want = {(i, j): i - j for i in range(11) for j in range(i + 1)} | {(20, j): 6 - j for j in range(6)} | {(20, 20): 0, (30, 30): 0}
    assert got == want
    sizes = spark.createDataFrame([(10, 3), (10, 4), (20, 5)], "id long, size long")
    total = {r["id"]: (r["items"], r["total"]) for r in trees.subtree_totals(nodes, sizes).collect()}
    assert total[0] == (3, 12) and total[6] == (2, 7) and total[20] == (1, 5) and total[30] == (0, 0)
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_graph_rebuilt_without_documents(spark):
    nodes = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "w"), (2, "b", "y"), (2, "c", None), (3, "a", "gone")], "doc long, id string, description string")
    edges = spark.createDataFrame(
        [(1, "b", "a", 1.0, "r", ["k"]), (2, "a", "b", 2.0, "q", None), (2, "a", "c", 9.0, "r", None), (2, "a", "b", 5.0, None, None), (3, "a", "a", 1.0, "r", None)],
        "doc long, src string, tgt string, weight double, description string, keywords array<string>",
    )
    n, e = subgraph.rebuild(nodes, edges, spark.createDataFrame([(3,)], "doc long"))
    assert [tuple(r) for r in e.collect()] == [("a", "b", 3.0, "q<SEP>r", ["k"], 2)]
    assert sorted(map(tuple, n.collect())) == [("a", "w<SEP>x", 2, 1), ("b", "y", 2, 1)]


def test_citations_fall_to_the_threshold_that_some_sentence_reaches(spark):
    rows = [(1, 0, 0, 0.5), (1, 0, 1, 0.498), (1, 1, 2, 0.45), (1, 2, 0, 0.5), (2, 0, 0, 0.3), (3, 0, 0, 0.7), (3, 1, 1, 0.6)]
    df = spark.createDataFrame(rows, "a int, s int, c int, x double")
    got = sorted((r["a"], r["s"], r["c"]) for r in search.cite(df, ["a"], "s", "c", "x").collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (3, 0, 0)]


def test_lookup_hits_only_what_is_young_enough(spark):
    day = dt.datetime(2024, 1, 1)
    at = lambda h: day + dt.timedelta(hours=h)
    asked = spark.createDataFrame([(1, "k", at(5)), (2, "k", at(30)), (3, "k", at(4)), (4, "j", at(5)), (5, "k", at(28))], "id int, k string, t timestamp")
    stored = spark.createDataFrame([("k", at(5)), ("k", at(4.5)), ("j", at(6))], "k string, t timestamp")
    got = {r["id"]: (r["hit"], r["stored_at"]) for r in store.look_up(asked, stored, "k", "t", 24 * 3600).collect()}
    assert got == {1: (True, at(5)), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, at(5))}


def test_evaluation_forms_and_support(spark):
    df = spark.createDataFrame([("Ａ b,\n C", "x. a B, c! y"), (None, "z"), ("qq", "zz")], "c string, a string")
    got = df.select(evaluation.normalised(F.col("c")).alias("n"), evaluation.signs_out(evaluation.normalised(F.col("c"))).alias("s"), evaluation.support(F.col("c"), F.col("a")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("ab,c", "abc", 1.0), ("", "", 0.0), ("qq", "qq", 0.0)]
