"""What large queries write between stages: plans and row counts on small tables."""

import re

from pyspark.sql import functions as F


def shuffles(df):
    """The keys of the plan's shuffles, without their column numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (hashpartitioning\(.*?\)|rangepartitioning\(.*?\)|SinglePartition)", plan)]


def test_fields_are_searched_where_a_chunk_stands(spark):
    from spindrift.operators import fulltext

    docs = spark.createDataFrame([(i, f"red apple {i}", "green pear") for i in range(50)], "doc_id long, text string, tag string")
    items = spark.createDataFrame([(1, "red apples"), (2, "pear green")], "item_id long, text string")
    same = spark.createDataFrame([("apples", "apple")], "term string, synonym string")
    found = fulltext.best_fields(items, "item_id", "text", docs, "doc_id", {"content": (F.col("text"), 2), "tag": (F.col("tag"), 30)}, same, slop=2)
    assert [re.sub(r", \d+\)", ")", x) for x in shuffles(found) if "doc_id" in x] == ["hashpartitioning(doc_id)"]
    rows = {(r["item_id"], r["doc_id"]): (r["field"], r["matched"]) for r in found.collect()}
    assert rows == {(1, i): ("content", 2) for i in range(50)} | {(2, i): ("tag", 2) for i in range(50)}


def test_sums_over_paths_list_no_path(spark):
    from spindrift import registry
    from spindrift.operators import graph as g

    pairs = [(p, s) for p in range(12) for s in range(9) if (p * 5 + s * 3) % 4 and p != 11] + [(11, 0)]
    value = {s: 1.0 + s for s in range(9)}
    want = {(p, s): value[s] / 2 + sum(value[x] for q, x in pairs if q == p and x != s) / 3 for p, s in pairs}
    edges = spark.createDataFrame([(p, s, value[s]) for p, s in pairs], "p long, s long, v double")
    assert {(r["p"], r["s"]): round(r["sum"], 9) for r in g.last_edge_sums(edges, "p", "v").collect()} == {k: round(v, 9) for k, v in want.items()}
    plan = registry.QUERIES["m25_graph_retrieval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "array_append" not in plan


def test_shared_nodes_count_each_pair_once(spark):
    from collections import Counter

    from spindrift import registry
    from spindrift.operators import graph as g

    edges = [(s, p) for s in range(30) for p in range(8) if (s * 7 + p) % 3] + [(s, 100) for s in range(30)] + [(5, 200)]
    want = Counter((a, b) for a, p in edges for b, q in edges if p == q and a < b)
    rows = spark.createDataFrame(edges, "s long, p long")
    for most in (4, 1024):  # all nodes in slices, and none
        got = g.shared_nodes(rows, "s", "p", most).collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)
    frame = registry.QUERIES["g13_j15_paths"](spark, "/root/testdata/sf0.001")
    assert any(k.startswith("rangepartitioning(part") for k in shuffles(frame))
    assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_give_each_groups_best(spark, monkeypatch):
    from itertools import groupby

    import numpy as np

    from spindrift import registry
    from spindrift.operators import blocks

    rng = np.random.default_rng(5)
    data = [(i, i % 3, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(90)]
    data += [(i, 1, data[4][2]) for i in range(90, 99)] + [(99, None, data[0][2]), (100, 1, None), (101, 1, [0.0] * 6)]
    rows = spark.createDataFrame(data, "k long, label int, v array<double>").withColumn("doc", F.col("k") % 4)
    rows = blocks.weighted_units(rows, [(F.slice("v", 1, 2), 2, 0.4), (F.slice("v", 3, 4), 4, 0.6)]).drop("v")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if np.any(a) and np.any(b) else 0.0
    score = lambda a, b: round(0.4 * cos(a[:2], b[:2]) + 0.6 * cos(a[2:], b[2:]), 6)
    vector = {k: np.array(v if v else [0.0] * 6) for k, _, v in data}
    want = []
    for q, label, _ in data:
        if q % 5 == 0 and label is not None:
            near = sorted((k % 4, -score(vector[q], vector[k]), k) for k, other, _ in data if other == label and k != q)
            want += [(q, k, d, -s) for d, g in groupby(near, key=lambda r: r[0]) for _, s, k in list(g)[:2]]
    for size in (7, 1000):
        monkeypatch.setattr(blocks, "ROWS", size)
        monkeypatch.setattr(blocks, "SMALL", size)
        monkeypatch.setattr(blocks, "ASKED", size - 3)
        found = blocks.best_of_groups(rows.where("k % 5 = 0").withColumnRenamed("k", "q"), rows, "q", "k", "doc", "label", 2)
        got = sorted(((r["q"], r["doc"], -r["score"], r["k"]) for r in found.collect()))
        best = [(q, k, d, -s) for (q, d), g in groupby(got, key=lambda r: r[:2]) for _, _, s, k in list(g)[:2]]
        assert [(q, k, d) for q, k, d, _ in best] == [x[:3] for x in sorted(want, key=lambda r: (r[0], r[2], -r[3], r[1]))]
        assert max(abs(a[3] - b[3]) for a, b in zip(best, sorted(want, key=lambda r: (r[0], r[2], -r[3], r[1])), strict=True)) < 1.5e-6
    plan = registry.QUERIES["m21_image_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and not re.search(r"Join.*query_id", plan)
