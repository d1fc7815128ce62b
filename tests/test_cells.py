"""The cell index against all cosines."""

import numpy as np
import pytest

from spindrift.operators import cells


def brute(queries, rows, k, floor):
    out = []
    for q, v, g in queries:
        if v is None or g is None or not np.isfinite(v).all() or not np.any(v):
            continue
        near = []
        for i, w, h in rows:
            if w is None or h != g or i == q or not np.isfinite(w).all() or not np.any(w):
                continue
            s = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
            if s >= floor:
                near.append((-s, i))
        out += [(q, i, -s) for s, i in sorted(near)[:k]]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 12))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.1 * rng.standard_normal(12)], int(i % 2)) for i in range(900)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(4)]  # ties
    return rows + [(2000, None, 0), (2001, [0.0] * 12, 0), (2002, [float("nan")] * 12, 1), (2003, rows[0][1], None)]


@pytest.mark.parametrize(("k", "floor"), [(1, 0.0), (5, 0.1), (60, -1.0)])
def test_neighbours_are_those_of_all_pairs(spark, clustered, k, floor):
    from spindrift.operators.search import top

    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = df.where("vec_id % 30 = 0 or vec_id > 999").withColumnRenamed("vec_id", "query_id")
    found = top(cells.neighbours(asked, df, "query_id", "vec_id", "embedding", k, "label", floor), "query_id", k, "similarity", "vec_id")
    got = sorted((r["query_id"], r["vec_id"], r["similarity"]) for r in found.collect())
    want = brute([r for r in clustered if r[0] % 30 == 0 or r[0] > 999], clustered, k, floor)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want))


def test_cells_out_of_reach_are_not_read(spark, clustered):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id % 30 = 0 and vec_id < 900").withColumnRenamed("vec_id", "query_id")
    near, placed = cells.reachable(asked, df, "query_id", "vec_id", "embedding", 5, "label", 0.1)
    measured = cells.in_reach(near, placed, "query_id", "vec_id", "label").count()
    assert measured < 0.25 * 30 * 450
    none = df.where("vec_id < 0")
    assert cells.neighbours(asked, none, "query_id", "vec_id", "embedding", 5, "label").count() == 0
    assert cells.neighbours(none.withColumnRenamed("vec_id", "query_id"), df, "query_id", "vec_id", "embedding", 5, "label").count() == 0
