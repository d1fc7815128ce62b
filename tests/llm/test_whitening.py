"""Whitening against a plain eigendecomposition, and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spindrift.llm")
from spindrift.llm import qdwh, whitening  # noqa: E402

SPECTRA = {
    "wide": np.logspace(0, -8, 40),
    "ties": np.repeat([3.0, 2.0, 1.0, 0.0], 5),
    "shift on an eigenvalue": np.array([1.0, 2.0, 3.0]),
    "equal": np.ones(6),
    "none": np.zeros(3),
    "close": np.array([1.0, 1.0 + 1e-9, 0.5]),
    "negative": np.array([-5.0, 4.0, -1e-3, 2.0]),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_divide_and_conquer_gives_eigenvectors_to_double_precision(name):
    values = SPECTRA[name]
    n, rng = len(values), np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = (q * values) @ q.T
    e, v = qdwh.top_eigenvectors(a, n)
    size = max(np.abs(values).max(), 1e-300)
    assert np.allclose(e, np.sort(values)[::-1], rtol=0, atol=1e-13 * size)
    assert np.abs(a @ v - v * e).max() < 1e-13 * size and np.abs(v.T @ v - np.eye(n)).max() < 1e-13
    few, _ = qdwh.top_eigenvectors(a, 2)
    assert np.allclose(few, e[:2], rtol=0, atol=1e-13 * size)


def test_polar_factor_is_orthogonal_and_leaves_a_positive_part():
    a = np.random.default_rng(1).standard_normal((30, 30))
    u = qdwh.polar(a)
    h = u.T @ a
    assert np.abs(u.T @ u - np.eye(30)).max() < 1e-13 and np.abs(h - h.T).max() < 1e-12 and np.linalg.eigvalsh((h + h.T) / 2).min() > 0


def brute(vectors, k):
    """Rows by id, from exact integers and LAPACK's eigendecomposition."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in vectors]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[(n * c - s) / n for c, s in zip(x, total)] for x in fit])
    e, w = np.linalg.eigh(d.T @ d / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(x, total)), (np.array([(n * c - s) / n for c, s in zip(x, total)]) @ w) / np.sqrt(e)) for i, x in kept}
    return n, e / np.trace(d.T @ d / n), out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) * np.linspace(3, 0.3, 12)]) for i in range(300)]
    vectors += [(500 + i, vectors[7][1]) for i in range(200)]  # copies count once in the fit
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0)).repartition(7)
    got = whitening.whiten(df, 5).collect()
    n, explained, rows = brute(vectors, 5)
    assert len(got) == 5 * len(vectors) and {r["n"] for r in got} == {n} and {type(r["deviation"]) for r in got} == {int}
    sign = {r["component"]: np.sign(r["whitened"] * rows[0][1][r["component"] - 1]) for r in got if r["vec_id"] == 0}
    for r in got:
        at = r["component"] - 1
        assert r["deviation"] == rows[r["vec_id"]][0]
        assert r["explained"] == pytest.approx(explained[at], rel=1e-10)
        assert r["whitened"] * sign[r["component"]] == pytest.approx(rows[r["vec_id"]][1][at], abs=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2)]
    assert {r["n"] for r in got} == {3} and max(r["identity_error"] for r in got) < 1e-12
    for none in ("vec_id = 1", "vec_id = 2", "vec_id = 99"):  # equal vectors, no vector, no row
        assert whitening.whiten(df.where(none)).collect() == []


def test_exact_integers_beyond_64_bits():
    x, n = np.array([[1 << 40, 5]]), 1 << 30
    t = whitening.spread(x, n, np.array([1 << 60, 7]))
    assert t.tolist() == [[(1 << 70) - (1 << 60), (5 << 30) - 7]]
    with pytest.raises(OverflowError):
        whitening.squared(t)
    assert whitening.squared(np.array([[3, -4]])).tolist() == [25]
