"""Vector codes against a plain loop over all entries, and on odd rows."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spindrift.llm")
from spindrift.llm import codes  # noqa: E402


def brute(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error, digest) by measuring every distance in every round."""
    kept = [(i, label, [math.floor(4096 * c) for c in v]) for i, label, v in rows]
    width = -(-max(len(x) for _, _, x in kept) // parts)
    cut = [[(x + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][2]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min(range(len(books[p])), key=lambda k: (distance(v[p], books[p][k]), k)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, found) if c[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = nearest()
    error = [sum(distance(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, found)]
    total = collections.Counter()
    for (_, label, _), e in zip(kept, error):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in cs), e, total[label], digest) for (i, label, _), cs, e in zip(kept, found, error))


def plain(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 6), (8, 16, 2), (1, 3, 4), (3, 1, 2)])
def test_codes_equal_a_plain_loop(spark, parts, entries, rounds):
    rng = np.random.default_rng(parts)
    centres = rng.standard_normal((9, 16))
    rows = [(i, int(i % 3) if i % 7 else None, [float(np.float32(c)) for c in centres[i % 9] + 0.2 * rng.standard_normal(16)]) for i in range(240)]
    rows += [(300 + i, 1, rows[5][2]) for i in range(60)]  # copies and ties
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("x")).withColumn("sums", F.lit(1)).repartition(5)
    got = codes.compress(df, parts, entries, rounds)
    assert plain(got) == brute(rows, parts, entries, rounds)


def test_bounds_spare_scans_and_come_back_with_their_entries(spark):
    rng = np.random.default_rng(0)
    centres = 4 * rng.standard_normal((8, 8))
    rows = [(i, 0, [float(c) for c in centres[i % 8] + 0.05 * rng.standard_normal(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    scans = codes.compress(df, 2, 8, 6).agg(F.sum("scans")).first()[0]
    assert scans < 2 * 400 * 7 * 0.5
    # an entry that comes back has a net displacement of 0, whatever it went
    home, away = np.zeros((1, 2, 2), np.int64), np.full((1, 2, 2), 50)
    books = codes.Books(np.stack([home, away, home]))
    assert books.own[0].max() == 0 and books.own[1].min() > 0
    # for each entry the largest displacement among the others
    books = codes.Books(np.stack([np.zeros((1, 3, 1), np.int64), np.array([[[1], [5], [3]]])]))
    assert books.rest[0].tolist() == [[5, 3, 5]]


def test_assign_is_exact_over_moving_codebooks():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (500, 2, 3))
    history, state = rng.integers(-40, 40, (1, 2, 6, 3)), None
    for _ in range(12):
        books = codes.Books(history)
        state, _ = codes.assign(x, state, books, measure=True)
        distance = ((x[:, :, None] - books.now[None]) ** 2).sum(3)
        assert (state["code"] == distance.argmin(2)).all() and (state["near"] == distance.min(2)).all()
        history = np.concatenate([history, history[-1:] + rng.integers(-4, 5, history[-1:].shape)])


def test_codes_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, 0, [0.5, 0.25, 1.0]), (1, 0, [0.5, 0.25, 1.0]), (2, 0, None), (3, 1, [nan, 1.0, 0.0]), (4, 1, [None, 1.0, 0.0]), (6, 1, []), (7, None, [1.0]), (None, None, [-1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    kept = [r for r in rows if r[2] and not any(c is None or c != c for c in r[2])]
    assert plain(codes.compress(df)) == brute(kept, 8, 16, 6)
    assert codes.compress(df.where("vec_id = 2")).collect() == [] and codes.compress(df.where("vec_id = 99")).collect() == []
    huge = spark.createDataFrame([(1, 0, [1e12]), (2, 0, [-1e12])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(huge).collect()
