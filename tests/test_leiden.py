"""Leiden communities: modularity by level, connection, the bound on sizes, planted groups."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import leiden as ld


def planted(groups, size, seed=0):
    rng = np.random.default_rng(seed)
    edges = []
    for a in range(groups * size):
        for b in range(a):
            same = a // size == b // size
            if rng.random() < (0.7 if same else 0.01):
                edges.append((f"n{a:03}", f"n{b:03}", 1.0 + float(rng.random())))
    return edges


def modularity(edges, comm, gamma=1.0):
    k, inside, total = collections.Counter(), 0.0, collections.Counter()
    for a, b, w in edges:
        k[a] += w
        k[b] += w
        inside += 2 * w * (comm[a] == comm[b])
    m2 = sum(k.values())
    for n, c in comm.items():
        total[c] += k[n]
    return inside / m2 - gamma * sum((t / m2) ** 2 for t in total.values())


def parts(edges, members):
    """How many connected parts the members have."""
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        if a in members and b in members:
            near[a].add(b)
            near[b].add(a)
    left, n = set(members), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            fresh = near[todo.pop()] & left
            left -= fresh
            todo += fresh
    return n


@pytest.fixture(scope="module")
def graph(spark):
    edges = planted(4, 7, 1)
    return edges, spark.createDataFrame(edges, "src string, tgt string, weight double")


def run(df, levels):
    arcs = ld.arcs_of(df).withColumn("scope", F.lit(0))
    scopes = arcs.select("scope").distinct().withColumn("gamma", F.lit(1.0))
    found = ld.leiden(arcs, scopes, levels)
    return {r["node"]: r["comm"] for r in found.collect()}, found, arcs, scopes


def test_planted_groups_are_found_and_modularity_never_falls(graph):
    edges, df = graph
    last = modularity(edges, {n: n for e in edges for n in e[:2]})
    for levels in (1, 2):
        comm, found, arcs, scopes = run(df, levels)
        now = modularity(edges, comm)
        m2 = scopes.withColumn("m2", F.lit(sum(2 * w for _, _, w in edges)))
        assert ld.modularity(found, arcs, m2).first()["modularity"] == pytest.approx(now)
        assert now >= last - 1e-9
        last = now
    groups = collections.defaultdict(set)
    for n, c in comm.items():
        groups[c].add(n)
    assert sorted(map(sorted, groups.values())) == [[f"n{i:03}" for i in range(g * 7, g * 7 + 7)] for g in range(4)]
    assert last >= modularity(edges, {n: int(n[1:]) // 7 for n in comm}) - 1e-9
    assert all(parts(edges, g) == 1 for g in groups.values())


def test_hierarchy_is_connected_nested_and_within_the_bound(spark):
    edges = planted(2, 7, 3) + [("a", "b", 1.0), ("b", "a", 2.0), ("x", "x", 1.0), (None, "y", 1.0), ("hub", "n000", 0.1)]
    df = spark.createDataFrame(edges, "src string, tgt string, weight double").withColumn("scope", F.lit("clash"))
    rows = ld.hierarchy(df, 6).collect()
    real = [e for e in edges if e[0] and e[0] != e[1]]
    level0 = {r["node"]: r["community"] for r in rows if r["level"] == 0}
    assert set(level0) == {n for e in real for n in e[:2]} and level0["a"] == level0["b"] == "a"
    final = collections.Counter(r["node"] for r in rows if r["final"])
    assert set(final) == set(level0) and set(final.values()) == {1}
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r["level"], r["community"]].add(r["node"])
    above = {(r["level"], r["node"]): r["community"] for r in rows}
    for r in rows:
        members = groups[r["level"], r["community"]]
        assert r["size"] == len(members) and r["final"] == (len(members) <= 6) and r["community"] == min(members)
        assert r["parent"] == (above[r["level"] - 1, r["node"]] if r["level"] else None)
    assert all(parts(real, g) == 1 for g in groups.values())
    assert ld.hierarchy(df.where("src = 'none'")).collect() == []
