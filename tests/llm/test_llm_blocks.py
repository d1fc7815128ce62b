"""Sharding, mixing and near-duplicates against brute force, with the blocks so small that each run has several."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spindrift.llm")
from spindrift.llm import mixing, neardup, sharding  # noqa: E402


def plain_jump(key: int, shards: int) -> int:
    at, ahead, key = -1, 0, key % (1 << 64)
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_sharding_equals_a_plain_loop_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = [(i if i % 50 else None, "same" if i % 3 else f"text {i}") for i in range(400)] + [(7, "text of a shared id"), (8, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k")).collect()}
    got = sharding.shard_documents(docs, 3).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(t) + 8) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["shard"] == plain_jump(keys[r["doc_id"]], 3) and r["grown_shard"] == plain_jump(keys[r["doc_id"]], 4)
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 3 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_targets(sizes):
    """Shares by weight; sources above their cap stop there and the excess is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    return capped


@pytest.mark.parametrize("rows_of_a_range", [3, 20, 1000])
def test_mixing_equals_a_plain_loop_over_many_ranges(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_of_a_range)
    rng = np.random.default_rng(3)
    source = lambda i: None if i % 29 == 0 else "hot" if i % 3 else f"s{i % 5}"
    rows = [(i, source(i), None if i % 41 == 0 else " ".join(["w"] * int(rng.integers(0, 30)))) for i in range(700)]
    got = {r["doc_id"]: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(got) == len(rows)
    groups, sizes = collections.defaultdict(list), collections.Counter()
    for i, s, text in rows:
        groups[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, len((text or "").split())))
        sizes[s] += len((text or "").split())
    targets = plain_targets(sizes)
    for s, members in groups.items():
        assert got[members[0][1]]["target"] == pytest.approx(targets[s])
        budget = int(got[members[0][1]]["target"])
        full, rest = divmod(budget, sizes[s])
        for _, i, n in sorted(members):
            part = min(n, rest)
            rest -= part
            assert (got[i]["size"], got[i]["source_size"], got[i]["taken"]) == (n, sizes[s], full * n + part)


def plain_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("heads", [0, 2])
def test_near_duplicates_over_many_blocks(spark, monkeypatch, heads):
    monkeypatch.setattr(neardup, "HEADS", heads)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for family in range(6):  # all families share a passage; copies of a family differ in a few words
        base = passage + [f"f{family}w{i}" for i in range(60)]
        for copy in range(9):
            words = list(base)
            for at in rng.integers(0, len(words), 2):
                words[at] = f"e{family}c{copy}a{at}"
            rows.append((100 * copy + family, " ".join(words)))
    rows += [(5000 + i, " ".join(passage + [f"own{i}x{j}" for j in range(10 + 4 * i)])) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
