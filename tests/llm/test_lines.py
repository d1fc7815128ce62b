"""Line dedup against a plain loop, through insertions and deletions; the filter against a multiset."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spindrift.llm")
from spindrift.llm import cuckoo, lines  # noqa: E402

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(lines.UPPER, lines.LOWER)


def key(line):
    k = line.strip(BLANK).translate(FOLD)
    return k if len(k) >= 20 else None


def brute(docs, least=3):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n") if i is not None else []:
            held[key(line)].add(i)
    out = []
    for i, t in docs:
        rows = (t or "").split("\n")
        stay = [r for r in rows if i is None or key(r) is None or len(held[key(r)]) < least or max(held[key(r)]) == i]
        out.append((str(i), len(rows), len(rows) - len(stay), "\n".join(stay)))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("drops", F.lit(1)).repartition(3)


def plain(df):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def made(seed, ids):
    rng = np.random.default_rng(seed)
    common = [f"Common line number {n} of them all" for n in range(12)] + ["short one", "", "  ÄÖÜ äöü ÉÈ mixed CASE line \t", "  äöü äöü éè mixed case line"]
    return [(int(i), "\n".join(common[n] if n < len(common) else f"own line {i} {n} and some words" for n in rng.integers(0, 20, int(rng.integers(0, 9))))) for i in ids]


ODD = [
    (1, None),
    (2, ""),
    (3, "\n\n"),
    (4, "A line that three documents hold\nB\n  a LINE that three documents hold\t"),
    (5, "a line that three documents hold"),
    (6, "x\na line that three documents hold\n\x0ba line that three documents hold\n"),
    (6, "a line that three documents hold\nof the second row"),
    (7, "nineteen characters\nnineteen characters"),
    (8, "nineteen characters"),
    (9, "nineteen characters"),
    (None, "a line that three documents hold"),
    (10, "only two documents have this one"),
    (11, "only two documents have this one"),
    (11, "only two documents have this one"),
    (12, "word " * 20000 + "\n" + "a line that three documents hold\n" * 3000),
    (13, "é" * 20 + "\n\U0001f642" * 3),
    (14, "é" * 20),
    (15, "É" * 20),
    (16, " " + "é" * 20),
]


def test_odd_rows(spark):
    df = frame(spark, ODD)
    assert plain(lines.deduplicate(lines.build(df), df)) == brute(ODD)
    none = df.where("doc_id = 99")
    assert lines.deduplicate(lines.build(none), none).collect() == []
    digest = hashlib.md5(("é" * 20).encode()).digest()
    assert lines.key_of(" " + "é" * 20 + "\r") == digest and lines.key_of("x" * 19) is None


def exact(index):
    counts = sorted((bytes(r["key"]), r["refs"], r["owner"]) for r in index.counts.collect())
    used = sum(int(np.count_nonzero(np.frombuffer(r["slots"], np.uint16))) for r in index.filters.collect())
    return counts, used


@pytest.mark.parametrize("shard_keys", [200_000, 3])
def test_insertions_and_deletions_are_reversible(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    a, b = made(1, range(40)), made(2, range(20, 70))  # ids 20 to 39 come twice, with different texts
    index = lines.build(frame(spark, a))
    only_a = exact(index)
    both = lines.insert(index, frame(spark, b))
    assert exact(both) == exact(lines.build(frame(spark, a + b)))
    assert plain(lines.deduplicate(both, frame(spark, a + b))) == brute(a + b)
    late = made(3, range(100, 130))
    more = lines.insert(index, frame(spark, late))
    less = lines.delete(more, frame(spark, late + [(999, "unknown")]))
    assert exact(less) == only_a and plain(lines.deduplicate(less, frame(spark, a))) == brute(a)
    rest = [(i, t) for i, t in a + late if i % 3]
    some = lines.delete(more, frame(spark, [(i, t) for i, t in a + late if i % 3 == 0]))
    assert exact(some) == exact(lines.build(frame(spark, rest))) and plain(lines.deduplicate(some, frame(spark, rest))) == brute(rest)
    repeated = sum(refs >= 3 for _, refs, _ in exact(some)[0])
    assert exact(some)[1] == repeated  # the filters hold each repeated key once, and no other


def test_filters_change_no_result(spark, monkeypatch):
    df = frame(spark, made(5, range(60)))
    index = lines.build(df)
    probed, everything = lines.candidates(index, index.lines).count(), lines._pairs(index.lines).count()
    with_filters = plain(lines.deduplicate(index, df))
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    assert probed < everything and lines.candidates(index, index.lines).count() == everything
    assert plain(lines.deduplicate(index, df)) == with_filters


def test_filter_holds_what_was_put_in_and_not_taken_out():
    rng = np.random.default_rng(0)
    keys = cuckoo.words([rng.bytes(16) for _ in range(3000)])
    found = cuckoo.Cuckoo.sized(1700)
    assert found.insert(keys[:1500]) and found.insert(keys[1500:3000]) and found.contains(keys).all() and found.used == 3000
    found.remove(keys[1000:])
    assert found.contains(keys[:1000]).all() and found.used == 1000 and found.contains(keys[1000:]).mean() < 0.01
    again = cuckoo.Cuckoo.read(found.slots.tobytes())
    assert again.contains(keys[:1000]).all()
    with pytest.raises(KeyError):
        cuckoo.Cuckoo.sized(10).remove(keys[:1])
    assert not cuckoo.Cuckoo.sized(4).insert(keys[:100])


def test_an_overfull_shard_is_built_anew(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {n} that all documents hold" for n in range(3))) for i in range(3)], "doc_id long, text string")
    index = lines.build(df)
    more = spark.createDataFrame([(i, "\n".join(f"other line {n} of many documents" for n in range(400))) for i in range(10, 14)], "doc_id long, text string")
    assert exact(lines.insert(index, more))[1] == 403
