"""Pieces of nested values: nothing lost, sizes within bounds, each rule on a small value."""

import json
import random

from pyspark.sql import functions as F

from spindrift import registry
from spindrift.functions import nested


def leaves(value, path=()):
    """(path, scalar) of a value in order; lists by place; an empty object or list is a leaf."""
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    if not isinstance(value, dict) or not value and path:
        return [(path, value)]
    return [x for k, v in value.items() for x in leaves(v, (*path, k))]


def some_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 3)
    if kind < 3:
        return rng.choice([None, True, 3.5, "é" * rng.randrange(40), 'say "x"\n', {}, []])
    inner = [some_value(rng, depth + 1) for _ in range(rng.randrange(6))]
    return inner if kind == 3 else {f"k{i}": v for i, v in enumerate(inner)}


def test_members_stay_whole_while_they_fit():
    value = {"a": 1, "b": {"c": "x" * 30, "d": [1, 2]}, "e": "y" * 10}
    assert nested.split_nested(value, 1000, 10) == [{"a": 1, "b": {"c": "x" * 30, "d": {"0": 1, "1": 2}}, "e": "y" * 10}]
    # b doesn't fit: it is taken apart, in a new piece since the first has its least size; so is d, whose parts fit the piece after
    # that, and e by a single character: 30 of 50 are taken, and it has 19
    want = [{"a": 1}, {"b": {"c": "x" * 30}}, {"b": {"d": {"0": 1, "1": 2}}, "e": "y" * 10}]
    assert nested.split_nested(value, 50, 8) == want
    assert nested.split_nested({**value, "e": "y" * 11}, 50, 8) == [*want[:2], {"b": want[2]["b"]}, {"e": "y" * 11}]
    # a first piece below the least size goes on
    assert nested.split_nested(value, 50, 20)[0] == {"a": 1, "b": {"c": "x" * 30}}
    assert nested.split_nested([], 50, 8) == nested.split_nested({}, 50, 8) == nested.split_nested(7, 50, 8) == []


def test_pieces_hold_every_leaf_once_in_order_within_their_bounds():
    rng = random.Random(3)
    several = 0
    for _ in range(400):
        value = {"top": [some_value(rng) for _ in range(8)], "more": some_value(rng)}
        largest, least = rng.choice([(40, 20), (120, 60), (400, 10)])
        pieces = nested.split_nested(value, largest, least)
        assert [x for p in pieces for x in leaves(p)] == [(p, {} if v == [] else v) for p, v in leaves(value)]
        sizes = [len(json.dumps(p, ensure_ascii=False)) for p in pieces]
        assert all(s >= least for s in sizes[:-1])
        longest = max(len(json.dumps(v, ensure_ascii=False)) for _, v in leaves(value))
        above = max(sum(len(k) + 6 for k in p) for p, _ in leaves(value))
        assert all(s <= max(largest, least + longest) + 2 * above for s in sizes)
        several += len(pieces) > 1
    assert several > 200


def test_json_texts_null_and_broken_ones(spark):
    rows = [(1, '{"a": [1, {"b": null}]}'), (2, None), (3, "{"), (4, ""), (5, "3"), (6, json.dumps({"k": ["w" * 90] * 40})), (6, "{}")]
    got = spark.createDataFrame(rows, "i long, j string").select("i", nested.json_pieces(F.col("j"), 100).alias("p")).collect()
    found = [(r["i"], r["p"]) for r in got]
    assert found[:5] == [(1, ['{"a": {"0": 1, "1": {"b": null}}}']), (2, None), (3, None), (4, None), (5, [])] and found[6] == (6, [])
    assert [w for p in found[5][1] for w in json.loads(p)["k"]] == [str(i) for i in range(40)] and len(found[5][1]) > 10


def test_registered_pieces_are_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    made = {}
    for r in registry.QUERIES["s4_json_pieces"](spark, sf).orderBy("doc_id", "piece_no").collect():
        made.setdefault(r["doc_id"], []).extend(leaves(json.loads(r["content"])))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        parts = [[s for s in line.split(". ")] for line in r["text"].split("\n")]
        want = {"source": r["source"], "lang": r["lang"], "lines": [{"n_chars": len(line), "sentences": p} for line, p in zip(r["text"].split("\n"), parts)]}
        assert made[r["doc_id"]] == leaves({k: v for k, v in want.items() if v is not None})
