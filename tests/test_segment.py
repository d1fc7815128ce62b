"""Stems of known words; segmentation against all ways through short runs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.stemming import fold_width, porter
from spindrift.operators import segment

STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl "
    "sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration "
    "valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic "
    "operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form "
    "formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust "
    "defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular "
    "homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll by by"
).split()


@pytest.mark.parametrize(("word", "stem"), list(zip(STEMS[::2], STEMS[1::2])))
def test_porter(word, stem):
    assert porter(word) == stem


def every_way(run, known):
    """All cuts of a run into known words and single characters, with their scores, best first; among equals, by where words begin."""
    out = []
    for bits in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0] + [i + 1 for i, b in enumerate(bits) if b] + [len(run)]
        words = [run[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(w in known or len(w) == 1 for w in words):
            score = 30 / len(words) + sum(len(w) > 1 for w in words) / len(words) + sum(known.get(w, -12.0) for w in words)
            out.append((-score, cuts[:-1], words))
    return sorted(out)


def longest(run, known, back=False):
    words, text = [], run[::-1] if back else run
    while text:
        n = max((k for k in range(1, len(text) + 1) if (text[:k][::-1] if back else text[:k]) in known), default=1)
        words.append(text[:n][::-1] if back else text[:n])
        text = text[n:]
    return words[::-1] if back else words


def cuts_of(words):
    return list(itertools.accumulate([0, *map(len, words)]))[:-1]


def test_segmentation_equals_enumeration():
    rng = np.random.default_rng(4)
    differ = 0
    for _ in range(300):
        known = {"".join(rng.choice(list("abc"), int(rng.integers(1, 5)))): -float(rng.integers(1, 12)) - float(rng.random()) for _ in range(14)}
        run = "".join(rng.choice(list("abcd"), int(rng.integers(1, 10))))
        ways = segment.Ways(run, ((s, e, known[run[s:e]]) for s in range(len(run)) for e in range(s + 1, len(run) + 1) if run[s:e] in known))
        front, back = cuts_of(longest(run, known)), cuts_of(longest(run, known, True))
        assert ways.forward() == front and ways.backward() == back
        all_ways = every_way(run, known)
        assert ways.score(ways.best(0, len(run)), len(run)) == pytest.approx(-all_ways[0][0])
        assert sorted(map(tuple, ways.ways(0, len(run)))) == sorted(tuple(c) for _, c, _ in all_ways)
        shared = sorted(set(front) & set(back)) + [len(run)]
        want = []
        for s, e in zip(shared, shared[1:]):
            if [c for c in front if s <= c < e] == [c for c in back if s <= c < e]:
                want += [c for c in front if s <= c < e]
            else:
                differ += 1
                want += [s + c for c in every_way(run[s:e], known)[0][1]]
        assert cuts_of(ways.segmented()) == want
        fine = every_way(run, known)
        if 3 <= len(run) and len(fine) > 1 and len(fine[1][2]) < len(run):
            assert sum(map(len, ways.fine(0, len(run)))) == len(run)
            assert ways.fine(0, len(run)) == fine[1][2]
    assert differ > 30


def test_tokens_of_mixed_text(spark):
    corpus = spark.createDataFrame([("北京 大学 北京 大学 北京大学 北京大学 学生 学生 大学生 生活 生活 running runs",)], "text string")
    dictionary = segment.learn_dictionary(corpus, "text", 1)
    rows = [(1, "Running　ＡＢＣ北京大学生活, cats!"), (2, None), (3, ""), (4, "龘北京"), (4, "ponies")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash"))
    out = {}
    for r in segment.tokenize(df, "doc_id", "text", dictionary).orderBy("doc_id", "pos").collect():
        out.setdefault(r["doc_id"], []).append(r["token"])
    assert out[1][:2] == ["run", "abc"] and out[1][-1] == "cat" and "".join(out[1][2:-1]) == "北京大学生活"
    assert set(out) == {1, 4} and sorted(out[4]) == sorted(["龘", "北京", "poni"])
    freq = {r["term"]: r["freq"] for r in segment.term_frequency(spark.createDataFrame([("北京",), ("no",)], "term string"), dictionary).collect()}
    assert freq == {"北京": math.floor(2 / 13 * 1_000_000 + 0.5), "no": 0}
    assert spark.range(1).select(fold_width(F.lit("Ａ！～　b"))).first()[0] == "A!~ b"


def test_runs_are_cut_into_dictionary_words_or_characters(spark):
    corpus = spark.createDataFrame([("the cat sat on the mat the cat",)], "text string")
    dictionary = segment.learn_dictionary(corpus, "text", 1)
    runs = spark.createDataFrame([("thecatsatonthemat",), ("thecatsatonthemat",), ("xthey",), ("",), (None,)], "run string")
    got = {r["run"]: r["tokens"] for r in segment.segment(runs, dictionary).collect()}
    assert got == {"thecatsatonthemat": "the cat sat on the mat".split(), "xthey": ["x", "the", "y"]}
    assert segment.segment(runs, dictionary.where("n < 0")).where("run = 'xthey'").first()["tokens"] == list("xthey")
