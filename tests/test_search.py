"""Search operators against plain loops over all pairs."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import pruned, search


def words(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def bm25_all(queries, docs):
    """{query: {doc: score}} of all pairs that share a word."""
    held = {i: collections.Counter(words(t)) for i, t in docs}
    sizes = [sum(c.values()) for c in held.values() if c]
    n, mean = len(docs), sum(sizes) / max(1, len(sizes))
    df = collections.Counter(w for c in held.values() for w in c)
    out = collections.defaultdict(dict)
    for q, t in queries:
        for i, c in held.items():
            hit = [w for w in set(words(t)) if w in c]
            if hit:
                dl = sum(c.values())
                out[q][i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * dl / mean)) for w in hit)
    return out


def corpus(seed, docs, vocabulary):
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), vocabulary))
    rows = [(i, draw(int(rng.integers(1, 60)))) for i in range(docs)]
    rows += [(docs, None), (docs + 1, ""), (docs + 2, rows[5][1]), (docs + 3, rows[5][1])]
    asked = [(q, rows[q * 7][1] + " " + draw(12)) for q in range(12)] + [(90, None), (91, "nobody says this")]
    return rows, asked


@pytest.fixture(scope="module")
def made(spark):
    rows, asked = corpus(1, 3000, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "item_id long, text string")
    return docs, queries, bm25_all(asked, rows)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_search_gives_the_best_of_all_pairs(made, k):
    docs, queries, brute = made
    hits = pruned.top_hits(queries, "item_id", "text", docs, "doc_id", "text", k)
    scored = search.match(hits, "item_id", "doc_id", F.col("idf") * F.col("share")).withColumn("score", F.round("score", 6))
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.top(scored, "item_id", k).collect())
    want = []
    for q, scores in brute.items():
        best = sorted((-round(v, 6), i) for i, v in scores.items())[:k]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert [g[:3] for g in got] == sorted(want)
    assert all(v == pytest.approx(brute[q][i], abs=2e-6) for q, _, i, v in got)


def test_few_pairs_are_scored(made):
    docs, queries, brute = made
    terms, held = search.query_postings(queries, "item_id", "text", docs, "doc_id", "text")
    pairs = pruned.survivors(terms, held, "item_id", "doc_id", 5).count()
    matched = sum(map(len, brute.values()))
    assert 12 * 5 <= pairs < 0.1 * matched and pairs < 0.1 * 12 * docs.count()


def test_queries_with_fewer_hits_than_wanted_get_all(made):
    docs, queries, brute = made
    few = docs.where("doc_id < 9")
    hits = pruned.top_hits(queries, "item_id", "text", few, "doc_id", "text", 50)
    got = {(r["item_id"], r["doc_id"]) for r in hits.select("item_id", "doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in few.collect()]
    asked = [(r["item_id"], r["text"]) for r in queries.collect()]
    assert got == {(q, i) for q, scores in bm25_all(asked, rows).items() for i in scores}
    assert pruned.top_hits(queries, "item_id", "text", docs.where("doc_id < 0"), "doc_id", "text", 5).count() == 0


def test_hashed_vectors_and_their_cosine(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["dim"]): r["v"] for r in pruned.hashed_vectors(docs, "doc_id", "text").collect() if r["v"]}
    want = collections.Counter()
    for i, t in ((1, "abbc"), (2, "bcd")):
        for w in t:
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[i, h % 64] += 1 if h // 64 % 2 == 0 else -1
    assert got == {k: v for k, v in want.items() if v}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "q long, doc_id long")
    left = pruned.hashed_vectors(docs, "doc_id", "text").withColumnRenamed("doc_id", "q")
    near = {r["doc_id"]: r["c"] for r in pruned.sparse_cosine(pairs, left, pruned.hashed_vectors(docs, "doc_id", "text"), "q", "doc_id", "c").collect()}
    dot = sum(want[1, d] * want[2, d] for d in range(64))
    length = lambda i: math.sqrt(sum(want[i, d] ** 2 for d in range(64)))
    assert near == {2: pytest.approx(dot / length(1) / length(2)), 3: 0.0, 4: 0.0}


def brute_fields(queries, docs, boosts, synonyms, slop, least):
    """{(query, doc): (score, field, matched)} by loops; docs are (id, {field: text})."""
    from spindrift.functions import text as tx

    raw = lambda w: (1.0 if re.fullmatch(r"[a-z. -]+", w) else None)  # noqa: E731  the fixtures have Latin words alone
    held = {(i, f): words(t) for i, fields in docs for f, t in fields.items() if words(t)}
    stats = {f: (len(x), sum(x) / len(x)) for f in boosts if (x := [len(w) for (_, g), w in held.items() if g == f])}
    df = collections.Counter((f, w) for (_, f), ws in held.items() for w in set(ws))
    idf = lambda f, w: math.log(1 + (stats[f][0] - df[f, w] + 0.5) / (df[f, w] + 0.5))
    share = lambda tf, dl, f: tf / (tf + 1.2 * (0.25 + 0.75 * dl / stats[f][1]))
    assert tx and all(raw(w) for _, t in queries for w in words(t) if len(w) > 2)
    out = {}
    for q, t in queries:
        ws = words(t)
        heavy = {w: ws.count(w) * (0.01 if len(w) < 3 else 1.0) for w in ws}
        total = sum(heavy.values())
        clauses = [(w, x, heavy[w] / total * (1 if x == w else 0.25)) for w in heavy for x in [w, *(s for a, s in synonyms if a == w)]]
        phrases = {(a, b) for a, b in zip(ws, ws[1:])}
        for i, _ in docs:
            fields, matched = {}, set()
            for f, boost in boosts.items():
                text = held.get((i, f), [])
                got = []
                for w, x, weight in clauses:
                    if x in text:
                        matched.add(w)
                        got.append(weight * idf(f, x) * share(text.count(x), len(text), f))
                for a, b in phrases:
                    moves = [min((abs(n - m - 1) for n, y in enumerate(text) if y == b and n != m), default=99) for m, x in enumerate(text) if x == a]
                    tf = sum(1 / (1 + m) for m in moves if m <= slop)
                    if tf:
                        got.append(2 * max(heavy[a], heavy[b]) / total * (idf(f, a) + idf(f, b)) * share(tf, len(text), f))
                if got:
                    fields[f] = round(sum(got) * boost, 6)
            if matched and len(matched) >= math.floor(len(heavy) * least):
                best = max(fields.values())
                out[q, i] = (best, min(f for f, v in fields.items() if v == best), len(matched))
    return out


@pytest.mark.parametrize(("slop", "least"), [(0, 0.0), (2, 0.5)])
def test_best_fields_equal_loops(spark, slop, least):
    from spindrift.operators import fulltext

    rng = np.random.default_rng(slop)
    vocabulary = "red green blue apple pear plum runs sits under over house garden of".split()
    draw = lambda n: " ".join(vocabulary[int(x)] for x in rng.integers(0, len(vocabulary), n))
    docs = [(i, {"title": draw(3), "content": draw(int(rng.integers(0, 30)))}) for i in range(40)]
    docs += [(40, {"title": None, "content": ""}), (41, {"title": "Red, red RED apple", "content": "apple red"})]
    queries = [(1, "red apple"), (2, "green pear of the garden house"), (3, "red red apple plum"), (4, ""), (5, None), (6, "elsewhere"), (7, "runs under")]
    synonyms = [("house", "garden"), ("apple", "pear"), ("apple", "pear"), ("elsewhere", "over")]
    d = spark.createDataFrame([(i, f["title"], f["content"]) for i, f in docs], "doc_id long, title string, content string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    s = spark.createDataFrame(synonyms, "term string, synonym string")
    fields = {"title": (F.col("title"), 10), "content": (F.col("content"), 2)}
    got = fulltext.best_fields(q, "item_id", "text", d, "doc_id", fields, s, slop, least).collect()
    want = brute_fields(queries, docs, {"title": 10, "content": 2}, sorted(set(synonyms)), slop, least)
    assert {(r["item_id"], r["doc_id"]): (r["field"], r["matched"]) for r in got} == {k: v[1:] for k, v in want.items()}
    assert all(r["score"] == pytest.approx(want[r["item_id"], r["doc_id"]][0], abs=2e-6) for r in got)


def test_phrase_frequency_counts_moves(spark):
    from spindrift.operators.fulltext import phrase_frequency

    cases = [([0, 5], [1, 9], 2, 1.0), ([0], [3], 2, 1 / 3), ([0], [4], 2, 0.0), ([3], [2], 2, 1 / 3), ([1, 2], [1, 2], 2, 1 + 1 / 3), ([4], [4], 2, 0.0)]
    for a, b, slop, want in cases:
        row = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(phrase_frequency(F.col("a"), F.col("b"), slop)).first()
        assert row[0] == pytest.approx(want)
