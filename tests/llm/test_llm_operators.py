"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spindrift.llm")
from spindrift.llm import bpe, fingerprint, html_extract, langid, licenses, mixing, neardup, sharding, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, key string, h1 long, comp string"
#: Null and empty texts and ids, a repeated row, one word, white space alone, a long text, columns named like inner ones.
ODD = [
    (1, None, "a", "k", 1, "c"),
    (2, "", "a", "k", 1, "c"),
    (3, " \n\t", None, "k", 1, "c"),
    (4, "word", "b", "k", 1, "c"),
    (4, "word", "b", "k", 1, "c"),
    (5, "long " * 30000, "b", "k", 1, "c"),
    (None, "no id at all here now", None, "k", 1, "c"),
    (6, "ÀÉ ß 漢字 \U0001f642 x", "c", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# op1


def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q is not None and q % 100 == 0 and v is not None:
            best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i is not None and i != q and w is not None)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_matches_brute_force_with_ties_and_sparse_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [int(x) for x in rng.integers(-3, 4, 6) * (rng.random(6) < 0.6)]) for i in range(700)]
    vectors += [(None, [1] * 6), (800, None)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = topk.top_k(df.where("vec_id % 100 = 0"), df)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, 10)


@pytest.mark.parametrize(("shard", "block", "stride", "seeds"), [(64, 2, 7, 40), (100, 3, 16, 5)])
def test_topk_over_many_shards_blocks_and_strides(spark, monkeypatch, shard, block, stride, seeds):
    rng = np.random.default_rng(5)
    vectors = [(i, [int(x) for x in rng.integers(-3, 4, int(rng.integers(0, 8)))]) for i in range(900)]
    vectors += [(i, [2] * 5) for i in (7, 7, 100, 300)]
    vectors = [v for v in vectors if v[0] not in (100, 300)] + [(100, [2] * 5), (300, [2] * 5)]
    for name, value in (("SHARD", shard), ("BLOCK", block), ("STRIDE", stride), ("SEEDS", seeds)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").withColumn("floor", F.lit("x")).withColumn("shard", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 100 = 0"), df).collect()))
    padded = [(i, v + [0] * (8 - len(v))) for i, v in vectors]
    assert got == brute_top(padded, 10)


def test_topk_skips_vectors_that_are_not_finite(spark):
    rows = [(0, [1.0, 0.5]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [0.25, -0.1]), (4, None), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.floored(F.col("embedding")).alias("v"))
    got = [tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df).collect()]
    assert got == [(0, 1, 3, 1024 * 256 + 512 * math.floor(1024 * -0.1))]
    assert topk.top_k(df.where("vec_id = 99"), df.where("vec_id = 99")).count() == 0


# op2


def test_licenses_own_inherited_and_none(spark):
    files = [
        (1, "p/LICENSE", "intro\nReleased under the MIT License.\nmore words"),
        (2, "p/a/x.py", "code only"),
        (3, "p/a/b/y.py", "Licensed under the Apache License, Version 2.0"),
        (4, "q/z.py", "no licence at all"),
        (5, "p/a/LICENSE", "All rights reserved."),
        (6, "p/a/b/c/w.py", None),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "top.py", ""),
    ]
    df = spark.createDataFrame(files + files[1:2], "file_id long, path string, text string").withColumn("dir", F.lit(0)).withColumn("uid", F.lit(0))
    got = sorted((r["file_id"], r["license"], r["origin"], r["from_path"]) for r in licenses.scan(df).collect())
    assert got == [
        (1, "MIT", "own", None),
        (2, "Proprietary", "inherited", "p/a/LICENSE"),
        (2, "Proprietary", "inherited", "p/a/LICENSE"),
        (3, "Apache-2.0", "own", None),
        (4, None, "none", None),
        (5, "Proprietary", "own", None),
        (6, "Proprietary", "inherited", "p/a/LICENSE"),
        (7, "CC-BY-NC", "own", None),
        (8, None, "none", None),
    ]
    assert licenses.scan(df.where("file_id < 0")).count() == 0


def test_license_anchors_lose_no_match():
    rows, idf, other = licenses.template_terms()
    words = set(licenses.anchors(rows))
    for number in range(len(licenses.TEMPLATES)):
        assert sum(w * w for n, t, w in rows if n == number and t not in words) < licenses.COSINE**2
    pattern = re.compile(licenses._branch(sorted(words)))
    assert all(pattern.fullmatch(w) for w in words) and not pattern.fullmatch("licens")


def test_license_texts_headers_tags_and_ties(spark):
    mit = "\n\n".join(["MIT License", "Copyright (c) 2021 Foo", licenses._MIT_GRANT, licenses._MIT_NOTICE, licenses._MIT_WARRANTY])
    bsd = ["Copyright (c) 2020, Foo", licenses._BSD_START, licenses._BSD_TWO, licenses._BSD_NAME, licenses._BSD_WARRANTY]
    files = [
        (1, "a/LICENSE", mit.split("\n", 2)[2]),
        (2, "b/x.py", "# " + mit.split("\n\n", 1)[1].replace("\n", "\n# ")),
        (3, "c/x.c", "// SPDX-License-Identifier: MIT\nint x;"),
        (4, "c/y.c", "/* SPDX-License-Identifier: Apache-2.0 */"),
        (5, "c/z.c", "SPDX-License-Identifier: WTFPL"),
        (6, "d/LICENSE", "\n\n".join(bsd)),
        (7, "e/LICENSE", "\n\n".join(bsd[:3] + bsd[4:])),
        (8, "f/k.py", "Copyright (c) 2021 Foo Inc. All rights reserved."),
        (9, "f/q.py", "the general public version of this software is free"),
        (10, "g/COPYING", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n" + "terms and conditions for use " * 400),
        (11, "h/n.c", "word " * 60000 + "\n/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ]
    got = {r["file_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "Apache-2.0", 5: None, 6: "BSD-3-Clause", 7: "BSD-2-Clause", 8: "Proprietary", 9: None, 10: "Apache-2.0", 11: "GPL"}


# op3


def test_restoring_obfuscated_words(spark, docs):
    text = "you idiot and moron and loser and stupid clown pathetic trash scum worthless disgusting " * 20
    model = toxicity.language_model(docs.select("text").unionByName(spark.createDataFrame([(text,)], "text string")))
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("l0ooooser", "loser"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("cl-0-wn", "clown")):
        assert toxicity.restore(token, model) == word
    df = spark.createDataFrame([(1, "such an i d i o t"), (2, "a 1d10t, yes"), (3, None), (4, "plain words")], "doc_id long, text string")
    found = {r["doc_id"]: r["restored"] for r in toxicity.restored_words(df, model).collect()}
    assert found == {1: "idiot", 2: "idiot"}


def test_toxicity_held_out_and_odd_rows(spark, odd, none):
    half = [a + b + c for a in "bdfgk" for b in "aeu" for c in "lnrs"]
    words = [a + b for a in half for b in half]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bag = list(rng.choice(words, 25))
        if i % 4 == 0:
            bag[5] = ["idiot", "moron", "1d10t"][i // 4 % 3]
        rows.append((i, " ".join(map(str, bag))))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    lm = toxicity.language_model(docs)
    again = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id = 1").select("doc_id", F.lit("another text").alias("text")))
    model = toxicity.fit(again, marks.where(~toxicity.held_out(F.col("doc_id"))), lm)  # labelled ids that repeat
    got = by_id(toxicity.score_documents(docs, lm, model))
    assert all(got[i]["predicted"] == t for i, t in labels)
    scores = toxicity.score_documents(odd, lm, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] < 0.5 for r in scores)
    assert toxicity.score_documents(none, lm, model).count() == 0
    blank = toxicity.fit(docs, marks.where("false"), lm)
    assert {r["predicted"] for r in toxicity.score_documents(docs, lm, blank).collect()} == {0}


def test_spaced_words_end_where_the_model_says(spark, docs):
    text = "you idiot and you are such a moron and a loser quel crétin du bist blöd " * 40
    model = toxicity.language_model(docs.select("text").unionByName(spark.createDataFrame([(text,)], "text string")))
    rows = [(1, "such a m o r o n"), (2, "y o u i d i o t"), (3, "quel c r é t i n"), (4, "du bist b l ö d"), (5, "a — b — c"), (6, "a l o o o s e r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["restored"] for r in toxicity.restored_words(df, model).collect()}
    assert found == {1: "a moron", 2: "you idiot", 3: "crétin", 4: "blöd", 6: "a loser"}


# op4


def test_bpe_equals_the_library_and_round_trips(spark, odd, none):
    import base64

    import tiktoken

    path, pat = bpe.public_tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    df = odd.withColumn("ids", F.lit(1))
    ids = bpe.encode(df, path, pat)
    want = collections.Counter(np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes() for r in ODD)
    assert collections.Counter(bytes(r["ids"]) for r in ids.collect()) == want
    assert collections.Counter(bytes(r["decoded"]).decode() for r in bpe.decode(ids, path).collect()) == collections.Counter(r[1] or "" for r in ODD)
    digest = by_id(bpe.digests(df.where("doc_id = 6"), path, pat))[6]
    assert digest["decoded_sha256"] == hashlib.sha256(ODD[-1][1].encode()).hexdigest()
    assert bpe.digests(none, path, pat).count() == 0


def test_bpe_of_a_long_word_and_many_blocks(spark, monkeypatch):
    import base64
    import random

    import tiktoken

    path, pat = bpe.public_tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    word = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    assert bpe.Ranks.load(path).decode(np.frombuffer(bpe.Ranks.load(path).replay([word.encode()])[0], "<u4")).decode() == word
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    rows = [(i, " ".join(random.choices(["tokens", "of", word[i : i + 9], word[7:2000]], k=12))) for i in range(40)]
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pat).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_bpe_fuzz_against_the_library():
    import base64
    import random

    import regex
    import tiktoken

    path, pat = bpe.public_tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library, ours = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={}), bpe.Ranks.load(path)
    random.seed(5)
    letters = [*"ab  \n\t\x1c\x1d\x85\xa0 　éß漢字\U0001f642'sTt19%$..aaaa", "a" * 16, "   ", "\r\n"]
    for _ in range(800):
        text = "".join(random.choices(letters, k=random.randint(1, 60)))
        words = regex.findall(bpe.pattern(pat), text)
        assert np.frombuffer(b"".join(ours.replay([w.encode() for w in words])), "<u4").tolist() == library.encode_ordinary(text)


# op5


def test_sharding_moves_only_into_the_new_shard(docs, odd, none):
    rows = sharding.shard_documents(docs, 24).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == docs.count()
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == len(ODD) and len({r["shard"] for r in got if r["doc_id"] == 4}) == 1
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in ODD)
    assert sharding.shard_documents(none, 3).count() == 0


# op6


def word_sets(rows):
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        yield i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = list(word_sets(rows))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}, {i: len(s) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(120).collect()]
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"b{i}" for i in range(120)]
    for i in range(60):  # near copies of near copies, and texts around one passage
        copy = list(base)
        for j in rng.integers(0, 120, 3):
            copy[j] = f"e{i}x{j}"
        rows.append((10_000 + i, " ".join(copy)))
        rows.append((20_000 + i, passage + " " + " ".join(f"u{i}y{j}" for j in range(int(rng.integers(5, 60))))))
    rows += [(30_000, "one two"), (30_001, "One  TWO"), (30_002, ""), (30_003, None), (30_004, "")]
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    components, sizes = brute_components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == components
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == components[i]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in rows) and [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_two_that_no_head_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEADS", 0)  # as if both had been paired with other heads
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:99], "other"])), (3, "quite another text of a few words")]
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3}


# op7


def test_extraction_cuts_what_is_not_the_article(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>site</header><nav><ul><li><a href=x>m</a></li></ul></nav><!-- <p>no</p> -->"
        "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>First<br>line  of\n text<p>Second &lt;b&gt;<div class='comments'><p>nice</p></div>"
        "<form>mail</form><script>var t='</p>';</script></article><aside>more</aside><footer>&copy;"
    )
    rows = [(1, "http://a.b/c", page), (2, "http://a.b/d", None), (3, None, ""), (1, "http://a.b/c", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("low", F.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    text = "Head & line\nFirst line of text\nSecond <b>"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]
    assert html_extract.extract(df.where("page_id < 0")).count() == 0


def test_style_tree_cuts_repeated_branches_of_pages_without_an_article(spark):
    rows = [(i, "http://h.x/p", f"<body><div class=top><p>Same words on each page</p></div><div class=text><p>Story {i} of {i * 7}</p></div></body>") for i in range(12)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Story {i} of {i * 7}" for i in range(12)}


def test_style_tree_cuts_inside_articles_and_on_small_hosts(spark):
    def page(i):
        notice = "<div class=box><p>Same words on each page</p></div>"
        return f"<body><article><h1>Head {i}</h1>{notice}<p>Story {i} of {i * 7}</p></article><article class=related><p>Other {i}</p></article></body>"

    rows = [(i, "http://big.x/p", page(i)) for i in range(12)] + [(i, f"http://h{i}.x/p", page(i)) for i in range(12, 16)]
    rows += [(i, "http://copies.x/p", "<body><main class=only><p>One text</p></main></body>") for i in range(20, 30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nStory {i} of {i * 7}" for i in range(16)} | {i: "One text" for i in range(20, 30)}


def test_large_and_small_hosts_and_names_inside_articles(spark):
    body = "<body><article><h1>Head {0}</h1><div class='market-share'><p>Share {0}</p></div><div class='share'><p>Send {0}</p></div><div class=box><p>Same</p></div></article>"
    rows = [(i, f"http://{'big' if i < 30 else 'h' + str(i)}.x/p", body.format(i)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nShare {i}" for i in range(40)}


def random_page(rng, depth=0):
    """Nested sections with words; some parts repeat, some are an article or named noise."""
    if depth == 3 or rng.random() < 0.4:
        return f"<p>{rng.choice(['same', 'word', 'text'])} {rng.randrange(4)}</p>"
    name = rng.choice(["div", "div class=a", "section", "article", "nav", "div class=share"])
    return f"<{name}>{''.join(random_page(rng, depth + 1) for _ in range(rng.randrange(1, 4)))}</{name.split()[0]}>"


def plain_trees(pages):
    """The style nodes of (host, html) rows, node by node in plain Python."""
    shown = collections.defaultdict(collections.Counter)
    main = collections.defaultdict(int)
    for host, page in pages:
        found, styles = html_extract.blocks(page)
        for path, inside, children in styles:
            shown[host, path, "P"][children] += 1
            main[host, path] = max(main[host, path], inside)
        for path, _, said in found:
            shown[host, path, "C"][said] += 1

    def entropy(counts):
        m = sum(counts.values())
        return (-sum(n / m * math.log(n / m) for n in counts.values()) / math.log(m) if m > 1 else 1.0), m

    pool = collections.defaultdict(collections.Counter)
    for (_, path, kind), counts in shown.items():
        pool[path, kind].update(counts)
    h = {}
    for (host, path, kind), counts in shown.items():
        own, m = entropy(counts)
        all_, n = entropy(pool[path, kind])
        all_ = ((n - 1) * all_ + 2) / (n - 1 + 2)
        h[host, path, kind] = ((m - 1) * own + 16 * all_) / (m - 1 + 16), m
    out = {}
    for host, path in main:
        below = [k for k in h if k[0] == host and (k[1] + "/").startswith(path + "/")]
        words = [h[k] for k in below if k[2] == "C"]
        out[host, path] = (
            max(h[k][0] for k in below if k[2] == "P"),
            h[host, path, "P"][0],
            sum(e * m for e, m in words) / sum(m for _, m in words) if words else None,
            any(main[k[:2]] for k in below if k[2] == "P"),
            main[host, path] == 2,
        )
    return out


def plain_low(trees):
    """The low branches, branch by branch."""
    low = {}
    for (host, path), (form, _, words, holds, inside) in trees.items():
        if not path:
            continue
        parent = path.rsplit("/", 1)[0]
        family = [v for (at, p), v in trees.items() if at == host and p and p.rsplit("/", 1)[0] == parent]
        best, most = max(v[0] for v in family), max((v[2] for v in family if v[2] is not None), default=None)
        if words is not None and words < 0.2 * most and (inside or not holds):
            low[host, path] = "words"
        elif trees[host, parent][1] < 0.5 * best and form < 0.5 * best and not holds and not inside:
            low[host, path] = "form"
    return low


def test_style_trees_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, f"http://{rng.choice('aab')}.x/{i}", "".join(random_page(rng) for _ in range(rng.randrange(5)))) for i in range(120)]
    rows += [(200 + i, "http://c.x/", "<div class=box><p>Same words</p></div><div class=text>" + f"<p>Story {i}</p>" * (i % 7) + "</div>") for i in range(40)]
    rows += [(300 + i, "http://d.x/", f"<body><div class=menu><p>Go {i}</p></div><div class=text>" + f"<p>Tale {i}</p>" * (i % 7) + "</div></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = html_extract.parsed(df).cache()
    trees = html_extract.style_trees(pages).cache()
    plain = plain_trees([(url.split("/")[2], page) for _, url, page in rows])
    got = {(r["host"], r["path"]): r for r in trees.collect()}
    assert got.keys() == plain.keys()
    for key, want in plain.items():
        have = got[key]
        assert [have["form"], have["own"]] == pytest.approx(want[:2]) and (have["holds"], have["inside"]) == want[3:]
        assert (have["words"] is None) == (want[2] is None) and (want[2] is None or have["words"] == pytest.approx(want[2]))
    low = html_extract.low_branches(trees)
    cut = plain_low(plain)
    assert {(r["host"], r["path"]): r["why"] for r in low.collect()} == cut and set(cut.values()) == {"form", "words"}

    def text(host, page):
        found = [(p, said) for p, noise, said in html_extract.blocks(page)[0] if not noise]
        kept = [said for p, said in found if not any((host, "/".join(p.split("/")[:n])) in cut for n in range(2, p.count("/") + 2))]
        return "\n".join(kept or [said for _, said in found])

    want = {i: text(url.split("/")[2], page) for i, url, page in rows}
    for limit in (html_extract.LOOKUP, 0):  # cuts sent to the tasks, and joined by key
        monkeypatch.setattr(html_extract, "LOOKUP", limit)
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == want


def test_tree_without_names_tells_the_article_from_menus_and_adverts(spark):
    def page(i):
        menu = "".join(f"<li>Item {i + j}</li>" for j in range(6))
        story = "".join(f"<p>Part {i} {j}</p>" for j in range(1 + i * 5 % 13))
        return f"<body><div class=u><ul>{menu}</ul></div><div class=v>Buy {i}</div><div class=w><h1>Head {i}</h1>{story}</div><div class=x>End {i}</div></body>"

    got = html_extract.extract(spark.createDataFrame([(i, "http://h.x/p", page(i)) for i in range(30)], "page_id long, url string, html string"))
    want = {i: "\n".join([f"Head {i}", *(f"Part {i} {j}" for j in range(1 + i * 5 % 13))]) for i in range(30)}
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_names_inside_an_article_that_only_begin_like_noise_stay(spark):
    page = (
        "<article><h1>Head</h1><section class='related-work'><p>Earlier papers</p></section><div class='search-results'><p>Found</p></div>"
        "<div class='related-posts'><p>More</p></div><div class='comment-list'><p>Nice</p></div><div class='comments'><p>Yes</p></div></article>"
    )
    got = html_extract.extract(spark.createDataFrame([(1, "http://h.x/p", page)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["Head\nEarlier papers\nFound"]


# op8


def test_mixing_meets_targets(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix_sources(df).collect()
        assert len(got) == df.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(3)).collect()))
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        total = sum(r["size"] for r in got)
        assert sum(r["taken"] for r in got) == pytest.approx(1.5 * total, abs=30)
    sizes = {"a": 100, "b": 1000, "c": 1000}
    rows = odd.sparkSession.createDataFrame(list(sizes.items()), "source string, source_size long")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    left = 3150 - 200
    assert targets == pytest.approx({"a": 200, "b": left * 2 / 3, "c": left / 3})
    assert mixing.mix_sources(none).count() == 0


# op9


def bag(text):
    w = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    return collections.Counter(zip([""] + w, w + [None], strict=True))


def test_fingerprints_estimate_generalised_jaccard(docs, odd, none):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    got, gaps = by_id(fingerprint.fingerprints(docs)), []
    for n, i in enumerate(ids):
        text, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        a, b = bag(text), bag(edited)
        gaps.append(got[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.01 and np.mean(np.abs(gaps)) < 0.06
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    four = [r for r in rows if r["doc_id"] == 4]  # a repeated row follows on itself
    assert sorted(r["near_next"] == 1.0 for r in four) == [False, True]
    assert {r["edited_sha256"] for r in four} == {hashlib.sha256(b"wowo").hexdigest(), hashlib.sha256(b"wolo").hexdigest()}
    assert fingerprint.fingerprints(none).count() == 0
    assert [r["near_next"] for r in fingerprint.fingerprints(odd.where("doc_id = 6")).collect()] == [1.0]


def test_fingerprints_of_short_texts_are_unbiased(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 50)  # several ranges of keys
    monkeypatch.setattr(fingerprint, "PARTITION_BYTES", 1000)
    rng = np.random.default_rng(8)
    rows = [(int(i) - 300, " ".join(rng.choice(["ab", "cd", "ef", "gh"], int(rng.integers(1, 7))))) for i in rng.permutation(600)]
    got, gaps = by_id(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))), []
    rows.sort()
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        a, b = bag(text), bag(after)
        gaps.append(got[i]["near_next"] - sum((a & b).values()) / sum((a | b).values()))
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()
    assert abs(np.mean(gaps)) < 0.01


_M64, _P = (1 << 64) - 1, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def xxh64(x, seed, size):
    """XXH64 of an integer of 4 or 8 bytes."""
    turn = lambda v, n: ((v << n) | (v >> (64 - n))) & _M64
    v = (seed + _P[4] + size) & _M64
    if size == 8:
        v = (turn(v ^ (turn(x * _P[1] & _M64, 31) * _P[0] & _M64), 27) * _P[0] + _P[3]) & _M64
    else:
        v = (turn(v ^ (x * _P[0] & _M64), 23) * _P[1] + _P[2]) & _M64
    v = (v ^ (v >> 33)) * _P[1] & _M64
    v = (v ^ (v >> 29)) * _P[2] & _M64
    return v ^ (v >> 32)


def plain_score(term, k, w):
    """(score, mark) of one term of weight ``w`` in one coordinate."""
    h = xxh64(k, xxh64(term, 42, 8), 4)
    g = xxh64(h, 42, 8)
    u1, u2 = ((x >> 32) + 0.5 for x in (g, h))
    v3, v4 = (((h >> at & 0xFFFF) << 16 | g >> at & 0xFFFF) + 0.5 for at in (16, 0))
    r, c = -math.log(u1 * u2 / 2**64), -math.log((1 - v3 / 2**32) * (1 - v4 / 2**32))
    b = -math.log(u1 / 2**32) / r
    t = math.floor(math.log(w) / r + b)
    return c * math.exp(-r * (t - b + 1)), (g + t) & 0xFFFF


def plain_fingerprint(terms):
    least = (min((int(s**0.25 * 2**29), mark) for s, mark in (plain_score(term, k, w) for term, w in terms.items())) for k in range(fingerprint.COORDINATES))
    return "".join(f"{mark:04X}" for _, mark in least)


@pytest.fixture(scope="module")
def varied(spark):
    rng = random.Random(5)
    sizes = [(1500, 3000), (900, 12), (1, 5), (30, 3), (400, 40), (0, 1), (64, 500), (1200, 1)]  # words, and how many are different
    rows = [(i, " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))) for i, (n, kinds) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def terms_of(df, text):
    """Counted terms by doc_id."""
    marked = fingerprint.with_terms(df, text, "x", 0).collect()
    return {r["doc_id"]: collections.Counter((x & _M64) >> 1 for x in r["x"]) for r in marked}


def test_fingerprints_equal_plain_sampling_of_all_terms(spark, varied):
    texts = [r["text"] for r in varied.orderBy("doc_id").collect()]
    edited = [(i, t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]) for i, t in enumerate(texts)]
    own, other = terms_of(varied, "text"), terms_of(spark.createDataFrame(edited, "doc_id long, text string"), "text")
    for i, r in by_id(fingerprint.fingerprints(varied)).items():
        assert r["fingerprint"] == plain_fingerprint(own[i]) and r["edited_fingerprint"] == plain_fingerprint(other[i])


def test_coordinates_without_a_sample_below_the_limit_are_drawn_from_all_terms(varied, monkeypatch):
    rows = lambda: sorted(fingerprint.fingerprints(varied).collect())
    usual = rows()
    for enough in (0.5, 3.0, 1e9):  # most coordinates have no sample below; one in 20; no term waits
        monkeypatch.setattr(fingerprint, "ENOUGH", enough)
        assert rows() == usual


def test_few_terms_are_scored_and_none_is_missed(spark, varied):
    terms = terms_of(varied, "text")
    totals = {i: sum(c.values()) for i, c in terms.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flat = [(i, signed(term), w, totals[i]) for i, c in terms.items() for term, w in c.items()]
    weighted = spark.createDataFrame(flat, "doc_id long, term long, w long, n long")
    kept = {(r["doc_id"], r["term"], r["k"]) for r in fingerprint.drawn(weighted, ["w"], ["n"]).collect()}
    for i, term, w, n in flat:
        for k in range(fingerprint.COORDINATES):
            assert (i, term, k) in kept or plain_score(term & _M64, k, w)[0] >= fingerprint.ENOUGH / n
    assert sum(i == 0 for i, _, _ in kept) < 0.05 * len(terms[0]) * fingerprint.COORDINATES
    assert fingerprint.drawn(weighted, ["w"]).count() == len(flat) * fingerprint.COORDINATES


# op10


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    counts, moves = np.array([70, 0, 1, 64, 3]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(counts.sum(), 3)) * 2
    post, joint = langid.chain(scores, counts, moves, pairs=True)
    at, total = 0, np.zeros((3, 3))
    for n in counts:
        e, m = np.exp(scores[at : at + n]), np.exp(moves)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            a[t] = e[t] if t == 0 else (a[t - 1] @ m) * e[t]
        for t in range(n - 2, -1, -1):
            b[t] = m @ (e[t + 1] * b[t + 1])
        if n:
            assert np.allclose(post[at : at + n], a * b / (a * b).sum(1, keepdims=True))
        for t in range(1, n):
            x = a[t - 1][:, None] * m * (e[t] * b[t])[None]
            total += x / x.sum()
        at += n
    assert np.allclose(joint, total)


def test_language_held_out_and_odd_rows(spark, docs, odd, none):
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out(F.col("doc_id")))
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    mixed = spark.createDataFrame([(1, "the and thing with that ation of the and " * 8 + "der die ungheit keit schen einung und lichkeit " * 8)], "doc_id long, text string")
    counted = langid.predict(mixed, model).first()["word_langs"]
    assert counted["en"] > 20 and counted["de"] > 20
    assert langid.predict(none, model).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "ÉTÉ ŁÓDŹ Москва")], "doc_id long, text string"), model).first()["word_langs"]
    blank = langid.fit(docs.select("doc_id", "text", "lang").where("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, blank).collect()} == {"und"}


def test_languages_many_labels_and_long_documents_only(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(70):
        words = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 2500 if k == 69 else 25)), f"l{k:02d}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.unionByName(docs.where("doc_id < 200")), F.col("doc_id") % 4 > 0)
    assert len(model[0]) == 70
    found = langid.predict(docs.where("doc_id % 4 = 0"), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert {r["lang_pred"] for r in found if r["lang"] == "l69"} == {"l69"}


def test_transitions_between_labels_are_learned(spark, docs):
    model = langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    off = model[2][~np.eye(len(model[0]), dtype=bool)]
    assert len(set(np.round(off, 6))) > 1 and off.min() > -3
