"""Search over documents, with the items of benchmark as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cells as cl
from ..operators import fulltext as ft
from ..operators import pruned as pr
from ..operators import search as s
from ..sources.scratch import materialize
from .base import TOKEN, query

_BASE = rf"""
p AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS w FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '{TOKEN}')), 0) AS dl FROM documents),
c AS (SELECT count(*) AS n, avg(CASE WHEN dl > 0 THEN dl END) AS avgdl FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark),
q AS (SELECT item_id, term, df FROM qt JOIN f USING (term)),
h AS (SELECT item_id, doc_id, term, tf, dl, df, n, avgdl, count(*) OVER (PARTITION BY item_id, doc_id) AS matched FROM q JOIN p USING (term) JOIN l USING (doc_id) CROSS JOIN c),
k AS (SELECT item_id, count(*) AS terms FROM q GROUP BY item_id)
"""
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _hits(t):
    return s.query_hits(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text")


def _bm25(t):
    return s.match(_hits(t), "item_id", "doc_id", F.col("idf") * F.col("share"))


def _best(t, k):
    """BM25 of each item's ``k`` best documents, to 6 digits, and of some more."""
    hits = pr.top_hits(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text", k)
    return s.match(hits, "item_id", "doc_id", F.col("idf") * F.col("share")).withColumn("score", F.round("score", 6))


@query(f"WITH {_BASE}, s AS (SELECT item_id, doc_id, round(sum({_BM25}), 6) AS score FROM h GROUP BY ALL) SELECT item_id, doc_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10")
def m2_bm25_top10(t):
    """BM25 of each item's words against all documents, of which few are scored."""
    return s.top(_best(t, 10).select("item_id", "doc_id", "score"), "item_id", 10)


@query(f"""WITH {_BASE}, s AS (SELECT item_id, doc_id, any_value(matched) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)), 6) AS score FROM h GROUP BY ALL)
SELECT item_id, doc_id, matched, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s JOIN k USING (item_id) WHERE matched >= floor(terms * 0.3) WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def m1_m3_fulltext_match(t):
    """Documents with at least 30 % of an item's words, by the store's own similarity."""
    terms, held = s.query_postings(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text")
    terms = terms.withColumn("presence", s.presence_score(F.col("df"), F.col("n")))
    scored = s.match(terms.join(held, "term"), "item_id", "doc_id", F.col("presence"), 0.3)
    return s.top(scored.withColumn("score", F.round("score", 6)), "item_id", 10)


_WEIGHT = r"""CASE WHEN regexp_full_match(term, '[0-9. -]{2,}') THEN (0.3 * log10(10 + (1e7 - 3 + 0.5) / 3.5) + 0.7 * log10(10 + (1e9 - 5 + 0.5) / 5.5)) * 2
 WHEN regexp_full_match(term, '[a-z. -]+') THEN 0.3 * log10(10 + (1e7 - 300 + 0.5) / 300.5) + 0.7 * log10(10 + (1e9 - 300 + 0.5) / 300.5)
 ELSE 0.3 * log10(10 + (1e7 - 10 + 0.5) / 10.5) + 0.7 * log10(10 + (1e9 - 3 + 0.5) / 3.5) END
 * CASE WHEN regexp_full_match(term, '[0-9,.]{2,}') THEN 2 WHEN regexp_full_match(term, '[a-z]{1,2}') THEN 0.01 ELSE 1 END"""


@query(rf"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*) AS n, {_WEIGHT} AS raw FROM t GROUP BY ALL)
SELECT item_id, term, round(raw * n / sum(raw * n) OVER (PARTITION BY item_id), 9) AS weight FROM w""")
def w4_term_weights(t):
    """Each item's words with weights that sum to 1."""
    terms = t("benchmark").select("item_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    terms = terms.groupBy("item_id", "term").agg((tx.raw_term_weight(F.first("term")) * F.count(F.lit(1))).alias("raw"))
    total = F.sum("raw").over(Window.partitionBy("item_id"))
    return terms.select("item_id", "term", F.round(F.col("raw") / total, 9).alias("weight"))


def _fields():
    """A document's fields, their text and boost; the title is the first sentence."""
    return {"title": (F.regexp_extract("text", r"^[^.?!\n]*", 0), 10), "content": (F.col("text"), 2), "tag": (F.concat_ws(" ", "source", "lang"), 30)}


_FIELD_SQL = rf"""WITH d AS (SELECT doc_id, 'title' AS field, 10 AS boost, regexp_extract_all(lower(regexp_extract(text, '^[^.?!\n]*')), '{TOKEN}') AS w FROM documents UNION ALL
 SELECT doc_id, 'content', 2, regexp_extract_all(lower(text), '{TOKEN}') FROM documents UNION ALL SELECT doc_id, 'tag', 30, regexp_extract_all(lower(concat_ws(' ', source, lang)), '{TOKEN}') FROM documents),
w AS (SELECT doc_id, field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) > 0), l AS (SELECT doc_id, field, len(w) AS dl FROM d WHERE len(w) > 0), c AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY field),
p AS (SELECT doc_id, field, term, count(*) AS tf FROM w GROUP BY ALL), i AS (SELECT field, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p JOIN c USING (field) GROUP BY field, term),
qw AS (SELECT item_id, unnest(x) AS term, generate_subscripts(x, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS x FROM benchmark)),
wr AS (SELECT item_id, term, count(*) * ({_WEIGHT}) AS raw FROM qw GROUP BY item_id, term), wt AS (SELECT item_id, term AS word, raw / sum(raw) OVER (PARTITION BY item_id) AS weight FROM wr),
cl AS (SELECT item_id, word, word AS term, weight FROM wt UNION ALL SELECT item_id, word, word || 's', weight / 4 FROM wt UNION ALL SELECT item_id, word, left(word, -1), weight / 4 FROM wt WHERE length(word) > 1 AND word LIKE '%s'),
ht AS (SELECT item_id, doc_id, field, word, weight * idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM cl JOIN p USING (term) JOIN i USING (field, term) JOIN l USING (doc_id, field) JOIN c USING (field)),
ph AS (SELECT DISTINCT a.item_id, a.term AS a, b.term AS b FROM qw a JOIN qw b ON a.item_id = b.item_id AND b.pos = a.pos + 1),
pm AS (SELECT x.a, x.b, u.doc_id, u.field, u.pos, min(abs(o.o)) AS m FROM (SELECT DISTINCT a, b FROM ph) x JOIN w u ON u.term = x.a CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(o) JOIN w v ON v.doc_id = u.doc_id AND v.field = u.field AND v.pos = u.pos + 1 + o.o AND v.term = x.b WHERE o.o <> -1 GROUP BY ALL),
pf AS (SELECT a, b, doc_id, field, sum(1 / (1 + m)) AS tf FROM pm GROUP BY ALL),
hp AS (SELECT ph.item_id, pf.doc_id, pf.field, 2 * greatest(wa.weight, wb.weight) * (ia.idf + ib.idf) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM ph JOIN pf USING (a, b) JOIN l ON l.doc_id = pf.doc_id AND l.field = pf.field JOIN c ON c.field = pf.field
 JOIN wt wa ON wa.item_id = ph.item_id AND wa.word = a JOIN wt wb ON wb.item_id = ph.item_id AND wb.word = b JOIN i ia ON ia.field = pf.field AND ia.term = a JOIN i ib ON ib.field = pf.field AND ib.term = b),
s AS (SELECT item_id, doc_id, field, round(sum(s) * CASE field WHEN 'title' THEN 10 WHEN 'content' THEN 2 ELSE 30 END, 6) AS score FROM (SELECT item_id, doc_id, field, s FROM ht UNION ALL SELECT * FROM hp) GROUP BY item_id, doc_id, field),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, field) = 1),
m AS (SELECT item_id, doc_id, count(DISTINCT word) AS matched FROM ht GROUP BY ALL), k AS (SELECT item_id, count(*) AS words FROM wt GROUP BY item_id)
"""


@query(_FIELD_SQL + "SELECT item_id, doc_id, field, matched, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM b JOIN m USING (item_id, doc_id) JOIN k USING (item_id) WHERE matched >= floor(words * 0.3) WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10")
def m1_w7_best_fields(t):
    """Title, content and tag searched at once: words, their forms with and without s as synonyms, neighbouring words as phrases with two moves."""
    items = t("benchmark")
    words = items.select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    forms = F.array(F.concat("term", F.lit("s")), F.when(F.length("term") > 1, F.regexp_extract("term", "^(.*)s$", 1)))
    synonyms = words.select("term", F.explode(forms).alias("synonym")).where("synonym <> ''")
    return s.top(ft.best_fields(items, "item_id", "text", t("documents"), "doc_id", _fields(), synonyms, slop=2, least_share=0.3), "item_id", 10)


#: How many documents the first stage hands to the second: about 64, as whole pages of ten.
_WINDOW = s.rerank_window(10)
_CUT = f" QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY bm DESC, doc_id) <= {_WINDOW}"


def _sim_sql(cut=""):
    return rf"""WITH {_BASE}, w AS (SELECT item_id, term, {_WEIGHT} AS raw FROM q), tot AS (SELECT item_id, sum(raw) AS total FROM w GROUP BY item_id),
b0 AS (SELECT item_id, doc_id, round(sum({_BM25}), 6) AS bm FROM h GROUP BY ALL),
b AS (SELECT * FROM b0{cut}),
m AS (SELECT item_id, doc_id, sum(raw) AS got FROM w JOIN p USING (term) GROUP BY ALL),
x AS (SELECT item_id, doc_id, bm, got / (total + 1e-9) AS tok, min(bm) OVER (PARTITION BY item_id) AS lo, max(bm) OVER (PARTITION BY item_id) AS hi FROM b JOIN m USING (item_id, doc_id) JOIN tot USING (item_id)),
y AS (SELECT item_id, doc_id, round(tok, 6) AS term_similarity, round(CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0 END, 6) AS text_similarity FROM x),
z AS (SELECT *, round(0.7 * term_similarity + 0.3 * text_similarity, 7) AS similarity FROM y)"""


#: All pairs that share a word, and those of the first stage.
_SIM, _SIM_WINDOW = _sim_sql(), _sim_sql(_CUT)


def _window(t):
    """The first stage: each item's best documents by BM25, with their term similarity."""
    hits = pr.top_hits(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text", _WINDOW)
    both = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("share")), 6).alias("bm"), F.sum("raw").alias("got"), F.first("total").alias("total"))
    both = s.top(both, "item_id", _WINDOW, "bm").drop("rank")
    return both.select("item_id", "doc_id", "bm", F.round(F.col("got") / (F.col("total") + 1e-9), 6).alias("term_similarity"))


def _pairs(t):
    """All pairs of an item and a document that share a word, with BM25 and term similarity."""
    both = pr.all_pairs(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text")
    return both.select("item_id", "doc_id", F.round("score", 6).alias("bm"), F.round(F.col("got") / (F.col("total") + 1e-9), 6).alias("term_similarity"))


def _hybrid(t):
    """All pairs with their similarity."""
    both = s.rescale(materialize(_pairs(t), "search-scores"), "item_id", "bm", "scaled")
    both = both.select("item_id", "doc_id", "term_similarity", F.round("scaled", 6).alias("text_similarity"))
    return both.withColumn("similarity", F.round(F.col("term_similarity") * 0.7 + F.col("text_similarity") * 0.3, 7))


def _vector_sql(table, key):
    words = f"(SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS hash FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS w FROM {table}))"
    return f"(SELECT {key}, hash % 64 AS dim, sum(CASE WHEN (hash // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {words} GROUP BY ALL)"


_VEC = f""", vd AS {_vector_sql("documents", "doc_id")}, vi AS {_vector_sql("benchmark", "item_id")},
ld AS (SELECT doc_id, sqrt(sum(v * v)) AS ld FROM vd GROUP BY doc_id), li AS (SELECT item_id, sqrt(sum(v * v)) AS li FROM vi GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(vi.v * vd.v) AS d FROM z JOIN vi USING (item_id) JOIN vd USING (doc_id, dim) GROUP BY ALL),
z2 AS (SELECT item_id, doc_id, term_similarity, round(CASE WHEN li * ld > 0 AND d IS NOT NULL THEN d / (li * ld) ELSE 0 END, 6) AS vector_similarity FROM z LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN li USING (item_id) LEFT JOIN ld USING (doc_id)),
z3 AS (SELECT item_id, doc_id, term_similarity, vector_similarity, round(CASE WHEN sum(abs(vector_similarity)) OVER (PARTITION BY item_id) = 0 THEN term_similarity ELSE 0.3 * vector_similarity + 0.7 * term_similarity END, 7) AS similarity FROM z2)
"""


def _mixed(near):
    ranked = s.mix_similarity(near, "item_id", "term_similarity")
    return ranked.select("item_id", "doc_id", "term_similarity", "vector_similarity", F.round("similarity", 7).alias("similarity"))


def _retrieval(t):
    """Both stages: the window ranked by term similarity and by the cosine of the texts' hashed word vectors."""
    first = materialize(_window(t), "search-window")
    docs = t("documents").join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    near = pr.sparse_cosine(first, pr.hashed_vectors(t("benchmark"), "item_id", "text"), pr.hashed_vectors(docs, "doc_id", "text"), "item_id", "doc_id", "near")
    return _mixed(near.withColumn("vector_similarity", F.round("near", 6)))


@query(_SIM + _VEC + "SELECT item_id, doc_id, term_similarity, vector_similarity, similarity, CAST(row_number() OVER w AS INTEGER) AS rank FROM z3 WHERE similarity >= 0.2 WINDOW w AS (PARTITION BY item_id ORDER BY similarity DESC, doc_id) QUALIFY row_number() OVER w <= 10")
def m10_m11_vector_rerank(t):
    """All of each item's hits ranked by vector and term similarity."""
    first = materialize(_pairs(t).select("item_id", "doc_id", "term_similarity"), "search-scores")
    vectors = lambda table, key, name: materialize(pr.dense_vectors(pr.hashed_vectors(t(table), key, "text"), key, name), "search-vectors")
    near = pr.mixed_survivors(first, vectors("benchmark", "item_id", "a"), vectors("documents", "doc_id", "b"), "item_id", "doc_id", "term_similarity", 10)
    return s.top(_mixed(near).where("similarity >= 0.2"), "item_id", 10, "similarity")


@query(_SIM_WINDOW + _VEC + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank, count(*) OVER (PARTITION BY item_id) AS total FROM z3 WHERE similarity >= 0.2) SELECT item_id, doc_id, source, term_similarity, vector_similarity, similarity, CAST(rank AS INTEGER) AS rank, total FROM r JOIN documents USING (doc_id) WHERE rank <= 10")
def m14_hybrid_retrieval(t):
    """The flagship: a first stage by words, a second by words and vectors, a threshold, each item's first page and how many pass in the window."""
    hits = _retrieval(t).where("similarity >= 0.2").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    page = s.top(hits, "item_id", 10, "similarity")
    return page.join(t("documents").select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "source", "term_similarity", "vector_similarity", "similarity", "rank", "total")


@query(_SIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank, count(*) OVER (PARTITION BY item_id) AS total FROM z WHERE similarity >= 0.2) SELECT item_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank, total FROM r WHERE rank BETWEEN 6 AND 10")
def m14_second_page(t):
    """The second page of five, with how many documents pass the threshold."""
    hits = _hybrid(t).where("similarity >= 0.2")
    totals = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    return s.top(hits, "item_id", 5, "similarity", page=2).join(totals, "item_id").select("item_id", "doc_id", "similarity", "rank", "total")


@query(_SIM + ", r AS (SELECT item_id, doc_id FROM z WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) <= 10) SELECT item_id, source, count(*) AS hits FROM r JOIN documents USING (doc_id) GROUP BY ALL")
def a1_page_facets(t):
    """How many of each item's first page come from each source."""
    page = s.top(_hybrid(t).where("similarity >= 0.2"), "item_id", 10, "similarity")
    return s.facets(page.join(t("documents").select("doc_id", "source"), "doc_id"), "item_id", "source")


@query(_SIM + """, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM z),
u AS (SELECT item_id, doc_id, rank, dl, sum(dl) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM r JOIN l USING (doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, dl AS tokens, CAST(used AS BIGINT) AS used FROM u WHERE used - dl <= 2000 * 0.97""")
def m26_prompt_packing(t):
    """As many of each item's first hits as a budget of 2000 words holds."""
    page = s.top(_hybrid(t), "item_id", 10, "similarity")
    sized = t("documents").select("doc_id", tx.token_total(F.col("text")).alias("tokens"))
    return s.pack_budget(page.join(sized, "doc_id").select("item_id", "doc_id", "rank", "tokens"), "item_id", "rank", "tokens", 2000)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, v.vec_id, round(list_inner_product(qe::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(qe::DOUBLE[], qe::DOUBLE[]) * list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS similarity FROM q JOIN embeddings v ON q.label = v.label AND query_id <> v.vec_id)
SELECT query_id, vec_id, similarity, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WHERE similarity >= 0.1 WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def m4_dense_match(t):
    """Cosine neighbours within a filter (the label), with a floor, through a cell index."""
    v = t("embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = cl.neighbours(asked, v, "query_id", "vec_id", "embedding", 5, "label", 0.1)
    return s.top(found, "query_id", 5, "similarity", "vec_id")


@query(f"WITH {_BASE}, b AS (SELECT item_id, doc_id, sum({_BM25}) AS bm FROM h GROUP BY ALL), s AS (SELECT item_id, doc_id, round(0.05 * bm + coalesce(quality, 0) * 10.0 - coalesce(toxic, 0), 6) AS score FROM b LEFT JOIN labels USING (doc_id)) SELECT item_id, doc_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10")
def m5_m6_fusion_with_features(t):
    """Text scores fused with static rank features of the documents."""
    scored = _bm25(t).join(t("labels"), "doc_id", "left")
    feature = F.coalesce(F.col("quality"), F.lit(0)) * 10.0 - F.coalesce(F.col("toxic"), F.lit(0))
    scored = scored.select("item_id", "doc_id", F.round(F.col("score") * 0.05 + feature, 6).alias("score"))
    return s.top(scored, "item_id", 10)


@query(f"WITH {_BASE}, s AS (SELECT item_id, doc_id, round(sum({_BM25}), 6) AS score FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS top1, max(CASE WHEN rank = 2 THEN score END) AS top2, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS gap, round(avg(CASE WHEN rank <= 3 THEN score END), 6) AS mean3, CASE WHEN max(CASE WHEN rank = 1 THEN score END) < 5 THEN 'none' WHEN max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) >= 1 THEN 'single' ELSE 'gallery' END AS mode FROM r GROUP BY item_id")
def m23_wn8_answer_gate(t):
    """Whether an item has one clear hit, several or none: from its best scores, their gap and mean."""
    ranked = s.top(_best(t, 3).select("item_id", "doc_id", "score"), "item_id", 3)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    g = ranked.groupBy("item_id").agg(at(1).alias("top1"), at(2).alias("top2"), F.round(F.avg("score"), 6).alias("mean3"))
    g = g.withColumn("gap", F.round(F.col("top1") - F.col("top2"), 6))
    return g.withColumn("mode", F.when(F.col("top1") < 5, "none").when(F.col("top1") - F.col("top2") >= 1, "single").otherwise("gallery"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[.?!;\n]'), lambda s: regexp_matches(s, '(?i)licen[cs]ed?')), lambda s: regexp_replace(trim(s), '((?i)licen[cs]ed?)', '<em>\1</em>', 'g')), '...') AS highlight FROM documents WHERE regexp_matches(text, '(?i)licen[cs]ed?')""")
def m15_highlight(t):
    """Sentences about licences with the word marked."""
    docs = t("documents").where(F.col("text").rlike("(?i)licen[cs]ed?"))
    return docs.select("doc_id", tx.highlight(F.col("text"), "(?i)licen[cs]ed?").alias("highlight"))


@query("SELECT source, lang, count(*) AS n, round((count(*) + 1) / ((SELECT count(*) FROM documents) + 1000), 9) AS prior FROM documents GROUP BY ALL")
def m18_tag_priors(t):
    docs = t("documents")
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("prior", F.round((F.col("n") + 1) / (total + 1000), 9))


@query("""WITH d AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), s AS (SELECT source, sum(c) AS cnt FROM d GROUP BY source),
p AS (SELECT lang, (sum(c) + 1) / ((SELECT count(*) FROM documents) + 1000) AS prior FROM d GROUP BY lang),
x AS (SELECT source, lang, CAST(round_even(10 * (c + 1) / (cnt + 1000) / greatest(1e-6, prior), 0) AS BIGINT) AS score FROM d JOIN s USING (source) JOIN p USING (lang))
SELECT source, lang, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, lang) <= 3""")
def m19_tag_scores(t):
    """Each source's most telling languages against their prior, rounded to even."""
    d = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    of, whole = Window.partitionBy("source"), Window.partitionBy()
    prior = (F.sum("c").over(Window.partitionBy("lang")) + 1) / (F.sum("c").over(whole) + 1000)
    score = F.lit(10) * (F.col("c") + 1) / (F.sum("c").over(of) + 1000) / F.greatest(F.lit(1e-6), prior)
    x = d.withColumn("score", F.bround(score, 0).cast("long")).where("score > 0").select("source", "lang", "score")
    return x.withColumn("at", F.row_number().over(of.orderBy(F.desc("score"), "lang"))).where("at <= 3").drop("at")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) BETWEEN 11 AND 20")
def m8_m28_filtered_listing(t):
    """No question: the second page of ten of each wanted source, longest first."""
    from ..operators.store import condition

    docs = t("documents")
    rows = docs.where(condition(docs, {"source": ["src1", "src2"], "lang": "en", "text": ""})).select("doc_id", "source", "lang", "n_chars")
    return s.top(rows, "source", 10, "n_chars", page=2).drop("rank")
