"""Graph rebuilding, folder trees, citations, tags of questions, chunk methods, lookups with a lifetime."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import citations as ci
from ..functions import evaluation as ev
from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import search as s
from ..operators import store, subgraph, trees
from .base import TOKEN, query
from .chunks import _SECTIONS
from .retrieval import _BASE, _hits


def _n():
    return F.count(F.lit(1))


# Each order is a document, its lines are relations of parts and suppliers; a returned line has no description.
_FOUND = """l AS (SELECT l_orderkey AS doc, 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_quantity AS weight, nullif(l_returnflag, 'R') AS description, CASE WHEN l_linestatus = 'O' THEN l_shipyear END AS keyword
 FROM (SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS l_shipyear FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
nd AS (SELECT DISTINCT doc, s AS id, description FROM l WHERE description IS NOT NULL UNION SELECT DISTINCT doc, p, description FROM l WHERE description IS NOT NULL),
e AS (SELECT p AS src, s AS tgt, doc, weight, description, keyword FROM l WHERE description IS NOT NULL)"""


def _rebuilt(t):
    lines = t("lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.concat(F.lit("s"), "l_suppkey").alias("src"),
        F.concat(F.lit("p"), "l_partkey").alias("tgt"),
        F.col("l_quantity").alias("weight"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("description"),
        F.when(F.col("l_linestatus") == "O", F.array(F.year("l_shipdate").cast("string"))).alias("keywords"),
    )
    nodes = lines.select("doc", F.explode(F.array("src", "tgt")).alias("id"), "description").distinct()
    pending = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc"))
    return subgraph.rebuild(nodes, lines, pending)


@query(f"WITH {_FOUND} SELECT src, tgt, round(sum(weight), 4) AS weight, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, coalesce(string_agg(DISTINCT keyword, ',' ORDER BY keyword), '') AS keywords, count(DISTINCT doc) AS sources FROM e GROUP BY src, tgt")
def g3_g5_rebuilt_edges(t):
    """Relations of all orders but the pending ones, tidied and merged: weights, descriptions, keywords, orders."""
    edges = _rebuilt(t)[1]
    return edges.select("src", "tgt", F.round("weight", 4).alias("weight"), "description", F.array_join("keywords", ",").alias("keywords"), "sources")


@query(f"""WITH {_FOUND}, d AS (SELECT id, count(*) AS rank FROM (SELECT DISTINCT src, tgt, src AS id FROM e UNION ALL SELECT DISTINCT src, tgt, tgt FROM e) GROUP BY id)
SELECT id, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT doc) AS sources, any_value(rank) AS rank FROM nd JOIN d USING (id) GROUP BY id""")
def g4_rebuilt_nodes(t):
    """The nodes of the rebuilt graph with their number of edges."""
    return _rebuilt(t)[0]


_STEPS = "string_split(rtrim(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), '/')"


@query(f"""WITH p AS (SELECT {_STEPS} AS st, length(html) AS size FROM pages), n AS (SELECT array_to_string(list_slice(st, 1, k), '/') AS id, size FROM (SELECT st, size, unnest(range(1, len(st) + 1)) AS k FROM p))
SELECT id, count(*) AS items, CAST(sum(size) AS BIGINT) AS total FROM n GROUP BY id""")
def g18_folder_totals(t):
    """Each folder of the pages' addresses with the pages under it and their size, over the whole depth."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    pages = t("pages").select(F.regexp_replace(bare, "/+$", "").alias("id"), F.length("html").alias("size"))
    steps = pages.select(F.split("id", "/").alias("st")).distinct()
    at = steps.select("st", F.explode(F.sequence(F.lit(1), F.size("st"))).alias("k"))
    path = lambda k: F.array_join(F.slice("st", F.lit(1), k), "/")
    nodes = at.select(path(F.col("k")).alias("id"), F.when(F.col("k") > 1, path(F.col("k") - 1)).alias("parent")).distinct()
    return trees.subtree_totals(nodes, pages)


@query(rf"""WITH {_BASE}, m AS (SELECT DISTINCT item_id, doc_id FROM h JOIN k USING (item_id) WHERE matched >= floor(terms * 0.3)),
g AS (SELECT coalesce(source, '') AS tag, (count(*) + 1) / ((SELECT count(*) FROM documents) + 1000) AS prior FROM documents GROUP BY ALL),
tc AS (SELECT item_id, coalesce(source, '') AS tag, count(*) AS c FROM m JOIN documents USING (doc_id) GROUP BY ALL),
x AS (SELECT item_id, tag, CAST(round_even(10 * (c + 1) / (sum(c) OVER (PARTITION BY item_id) + 1000) / greatest(1e-6, prior), 0) AS BIGINT) AS score FROM tc JOIN g USING (tag))
SELECT item_id, tag, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag) AS INTEGER) AS rank FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag) <= 3""")
def m20_question_tags(t):
    """Each item's three most telling tags (sources): how often its matches bear them, against all documents."""
    matched = s.match(_hits(t), "item_id", "doc_id", F.lit(0.0), 0.3).select("item_id", "doc_id")
    tagged = t("documents").select("doc_id", F.coalesce("source", F.lit("")).alias("tag"))
    return s.label_questions(matched, tagged, "item_id", "doc_id", "tag", 3)


_W = f"list_distinct(coalesce(regexp_extract_all(lower(s), '{TOKEN}'), []))"


@query(rf"""WITH p AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '[.?!;\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.?!;\n]'), 1) - 1 AS place FROM conversations),
a AS (SELECT conv_id, turn, place, {_W} AS w FROM p WHERE role = 'assistant' AND length(trim(s)) >= 5),
b AS (SELECT conv_id, turn AS cites, {_W} AS v FROM (SELECT conv_id, turn, text AS s FROM conversations WHERE role = 'user')),
x AS (SELECT a.conv_id, a.turn, place, cites, len(list_intersect(w, v)) / greatest(len(w), 1) AS sim FROM a JOIN b ON a.conv_id = b.conv_id AND cites < a.turn),
y AS (SELECT *, max(sim) OVER (PARTITION BY conv_id, turn, place) * 0.99 AS near, max(sim) OVER (PARTITION BY conv_id, turn) * 0.99 AS best FROM x),
z AS (SELECT *, CASE WHEN best >= 0.63 THEN 0.63 WHEN best >= 0.504 THEN 0.504 WHEN best >= 0.4032 THEN 0.4032 WHEN best >= 0.32256 THEN 0.32256 END AS floor FROM y),
c AS (SELECT conv_id, turn, place, cites, round(sim, 6) AS similarity FROM z WHERE near >= floor AND sim > near QUALIFY row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY cites) <= 4)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn, cites ORDER BY place) = 1""")
def m16_cited_sentences(t):
    """Sentences of answers with the earlier messages that they cite, each message once an answer."""
    m = t("conversations").select("conv_id", "turn", "role", "text")
    parts = m.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", r"[.?!;\n]")).alias("place", "s"))
    parts = parts.where(F.length(F.trim("s")) >= 5).select("conv_id", "turn", "place", F.array_distinct(tx.tokens(F.col("s"))).alias("w"))
    said = m.where("role = 'user'").select("conv_id", F.col("turn").alias("cites"), F.array_distinct(tx.tokens(F.col("text"))).alias("v"))
    near = parts.join(said, "conv_id").where("cites < turn")
    near = near.withColumn("similarity", F.size(F.array_intersect("w", "v")) / F.greatest(F.size("w"), F.lit(1)))
    cited = s.cite(near.drop("w", "v"), ["conv_id", "turn"], "place", "cites", "similarity")
    return cited.withColumn("similarity", F.round("similarity", 6))


@query()
def m17_mended_citations(t):
    """Answers with their citation marks mended, and the marks: each message may cite the messages before it."""
    answers = t("conversations").select("conv_id", "turn", ci.mend_citations(F.col("text"), F.col("turn")).alias("answer"))
    return answers.withColumn("cited", F.size(ci.cited_places(F.col("answer"))))


@query()
def w14_normalised(t):
    """Digests of the documents' texts as evaluation compares them, without spaces and without any signs."""
    texts = t("documents").select("doc_id", ev.normalised(F.col("text")).alias("loose"))
    return texts.select("doc_id", F.md5("loose").alias("loose"), F.md5(ev.signs_out(F.col("loose"))).alias("strict"))


@query()
def w15_message_support(t):
    """How well each answer supports the message before it: the best of its sentences and pairs of sentences."""
    m = t("conversations")
    asked = m.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("claim"))
    both = m.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(ev.support(F.col("claim"), F.col("answer")), 6).alias("support"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), r AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT user_id, ts AS put FROM e WHERE event_type = 'purchase')
SELECT event_id, user_id, put IS NOT NULL AND ts - put < INTERVAL 24 HOUR AS hit FROM r LEFT JOIN (SELECT event_id, max(put) AS put FROM r JOIN c ON r.user_id = c.user_id AND c.put <= r.ts GROUP BY event_id) USING (event_id)""")
def st7_lookup_with_lifetime(t):
    """Views answered from what the same user's last purchase stored, if it is less than a day old."""
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    asked, stored = e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "ts")
    return store.look_up(asked, stored, "user_id", "ts", 24 * 3600).select("event_id", "user_id", "hit")


def _alone(section: str) -> str:
    return f"length({section}) - length(replace({section}, ',', '')) >= 6"


@query(rf"""WITH RECURSIVE {_SECTIONS}, run AS (
 SELECT doc_id, i, s, n AS total, {_alone("s")} AS fig, CAST(0 AS BIGINT) AS chunk FROM sec WHERE i = 1 UNION ALL
 SELECT sec.doc_id, sec.i, sec.s, CASE WHEN fig OR ({_alone("sec.s")}) OR total + n > 128 THEN n ELSE total + n END, {_alone("sec.s")},
 CASE WHEN fig OR ({_alone("sec.s")}) OR total + n > 128 THEN chunk + 1 ELSE chunk END FROM run JOIN sec ON sec.doc_id = run.doc_id AND sec.i = run.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, CAST(max(total) AS INTEGER) AS tokens, string_agg(s, '' ORDER BY i) AS content FROM run GROUP BY doc_id, chunk""")
def t2_isolated_sections(t):
    """Lines packed to chunks; a line with six commas or more (a figure's data) is a chunk of its own."""
    docs = t("documents").select("doc_id", ch.delimited(F.col("text"), "\n").alias("sections"))
    return ch.merge_sections(docs, "sections", 128, alone=lambda x: F.regexp_count(x, F.lit(",")) >= 6)


@query(rf"""WITH RECURSIVE {_SECTIONS}, run AS (
 SELECT doc_id, i, s, n AS total, CAST(0 AS BIGINT) AS chunk FROM sec WHERE i = 1 UNION ALL
 SELECT sec.doc_id, sec.i, sec.s, CASE WHEN total + n > 128 THEN n ELSE total + n END, CASE WHEN total + n > 128 THEN chunk + 1 ELSE chunk END FROM run JOIN sec ON sec.doc_id = run.doc_id AND sec.i = run.i + 1),
naive AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, string_agg(s, '' ORDER BY i) AS content FROM run GROUP BY doc_id, chunk),
d AS (SELECT doc_id, CASE WHEN n_chars < 400 THEN 'one' WHEN n_chars < 1500 THEN 'lines' ELSE 'naive' END AS method, text FROM documents)
SELECT doc_id, method, 0 AS chunk_no, text AS content FROM d WHERE method = 'one'
UNION ALL SELECT doc_id, method, CAST(i - 1 AS INTEGER), s FROM d JOIN sec USING (doc_id) WHERE method = 'lines'
UNION ALL SELECT doc_id, method, chunk_no, content FROM d JOIN naive USING (doc_id) WHERE method = 'naive'""")
def t11_t15_chunk_methods(t):
    """Documents chunked by the method that their length calls for: whole, by lines, or packed."""
    n = F.col("n_chars")
    method = F.when(n < 400, "one").when(n < 1500, "lines").otherwise("naive")
    return ch.chunk_by_method(t("documents").select("doc_id", "text", method.alias("method")), "method", "text")


@query()
def t8_without_contents(t):
    """Documents' lines without tables of contents: how many lines stay."""
    lines = t("documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.size("l").alias("lines"), F.size(ch.without_contents(F.col("l"))).alias("kept"))


@query("""WITH x AS (SELECT doc_id, source, round(n_chars / 1000 + 10 * coalesce(quality, 0), 6) AS score FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, source, score FROM x ORDER BY score DESC, doc_id LIMIT 50""")
def o4_gathered_top(t):
    """The best 50 rows over the tables of three groups of languages, each asked for its own best."""
    scored = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    scored = scored.withColumn("score", F.round(F.col("n_chars") / 1000 + F.coalesce("quality", F.lit(0)) * 10, 6))
    groups = scored.withColumn("group", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2))
    tables = [groups.where(f"group = {g}").select("doc_id", "source", "score") for g in range(3)]
    return s.gather(tables, 50, "score", "doc_id")


# Boxes of a page: lines of an order, on the same text line if shipped in the same month.
_BOXES = "b AS (SELECT l_orderkey AS page, month(l_shipdate) AS line, l_linenumber AS box, l_quantity AS x0, l_quantity + 8 AS x1 FROM lineitem)"


@query(f"""WITH {_BOXES}, o AS (SELECT *, max(x1) OVER (PARTITION BY page, line ORDER BY x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM o)
SELECT page, line, CAST(part AS INTEGER) AS part, min(x0) AS x0, max(x1) AS x1, count(*) AS boxes, string_agg(CAST(box AS VARCHAR), ' ' ORDER BY x0, box) AS content FROM i GROUP BY page, line, part""")
def s10_joined_boxes(t):
    """Boxes of a text line joined where no gap above 3 parts them."""
    b = t("lineitem").select(F.col("l_orderkey").alias("page"), F.month("l_shipdate").alias("line"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 8).alias("x1"))
    line = Window.partitionBy("page", "line").orderBy("x0", "box").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("reach", F.max("x1").over(line))
    at = F.row_number().over(Window.partitionBy("page", "line").orderBy("x0", "box"))
    parts = ch.islands(b.withColumn("_at", at), ["page", "line"], "_at", F.col("reach").isNull() | (F.col("x0") - F.col("reach") > 3), "part")
    ordered = F.array_sort(F.collect_list(F.struct("_at", "box")))
    joined = parts.groupBy("page", "line", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), _n().alias("boxes"), ordered.alias("o"))
    return joined.withColumn("content", F.array_join(F.transform("o", lambda x: x["box"].cast("string")), " ")).drop("o")

