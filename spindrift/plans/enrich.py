"""More chunk, text, evaluation and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import blocks as bl
from ..operators import chunking as ch
from ..operators import graph as g
from ..operators import search as s
from ..operators import store
from ..operators.components import connected_components
from .base import TOKEN, query


def _n():
    return F.count(F.lit(1))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages""")
def s3_html_lines(t):
    """A page's title and its text without scripts, styles and tags."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " ")
    return t("pages").select("page_id", F.trim(bare).alias("content"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


@query(r"""SELECT doc_id, len(list_filter(l, lambda x: contains(x, ' | '))) AS table_rows, array_to_string(list_filter(l, lambda x: NOT contains(x, ' | ')), chr(10)) AS rest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def s5_table_rows(t):
    """Rows of borderless tables counted, and the text without them."""
    rows = t("documents").select("doc_id", F.split("text", "\n").alias("l"))
    return rows.select("doc_id", F.size(F.filter("l", lambda x: F.contains(x, F.lit(" | ")))).alias("table_rows"), F.array_join(F.filter("l", lambda x: ~F.contains(x, F.lit(" | "))), "\n").alias("rest"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn, role, text) AS texts, list(CAST(role = 'user' AS INT) ORDER BY turn, role, text) AS marks FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, texts[i] AS passage, marks[i] AS mark FROM (SELECT *, unnest(generate_series(1, len(texts))) AS i FROM c)""")
def s18_nested_passages(t):
    """Parallel arrays of passages and judgments, one row per passage."""
    from ..sources.readers import ranked_passages

    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    c = c.select("conv_id", F.transform("x", lambda r: r["text"]).alias("texts"), F.transform("x", lambda r: (r["role"] == "user").cast("int")).alias("marks"))
    return ranked_passages(c, "conv_id", "texts", "marks")


@query("""WITH l AS (SELECT doc_id, s, i, CASE WHEN length(s) < 40 THEN 1 ELSE 0 END AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT doc_id, CAST(sid AS INTEGER) AS sid, count(*) AS lines, md5(string_agg(s, chr(10) ORDER BY i)) AS digest FROM k GROUP BY doc_id, sid""")
def t4_t7_heading_merge(t):
    """Lines merged under the short line that heads them."""
    l = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    l = ch.islands(l, ["doc_id"], "i", F.length("s") < 40, "sid")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]), "\n")
    return l.groupBy("doc_id", "sid").agg(_n().alias("lines"), F.md5(joined).alias("digest"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS tags, count(*) AS n FROM conversations GROUP BY conv_id")
def t13_tags(t):
    """Tags of each conversation, split from a joined list again."""
    c = t("conversations").groupBy("conv_id").agg(F.array_join(F.collect_list("role"), ",").alias("j"), _n().alias("n"))
    return c.select("conv_id", F.array_join(F.array_sort(F.array_distinct(F.split("j", ","))), ",").alias("tags"), "n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderstatus IN ('O', 'F') AND contains(lower(o_orderpriority), 'high')")
def f7_f8_predicates(t):
    """Ranges, membership and a case-insensitive contains."""
    o = t("orders").where(F.col("o_totalprice").between(100000, 120000) & F.contains(F.lower("o_orderpriority"), F.lit("high")))
    return o.where(store.condition(o, {"o_orderstatus": ["O", "F"]})).select("o_orderkey", "o_totalprice")


@query("""WITH d AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), q AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang),
n AS (SELECT source, sqrt(sum(c * c)) AS norm FROM d GROUP BY source) SELECT source, round(10 * sum(d.c * q.c) / (any_value(norm) * (SELECT sqrt(sum(c * c)) FROM q)), 6) AS feature FROM d JOIN q USING (lang) JOIN n USING (source) GROUP BY source""")
def m13_rank_features(t):
    """Ten times the cosine of each source's tags with the whole table's."""
    d = t("documents").groupBy("source", "lang").agg(_n().cast("double").alias("c"))
    q = d.groupBy("lang").agg(F.sum("c").alias("q"))
    total = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy()))
    q = q.select("lang", "q", total.alias("total"))
    r = d.join(q, "lang").groupBy("source").agg(F.sum(F.col("c") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"), F.first("total").alias("total"))
    return r.select("source", F.round(F.lit(10) * F.col("dot") / (F.col("norm") * F.col("total")), 6).alias("feature"))


_W = rf"list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))"


@query(f"""WITH m AS (SELECT conv_id, turn, role, text, {_W} AS w FROM conversations), x AS (SELECT a.conv_id, a.turn, a.role, b.turn AS cites, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1), 6) AS share FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant' AND b.role = 'user')
SELECT conv_id, turn, cites, share FROM x WHERE share > 0.1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY share DESC, cites) <= 4""")
def m16_j11_citations(t):
    """The earlier messages of its conversation that support each answer, at most four."""
    m = t("conversations").select("conv_id", "turn", "role", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    a = m.where("role = 'assistant'")
    b = m.where("role = 'user'").select("conv_id", F.col("turn").alias("cites"), F.col("w").alias("v"))
    share = F.size(F.array_intersect("w", "v")) / F.greatest(F.size("w"), F.lit(1))
    x = a.join(b, "conv_id").where("cites < turn").select("conv_id", "turn", "cites", F.round(share, 6).alias("share")).where("share > 0.1")
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("share"), "cites")
    return x.withColumn("at", F.row_number().over(w)).where("at <= 4").drop("at")


@query("""WITH v AS (SELECT vec_id, label, list_slice(embedding, 1, 32)::DOUBLE[] AS img, list_slice(embedding, 33, 64)::DOUBLE[] AS cap FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
x AS (SELECT q.vec_id AS query_id, v.vec_id, round(0.4 * list_cosine_similarity(q.img, v.img) + 0.6 * list_cosine_similarity(q.cap, v.cap), 6) AS score, v.vec_id % 7 AS doc FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, vec_id) AS i FROM x)
SELECT query_id, vec_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d WHERE i <= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 6""")
def m21_image_candidates(t):
    """Image and caption cosines mixed; two of each document, then six of each query."""
    v = bl.weighted_units(t("embeddings"), [(F.slice("embedding", 1, 32), 32, 0.4), (F.slice("embedding", 33, 32), 32, 0.6)])
    v = v.select("vec_id", "label", (F.col("vec_id") % 7).alias("doc"), "unit")
    x = bl.best_of_groups(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, "query_id", "vec_id", "doc", "label", 2)
    first = Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "vec_id")
    return s.top(x.withColumn("i", F.row_number().over(first)).where("i <= 2").drop("i"), "query_id", 6, "score", "vec_id")


@query("SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('error') THEN 'failure' WHEN event_type IN ('purchase', 'signup') THEN 'goal' ELSE 'traffic' END AS role, round(avg(length(props)), 4) AS props FROM events GROUP BY event_type")
def m22_role_classes(t):
    """Rows classed by ordered rules."""
    k = F.col("event_type")
    role = F.when(k == "error", "failure").when(k.isin("purchase", "signup"), "goal").otherwise("traffic")
    return t("events").groupBy("event_type").agg(_n().alias("n"), F.round(F.avg(F.length("props")), 4).alias("props")).withColumn("role", role)


@query("SELECT qid, relevant, coalesce(found, 0) AS found FROM (SELECT source AS qid, count(*) AS relevant FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY source) LEFT JOIN (SELECT source AS qid, count(*) AS found FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND n_chars > 5000 GROUP BY source) USING (qid)")
def j9_missing_predictions(t):
    """Every judged query with what was found for it, 0 if nothing."""
    x = t("labels").where("quality = 1").join(t("documents").select("doc_id", F.col("source").alias("qid"), "n_chars"), "doc_id")
    truth = x.groupBy("qid").agg(_n().alias("relevant"))
    found = x.where("n_chars > 5000").groupBy("qid").agg(_n().alias("found"))
    return truth.join(found, "qid", "left").select("qid", "relevant", F.coalesce("found", F.lit(0)).alias("found"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j13_edges_of_known_nodes(t):
    """Edges both of whose ends exist: two semi-joins."""
    e = t("lineitem").select("l_partkey", "l_suppkey")
    e = e.join(t("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return e.join(t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").distinct()


@query("SELECT a.n_regionkey AS region, count(*) AS edges, round(sum(o_totalprice), 2) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON o_orderkey % 25 = b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY ALL")
def j14_a11_community_edges(t):
    """Edges within a community, counted and weighed."""
    a = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    b = t("nation").select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("r2"))
    e = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(a, "c_nationkey")
    e = e.join(b, (F.col("o_orderkey") % 25 == F.col("other")) & (F.col("region") == F.col("r2")))
    return e.groupBy("region").agg(_n().alias("edges"), F.round(F.sum("o_totalprice"), 2).alias("weight"))


@query("SELECT doc_id, 'quality' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 4000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j17_append_new(t):
    """Results of a second search appended where the first has not found them."""
    first = t("labels").where("quality = 1").select("doc_id")
    more = t("documents").where("n_chars > 4000").select("doc_id").join(first, "doc_id", "left_anti")
    return first.withColumn("origin", F.lit("quality")).unionByName(more.withColumn("origin", F.lit("long")))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT coalesce(sum(n_chars), 0) FROM documents WHERE lang = 'xx') AS none")
def a5_counts(t):
    d = t("documents").agg(_n().alias("documents"), F.coalesce(F.sum(F.when(F.col("lang") == "xx", F.col("n_chars"))), F.lit(0)).alias("none"))
    return d.join(t("labels").agg(_n().alias("labels")), F.lit(True)).join(t("events").agg(F.countDistinct("user_id").alias("users")), F.lit(True))


@query("""WITH r AS (SELECT source AS qid, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), w AS (SELECT source AS qid, lang FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY ALL)
SELECT w.qid, round(count(DISTINCT CASE WHEN rank <= 3 THEN r.lang END) / count(DISTINCT w.lang), 6) AS coverage3, round(count(DISTINCT CASE WHEN rank <= 5 THEN r.lang END) / count(DISTINCT w.lang), 6) AS coverage5 FROM w LEFT JOIN r ON w.qid = r.qid AND w.lang = r.lang AND rank <= 5 GROUP BY w.qid""")
def a15_coverage_signals(t):
    """How much of what a query needs its first 3 and 5 results cover."""
    d = t("documents").select("doc_id", F.col("source").alias("qid"), "lang", "n_chars")
    run = s.top(d, "qid", 5, "n_chars").groupBy("qid").agg(F.collect_set(F.when(F.col("rank") <= 3, F.col("lang"))).alias("l3"), F.collect_set("lang").alias("l5"))
    want = t("labels").where("quality = 1").join(d, "doc_id").groupBy("qid").agg(F.collect_set("lang").alias("want"))
    share = lambda c: F.round(F.coalesce(F.size(F.array_intersect("want", c)), F.lit(0)) / F.size("want"), 6)
    return want.join(run, "qid", "left").select("qid", share("l3").alias("coverage3"), share("l5").alias("coverage5"))


@query("""WITH r AS (SELECT 'doc' AS scope, source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT 'lang', source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, n_chars, doc_id) FROM documents),
f AS (SELECT scope, qid, min(rank) AS first FROM r JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL)
SELECT scope, round(avg((first <= 1)::INT), 6) AS hit1, round(avg((first <= 3)::INT), 6) AS hit3, round(avg(1.0 / first), 6) AS mrr FROM f GROUP BY scope""")
def a16_a18_ablation(t):
    """First-hit measures of two rankings side by side."""
    d = t("documents").select("doc_id", F.col("source").alias("qid"), "lang", "n_chars")
    by = lambda scope, *order: d.select(F.lit(scope).alias("scope"), "qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).alias("rank"))
    r = by("doc", F.desc("n_chars"), "doc_id").unionByName(by("lang", "lang", "n_chars", "doc_id"))
    first = r.join(t("labels").where("quality = 1").select("doc_id"), "doc_id").groupBy("scope", "qid").agg(F.min("rank").alias("first"))
    hit = lambda k: F.round(F.avg((F.col("first") <= k).cast("int")), 6)
    return first.groupBy("scope").agg(hit(1).alias("hit1"), hit(3).alias("hit3"), F.round(F.avg(1.0 / F.col("first")), 6).alias("mrr"))


@query("SELECT user_id, CAST(sum(length(props)) AS BIGINT) AS used, count(*) AS calls FROM events GROUP BY user_id QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY sum(length(props)) DESC, user_id) <= 3")
def a21_usage_top(t):
    """Use summed per user, and the three largest of each tenant."""
    u = t("events").groupBy("user_id").agg(F.sum(F.length("props")).alias("used"), _n().alias("calls")).withColumn("tenant", F.col("user_id") % 10)
    return s.top(u, "tenant", 3, "used", "user_id").drop("rank", "tenant")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def o1_o2_ordered_page(t):
    """A page of the whole table in order: a top-k report."""
    return t("documents").select("doc_id", "source", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").offset(40).limit(20)


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten(list(string_split(o_orderpriority, '-'))))), ',') AS parts FROM orders GROUP BY o_custkey")
def u3_flat_distinct(t):
    """Lists of a group made one list of different values."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("o_orderpriority", "-")))))
    return t("orders").groupBy("o_custkey").agg(F.array_join(parts, ",").alias("parts"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term, round(tf * ln(1 + 1000.0 / df), 6) AS weight FROM c JOIN f USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(1 + 1000.0 / df), 6) DESC, term) <= 5""")
def w8_top_terms(t):
    """Each document's five weightiest words, as a query made from a paragraph."""
    p = s.postings(t("documents"), "doc_id", "text")
    f = p.groupBy("term").agg(_n().alias("df"))
    x = p.join(f, "term").select("doc_id", "term", F.round(F.col("tf") * F.log1p(F.lit(1000.0) / F.col("df")), 6).alias("weight"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return x.withColumn("at", F.row_number().over(w)).where("at <= 5").drop("at")


@query(r"""SELECT p_partkey, regexp_replace(p_name, '([:\{\}/\[\]\-\*\"\(\)\|\+~\^#])', '\\\1', 'g') AS escaped, replace(replace('{name} is of {brand}', '{name}', p_name), '{brand}', p_brand) AS filled FROM part""")
def w13_w19_escape_and_fill(t):
    """Query marks escaped, and a template filled from the row."""
    escaped = F.regexp_replace("p_name", r"([:\{\}/\[\]\-\*\"\(\)\|\+~\^#])", r"\\$1")
    filled = F.replace(F.replace(F.lit("{name} is of {brand}"), F.lit("{name}"), F.col("p_name")), F.lit("{brand}"), F.col("p_brand"))
    return t("part").select("p_partkey", escaped.alias("escaped"), filled.alias("filled"))


@query("SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(list_distinct(string_split(lower(a.text), '')), list_distinct(string_split(lower(b.text), '')))) / 40.0, 6) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def w15_character_overlap(t):
    """Shared characters of neighbouring documents."""
    d = t("documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), ""), lambda c: c != "")).alias("c"))
    n = d.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("c").alias("v"))
    return d.withColumnRenamed("doc_id", "a").join(n, "a").select("a", "b", F.round(F.size(F.array_intersect("c", "v")) / 40.0, 6).alias("shared"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def w21_duplicate_check(t):
    """Contents that occur more than once."""
    return t("documents").groupBy(F.md5("text").alias("digest")).agg(_n().alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("SELECT p_partkey, CASE p_size % 10 WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' ELSE CAST(p_size AS VARCHAR) END AS word, CASE WHEN p_size % 10 BETWEEN 1 AND 5 THEN p_size % 10 ELSE p_size END AS number FROM part")
def w22_number_words(t):
    """Numerals and number words read back as numbers."""
    known = {"one": 1, "two": 2, "three": 3, "IV": 4, "V": 5}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    n = F.col("p_size") % 10
    word = F.when(n == 1, "one").when(n == 2, "two").when(n == 3, "three").when(n == 4, "IV").when(n == 5, "V").otherwise(F.col("p_size").cast("string"))
    rows = t("part").select("p_partkey", word.alias("word"))
    return rows.select("p_partkey", "word", F.coalesce(F.element_at(table, F.col("word")), F.expr("try_cast(word as int)"), F.lit(-1)).alias("number"))


_NEAR = "e AS (SELECT DISTINCT c_nationkey AS a, 100 + c_custkey AS b FROM customer)"


@query(f"""WITH RECURSIVE {_NEAR}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS seen FROM u UNION SELECT w.node, u.b FROM w JOIN u ON w.seen = u.a), c AS (SELECT node, min(seen) AS component FROM w GROUP BY node), k AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT node FROM c WHERE component = (SELECT component FROM k ORDER BY n DESC, component LIMIT 1)""")
def g9_largest_component(t):
    e = t("customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") + 100).alias("b"))
    c = connected_components(e)
    largest = c.groupBy("component").agg(_n().alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(largest, "component", "left_semi").select("node")


@query(r"""WITH r AS (SELECT p_partkey AS source, upper(p_type) AS name, p_brand AS type FROM part UNION ALL SELECT p_partkey, upper(p_brand), 'brand' FROM part)
SELECT name, count(*) AS n, count(DISTINCT source) AS sources FROM r GROUP BY name""")
def g1_record_parse(t):
    """Extraction records written out and parsed again."""
    said = F.concat(F.lit('("entity"<|>'), "p_type", F.lit("<|>"), "p_brand", F.lit('<|>x)##("entity"<|>'), "p_brand", F.lit("<|>brand<|>y)##(broken)"))
    rows = g.parse_records(t("part").select(F.col("p_partkey").alias("source"), said.alias("text")), "text")
    return rows.groupBy("name").agg(_n().alias("n"), F.countDistinct("source").alias("sources"))


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS leaf, n_name AS node, 0 AS depth FROM nation UNION ALL SELECT leaf, CASE depth WHEN 0 THEN r_name ELSE 'WORLD' END, depth + 1 FROM up JOIN nation ON leaf = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE depth < 2)
SELECT node, depth, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS total FROM up LEFT JOIN customer ON c_nationkey = leaf GROUP BY node, depth""")
def g18_folder_sizes(t):
    """Sizes of leaves, their parents and the root."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    levels = F.explode(F.array(F.struct(F.col("n_name").alias("node"), F.lit(0).alias("depth")), F.struct(F.col("r_name").alias("node"), F.lit(1).alias("depth")), F.struct(F.lit("WORLD").alias("node"), F.lit(2).alias("depth"))))
    leaf = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(_n().alias("k"), F.sum("c_acctbal").alias("v"))
    rows = n.join(leaf, "n_nationkey", "left").select(levels.alias("x"), "k", "v").select("x.*", "k", "v")
    return rows.groupBy("node", "depth").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("customers"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("total"))


@query("""WITH p AS (SELECT md5(text) AS k, count(*) AS hits FROM conversations WHERE role = 'user' GROUP BY ALL), c AS (SELECT md5(text) AS k FROM conversations WHERE turn = 0 GROUP BY ALL)
SELECT CASE WHEN c.k IS NULL THEN 'miss' ELSE 'hit' END AS cache, count(*) AS keys, CAST(sum(hits) AS BIGINT) AS calls FROM p LEFT JOIN c ON p.k = c.k GROUP BY ALL""")
def st7_cache_lookup(t):
    """Calls that a table of known answers saves, and those that have to be made."""
    m = t("conversations").select(F.md5("text").alias("k"), "turn", "role")
    calls = m.where("role = 'user'").groupBy("k").agg(_n().alias("hits"))
    known = m.where("turn = 0").select("k").distinct().withColumn("cache", F.lit("hit"))
    return calls.join(known, "k", "left").groupBy(F.coalesce("cache", F.lit("miss")).alias("cache")).agg(_n().alias("keys"), F.sum("hits").alias("calls"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def st8_cancelled(t):
    """Work left when the cancelled is taken out."""
    e = t("events")
    return e.where("event_type = 'view'").select("event_id", "user_id").join(e.where("event_type = 'error' and value > 100").select("user_id"), "user_id", "left_anti")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def c9_s21_sql_component(t):
    """A statement run over registered views."""
    df = t("customer")
    return df.sparkSession.sql("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment", customer=df)


@query()
def g15_cluster_summaries(t):
    """Vectors clustered and each cluster summarised by its mean; clustering is iterative, so it has no SQL."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "embedding")
    model = KMeans(k=8, seed=7, maxIter=10).fit(v)
    rows = model.transform(v).select(F.col("prediction").alias("cluster"), F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("cluster", "i").agg(F.avg("x").alias("x"), _n().alias("members"))
    summary = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"])
    return means.groupBy("cluster").agg(F.max("members").alias("members"), summary.alias("centre"))
