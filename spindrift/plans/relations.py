"""Joins, aggregates, windows, set operations and updates over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import evaluation as ev
from ..operators import search as s
from ..operators import store
from ..streaming.queue import heartbeats
from .base import query



def _n():
    return F.count(F.lit(1))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY ALL")
def j1_context_join(t):
    """Work rows with their owner, group and tenant: a four-way inner join."""
    o = t("orders").where("o_orderstatus = 'O'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name").agg(_n().alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def j2_a4_left_join_totals(t):
    """Every owner with its pending work, 0 if it has none."""
    o = t("orders").where("o_orderstatus = 'P'")
    rows = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j3_access_semi_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 OR s_acctbal > 9000")
def j4_permission_join(t):
    """Rows that their group may see or that are their own: an equi-join with a disjunction."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.where((F.col("n_regionkey") == 1) | (F.col("s_acctbal") > 9000)).select("s_suppkey", "n_name")


@query("SELECT o_orderpriority, count(*) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY ALL")
def j6_residual_join(t):
    """An equi-join with a further predicate of both sides."""
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return t("lineitem").join(t("orders"), on).groupBy("o_orderpriority").agg(_n().alias("late"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(lower(a.p_name), lower(b.p_name)) <= least(length(a.p_name), length(b.p_name)) // 2")
def j12_w16_resolution_candidates(t):
    """Pairs of like entities of one type whose names are close, blocked by type and size."""
    p = t("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    b = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_type", "p_size", F.col("p_name").alias("b_name"))
    rows = p.join(b, ["p_brand", "p_type", "p_size"]).where("p_partkey < b")
    return rows.where(tx.alike_names(F.col("p_name"), F.col("b_name"))).select(F.col("p_partkey").alias("a"), "b")


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'redo' ELSE 'reuse' END AS plan FROM orders")
def j16_reuse_split(t):
    """Work that can be reused and work that can't: a semi-join and its complement."""
    bad = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = t("orders").select("o_orderkey")
    redo, reuse = o.join(bad, "o_orderkey", "left_semi"), o.join(bad, "o_orderkey", "left_anti")
    return redo.withColumn("plan", F.lit("redo")).unionByName(reuse.withColumn("plan", F.lit("reuse")))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_quantity + 10 AS x1, l_tax * 100 AS top, l_tax * 100 + 4 AS bottom FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, c.l_linenumber AS other, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.bottom, c.bottom) - greatest(a.top, c.top), 0) / 40 AS share FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber <> c.l_linenumber AND a.top <= c.bottom AND a.bottom >= c.top AND a.x0 <= c.x1 AND a.x1 >= c.x0)
SELECT l_orderkey, l_linenumber, other, round(share, 6) AS share FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round(share, 6) DESC, other) = 1""")
def j18_box_overlap(t):
    """Each box with the box of its page that covers most of it: a range join within an equi-key."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_tax") * 100).alias("top"), (F.col("l_tax") * 100 + 4).alias("bottom"))
    o = x.select("l_orderkey", *(F.col(c).alias(f"o_{c}") for c in ("l_linenumber", "x0", "x1", "top", "bottom")))
    near = x.join(o, "l_orderkey").where("l_linenumber <> o_l_linenumber and top <= o_bottom and bottom >= o_top and x0 <= o_x1 and x1 >= o_x0")
    box = lambda p: tuple(F.col(p + c) for c in ("x0", "top", "x1", "bottom"))
    near = near.select("l_orderkey", "l_linenumber", F.col("o_l_linenumber").alias("other"), F.round(vx.overlap(box(""), box("o_")) / 40, 6).alias("share"))
    best = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("share"), "other")
    return near.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS tokens, round(avg(value), 6) AS mean, round(sum(value) / (count(*) + 0.1), 6) AS speed FROM events GROUP BY ALL")
def a3_daily_usage(t):
    """Calls, users, sums and speed of each day."""
    e = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(_n().alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value") / (F.count(F.lit(1)) + 0.1), 6).alias("speed"))


@query("""SELECT user_id, round(avg(greatest(value, 0)), 6) AS progress, CASE WHEN bool_or(event_type = 'error') THEN 'FAIL' WHEN bool_and(event_type IN ('view', 'click')) THEN 'RUNNING' ELSE 'DONE' END AS status, bool_or(event_type = 'purchase') AS has_purchase, max(value) AS top, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS messages FROM events GROUP BY user_id""")
def a6_progress_rollup(t):
    """The state of each unit of work from its tasks."""
    kind = F.col("event_type")
    status = F.when(F.bool_or(kind == "error"), "FAIL").when(F.bool_and(kind.isin("view", "click")), "RUNNING").otherwise("DONE")
    return t("events").groupBy("user_id").agg(F.round(F.avg(F.greatest("value", F.lit(0.0))), 6).alias("progress"), status.alias("status"), F.bool_or(kind == "purchase").alias("has_purchase"), F.max("value").alias("top"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("messages"))


@query("SELECT word, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents) GROUP BY word HAVING count(*) >= 5")
def a2_terms_facet(t):
    """Documents per value of a multi-valued field, each value of a document once."""
    rows = t("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    return rows.groupBy("word").agg(_n().alias("docs")).where("docs >= 5")


@query("""WITH v AS (SELECT doc_id, (length(text) - length(replace(text, ' the ', ''))) // 5 AS en, (length(text) - length(replace(text, ' der ', ''))) // 5 AS de, (length(text) - length(replace(text, ' les ', ''))) // 5 AS fr, (length(text) - length(replace(text, ' que ', ''))) // 5 AS es FROM documents)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'other' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS category FROM v""")
def a20_category_vote(t):
    """The category whose mark occurs most, the first of the largest, else the last."""
    marks = {"en": " the ", "de": " der ", "fr": " les ", "es": " que "}
    votes = {k: F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit(m), F.lit("")))) / 5) for k, m in marks.items()}
    most = F.greatest(*votes.values())
    pick = F.when(most == 0, "other")
    for k, v in votes.items():
        pick = pick.when(v == most, k)
    return t("documents").select("doc_id", pick.alias("category"))


_RUN = """WITH run AS (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
q AS (SELECT source AS qid, doc_id, quality + toxic AS rel FROM labels JOIN documents USING (doc_id)),
j AS (SELECT qid, doc_id, rank, coalesce(rel, 0) AS rel FROM run LEFT JOIN q USING (qid, doc_id) WHERE rank <= 10),
p AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) / rank AS prec FROM j),
g AS (SELECT qid, sum((rel > 0)::INT) AS hits, min(CASE WHEN rel > 0 THEN rank END) AS first, sum(CASE WHEN rel > 0 THEN prec ELSE 0 END) AS precs, sum((2.0 ** rel - 1) / log2(rank + 1)) AS dcg FROM p GROUP BY qid),
i AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN pos <= 10 THEN (2.0 ** rel - 1) / log2(pos + 1) ELSE 0 END) AS idcg, sum(CASE WHEN pos <= 10 THEN 2.0 ** rel - 1 ELSE 0 END) AS gains FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS pos FROM q WHERE rel > 0) GROUP BY qid),
m AS (SELECT qid, coalesce(hits / relevant, 0) AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1 / first, 0) AS mrr, coalesce(precs / least(relevant, 10), 0) AS ap, coalesce(dcg / idcg, 0) AS ndcg, coalesce(dcg / gains, 0) AS ndcg_flat FROM i LEFT JOIN g USING (qid))"""


def _metrics(t):
    docs = t("documents").select("doc_id", F.col("source").alias("qid"), "n_chars")
    run = s.top(docs, "qid", 10, "n_chars").select("qid", "doc_id", "rank")
    qrels = t("labels").join(docs, "doc_id").select("qid", "doc_id", (F.col("quality") + F.col("toxic")).alias("rel"))
    return ev.metrics(run, qrels, 10)


_COLUMNS = ("recall", "hit", "mrr", "ap", "ndcg", "ndcg_flat")


@query(_RUN + " SELECT qid, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLUMNS) + " FROM m")
def a13_a19_retrieval_metrics(t):
    """Recall, hit rate, MRR, MAP and nDCG at 10 of the longest documents of each source, judged by their labels."""
    return _metrics(t).select("qid", *(F.round(c, 6).alias(c) for c in _COLUMNS))


@query(_RUN + ", k AS (SELECT *, right(qid, 1) AS kind FROM m), a AS (SELECT kind, " + ", ".join(f"avg({c}) AS {c}" for c in _COLUMNS) + " FROM k GROUP BY kind) SELECT 'macro' AS level, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLUMNS) + " FROM a UNION ALL SELECT 'micro', " + ", ".join(f"round(avg({c}), 6)" for c in _COLUMNS) + " FROM m")
def a14_macro_micro(t):
    """Metrics averaged over kinds of queries and over queries."""
    m = _metrics(t)
    by_kind = m.withColumn("kind", F.substring("qid", -1, 1)).groupBy("kind").agg(*(F.avg(c).alias(c) for c in _COLUMNS))
    mean = lambda d, level: d.agg(*(F.round(F.avg(c), 6).alias(c) for c in _COLUMNS)).withColumn("level", F.lit(level))
    return mean(by_kind, "macro").unionByName(mean(m, "micro"))


@query("WITH x AS (SELECT source, quality AS p, 1 - toxic AS a FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, sum((p = 1 AND a = 1)::INT) AS tp, sum((p = 1 AND a <> 1)::INT) AS fp, sum((p <> 1 AND a = 1)::INT) AS fn, sum((p <> 1 AND a <> 1)::INT) AS tn FROM x GROUP BY source) SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM c")
def a17_decision_metrics(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select("source", F.col("quality").alias("p"), (1 - F.col("toxic")).alias("a"))
    out = ev.confusion(rows, "p", "a", ["source"])
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3")
def wn7_last_messages(t):
    """The last three messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return t("conversations").withColumn("at", F.row_number().over(w)).where("at <= 3").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("WITH a AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS i FROM documents), b AS (SELECT * FROM a WHERE i <= 3) SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 6")
def wn2_m21_two_level_top(t):
    """The best three of each (source, language), then the best six of each source."""
    d = t("documents").select("source", "lang", "doc_id", "n_chars").withColumn("key", F.struct("source", "lang"))
    first = s.top(d, "key", 3, "n_chars").drop("rank", "key")
    return s.top(first, "source", 6, "n_chars").drop("lang")


@query("SELECT doc_id, round(CASE WHEN hi > lo THEN (n_chars - lo) / (hi - lo) ELSE 0 END, 9) AS scaled FROM (SELECT doc_id, n_chars, min(n_chars) OVER (PARTITION BY source) AS lo, max(n_chars) OVER (PARTITION BY source) AS hi FROM documents)")
def wn10_min_max(t):
    return s.rescale(t("documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "x").select("doc_id", F.round("x", 9).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), ' ') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS context FROM lineitem")
def wn9_running_context(t):
    """Each row with what came before it in its group."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.collect_list(F.col("l_partkey").cast("string")).over(w), " ").alias("context"))


@query("SELECT DISTINCT id, kind FROM (SELECT c_nationkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)")
def u1_union_distinct(t):
    a = t("customer").select(F.col("c_nationkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(t("supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplier").alias("kind"))).dropDuplicates(["id", "kind"])


@query("SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def u2_set_difference(t):
    e = t("events")
    return e.where("event_type = 'purchase'").select("user_id").distinct().join(e.where("event_type = 'error'").select("user_id"), "user_id", "left_anti")


@query("SELECT user_id, event_type, value, CASE WHEN event_type LIKE 'p%' AND value > 50 THEN 'large' WHEN contains(event_type, 'err') OR value < 1 THEN 'odd' ELSE 'rest' END AS branch FROM events")
def f9_c5_switch_router(t):
    """Rows routed by ordered groups of conditions, the first that holds."""
    e, kind = t("events"), F.col("event_type")
    branch = F.when(F.startswith(kind, F.lit("p")) & (F.col("value") > 50), "large").when(F.contains(kind, F.lit("err")) | (F.col("value") < 1), "odd").otherwise("rest")
    return e.select("user_id", "event_type", "value", branch.alias("branch"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'large' ELSE p_type END AS kind, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS available FROM part WHERE NOT (p_brand = 'Brand#11' OR p_size < 3)")
def dml2_dml3_update_delete(t):
    """Rows deleted by one condition, then updated by another."""
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), "p_brand", "p_size").withColumn("available", F.lit(1)).withColumn("large", (F.col("p_size") > 40).cast("int"))
    rows = store.delete(store.delete(rows, {"p_brand": "Brand#11"}).withColumn("tiny", (F.col("p_size") < 3).cast("int")), {"tiny": 1})
    rows = store.update(rows, {"large": 1}, assign={"kind": "large", "available": 0})
    return rows.select("id", "kind", "available")


@query("SELECT o_custkey AS id, max(o_totalprice) AS price, 'new' AS version FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, c_acctbal, 'old' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dml1_st4_upsert(t):
    """Rows replaced by id, others kept."""
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price"), F.lit("old").alias("version"))
    new = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("price")).withColumn("version", F.lit("new"))
    return store.upsert(old, new)


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS beats, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY ALL")
def st5_heartbeats(t):
    """Each worker's signs of life by the hour."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    h = heartbeats(e, "user_id", "ts", "1 hour")
    return h.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "beats", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT conv_id, string_agg(replace(s, 'e', 'E'), ';' ORDER BY turn, role, i) AS done FROM (SELECT conv_id, turn, role, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM conversations WHERE role = 'user') GROUP BY conv_id")
def c7_iteration(t):
    """A text split, each piece worked, and the results joined again in order."""
    rows = t("conversations").where("role = 'user'").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    worked = rows.withColumn("s", F.replace(F.col("s"), F.lit("e"), F.lit("E")))
    return worked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "i", "s"))), lambda r: r["s"]), ";").alias("done"))
