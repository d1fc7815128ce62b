"""Documents, pages, conversations and rows to chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as tx
from ..operators import chunking as ch
from ..sources.readers import row_lines
from .base import TOKEN, query

_COUNT = rf"CAST(len(regexp_extract_all(s, '{TOKEN}|[^\p{{L}}\p{{N}}_\s]')) AS BIGINT)"
_SECTIONS = rf"""sec AS (SELECT doc_id, s, {_COUNT} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(s) <> '')"""


def _packed(rule: str) -> str:
    return rf"""WITH RECURSIVE {_SECTIONS}, run AS (
 SELECT doc_id, i, s, n AS total, CAST(0 AS BIGINT) AS chunk FROM sec WHERE i = 1 UNION ALL
 SELECT sec.doc_id, sec.i, sec.s, CASE WHEN {rule} THEN n ELSE total + n END, CASE WHEN {rule} THEN chunk + 1 ELSE chunk END FROM run JOIN sec ON sec.doc_id = run.doc_id AND sec.i = run.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, CAST(max(total) AS INTEGER) AS tokens, string_agg(s, '' ORDER BY i) AS content FROM run GROUP BY doc_id, chunk"""


def _sections(t):
    return t("documents").select("doc_id", ch.delimited(F.col("text"), "\n").alias("sections"))


@query(rf"WITH {_SECTIONS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS section, CAST(n AS INTEGER) AS tokens FROM sec")
def s2_sections(t):
    """Each document's non-blank lines with their token counts."""
    rows = _sections(t).select("doc_id", F.posexplode("sections").alias("pos", "section"))
    return rows.withColumn("tokens", tx.token_count(F.col("section")).cast("int"))


@query(_packed("total + n > 128"))
def t1_merge_to_limit(t):
    """Lines packed to chunks of at most 128 tokens, unless one line has more."""
    return ch.merge_sections(_sections(t), "sections", 128)


@query(_packed("total > 128"))
def t3_merge_past_limit(t):
    """The older rule: a chunk is closed once it is above the limit."""
    return ch.merge_sections(_sections(t), "sections", 128, overshoot=True)


def _family_sql() -> str:
    """CTEs x (doc_id, i, s) of all lines and fam (doc_id, family)."""
    no = ch.begins_with(ch.NO_BULLETS)
    votes = ", ".join(f"count(*) FILTER (regexp_matches(s, '{ch.begins_with(f)}') AND NOT regexp_matches(s, '{no}')) AS v{k}" for k, f in enumerate(ch.BULLETS))
    best = f"greatest({', '.join(f'v{k}' for k in range(len(ch.BULLETS)))})"
    pick = " ".join(f"WHEN v{k} = {best} THEN {k}" for k in range(len(ch.BULLETS)))
    return f"""x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
v AS (SELECT doc_id, {votes} FROM x GROUP BY doc_id), fam AS (SELECT doc_id, CASE WHEN {best} = 0 THEN -1 {pick} END AS family FROM v)"""


def _level_sql() -> str:
    no = ch.begins_with(ch.NO_BULLETS)
    hits = " ".join(f"WHEN family = {f} AND regexp_matches(trim(s), '^(?:{p})') AND NOT regexp_matches(s, '{no}') THEN {i}" for f, ps in enumerate(ch.BULLETS) for i, p in enumerate(ps))
    return f"CASE {hits} ELSE CASE family {' '.join(f'WHEN {f} THEN {len(ps) + 1}' for f, ps in enumerate(ch.BULLETS))} ELSE {len(ch.BULLETS[0]) + 1} END END"


@query(f"WITH {_family_sql()} SELECT doc_id, family FROM fam")
def t5_bullet_family(t):
    """The family of heading marks of each document."""
    return t("documents").select("doc_id", ch.bullet_family(F.split("text", "\n")).alias("family"))


@query(f"""WITH {_family_sql()}, l AS (SELECT doc_id, i, family, {_level_sql()} AS level FROM x JOIN fam USING (doc_id)),
c AS (SELECT doc_id, level, count(*) AS n, min(i) AS first FROM l WHERE family >= 0 AND level <= CASE family {' '.join(f'WHEN {f} THEN {len(ps)}' for f, ps in enumerate(ch.BULLETS))} END GROUP BY ALL)
SELECT doc_id, CAST(level AS INTEGER) AS most_level, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def t6_title_frequency(t):
    """The most frequent level of a document's headings, by its family of marks; ties go to the level met first."""
    d = t("documents").select("doc_id", F.split("text", "\n").alias("lines")).withColumn("family", ch.bullet_family(F.col("lines"))).where("family >= 0")
    x = d.select("doc_id", "family", F.posexplode("lines").alias("i", "s"))
    size = F.get(F.array(*(F.lit(len(f)) for f in ch.BULLETS)), F.col("family"))
    x = x.withColumn("level", ch.bullet_level(F.col("s"), F.col("family"))).where(F.col("level") <= size)
    c = x.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return c.withColumn("at", F.row_number().over(w)).where("at = 1").select("doc_id", F.col("level").alias("most_level"), "n")


@query("""WITH m AS (SELECT conv_id, turn, text, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS exchange FROM conversations)
SELECT conv_id, CAST(exchange AS INTEGER) AS exchange, min(turn) AS first_turn, count(*) AS messages, string_agg(text, chr(10) ORDER BY turn, role, text) AS content FROM m GROUP BY conv_id, exchange""")
def t7_exchanges(t):
    """Stretches of a conversation that begin with a user's message, each merged to one chunk."""
    rows = t("conversations").withColumn("_o", F.struct("turn", "role", "text"))
    rows = ch.islands(rows, ["conv_id"], "_o", F.col("role") == "user", "exchange")
    lines = F.transform(F.array_sort(F.collect_list("_o")), lambda r: r["text"])
    return rows.groupBy("conv_id", "exchange").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("messages"), F.array_join(lines, "\n").alias("content"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, 'part：' || l_partkey || '; supplier：' || l_suppkey || '; flag：' || l_returnflag AS line FROM lineitem)
SELECT l_orderkey, CAST(i // 3 AS INTEGER) AS block, string_agg(line, ' | ' ORDER BY i) AS content FROM l GROUP BY l_orderkey, i // 3""")
def s7_t10_row_blocks(t):
    """Rows as lines of 'column：value', joined three at a time."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"))
    rows = row_lines(rows, ["part", "supplier", "flag"])
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "part", "supplier")) - 1)
    return ch.table_blocks(rows, ["l_orderkey"], "i", "line", 3, " | ")


@query(r"""WITH m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, trim(regexp_replace(text, '^(?i:question|answer|user|assistant|q|a)[\t:： ]+', '')) AS question, trim(regexp_replace(t2, '^(?i:question|answer|user|assistant|q|a)[\t:： ]+', '')) AS answer FROM m WHERE role = 'user' AND r2 = 'assistant'""")
def t12_question_answer_pairs(t):
    """Each user message with the assistant's answer that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t("conversations").withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).where("role = 'user' and r2 = 'assistant'")
    return rows.select("conv_id", "turn", tx.strip_qa_prefix(F.col("text")).alias("question"), tx.strip_qa_prefix(F.col("t2")).alias("answer"))


@query(r"""WITH v AS (SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders),
k AS (SELECT "column", CASE WHEN regexp_matches(v, '^[+-]?[0-9]{1,18}$') THEN 'int' WHEN regexp_matches(v, '^[+-]?[0-9]*\.[0-9]+$') THEN 'float' WHEN regexp_matches(v, '(?i)^(true|false|yes|no)$') THEN 'bool' WHEN regexp_matches(v, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$') THEN 'datetime' ELSE 'text' END AS kind FROM v WHERE trim(v) <> '')
SELECT "column", kind, votes FROM (SELECT "column", kind, count(*) AS votes FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY votes DESC) = 1""")
def t14_a12_column_types(t):
    """The type that most values of each column look like."""
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return ch.column_types(rows, rows.columns)


@query("SELECT doc_id, CAST(a AS BIGINT) AS from_char, least(a + 3000, n_chars) AS to_char FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars, 1), 3000)) AS a FROM documents)")
def t18_task_ranges(t):
    """Each document's work in ranges of 3000 characters."""
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(3000).cast("long"))
    rows = t("documents").select("doc_id", "n_chars", F.explode(at).alias("from_char"))
    return rows.select("doc_id", "from_char", F.least(F.col("from_char") + 3000, "n_chars").alias("to_char"))


@query(rf"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents) GROUP BY term")
def w1_term_counts(t):
    """Every word with its occurrences and documents."""
    from ..operators.search import postings

    return postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(r"SELECT doc_id, round(CASE WHEN s > 0 THEN a / s ELSE 0 END, 9) AS latin_share, CASE WHEN s > 0 AND a / s >= 0.8 THEN 1 ELSE 0 END AS english FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS a, len(regexp_extract_all(text, '\S')) AS s FROM documents)")
def w9_latin_share(t):
    share = tx.latin_share(F.col("text"))
    return t("documents").select("doc_id", F.round(share, 9).alias("latin_share"), F.when(share >= 0.8, 1).otherwise(0).alias("english"))


_KIND_SQL = " ".join(f"WHEN regexp_matches(cell, '{pattern.replace("'", "''")}') THEN '{label}'" for pattern, label in tx.CELL_KINDS)


@query(rf"""WITH c AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d')]) AS cell, unnest(['name', 'brand', 'type', 'size', 'day']) AS col FROM part),
w AS (SELECT *, len(list_filter(regexp_extract_all(lower(cell), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)) AS words FROM c)
SELECT col, CASE {_KIND_SQL} WHEN words > 11 THEN 'Lx' WHEN words > 3 THEN 'Tx' ELSE 'Ot' END AS kind, count(*) AS n FROM w GROUP BY ALL""")
def w23_cell_types(t):
    """How many cells of each column are of each kind."""
    cells = {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "day": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")}
    rows = t("part").select(F.explode(F.array(*(F.struct(F.lit(k).alias("col"), v.alias("cell")) for k, v in cells.items()))).alias("x")).select("x.*")
    return rows.groupBy("col", tx.block_type(F.col("cell")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations)
SELECT conv_id, turn, role, count(*) AS bigrams FROM (SELECT conv_id, turn, role, unnest(range(1, len(w))) FROM w WHERE len(w) > 1) GROUP BY ALL""")
def wn11_bigrams(t):
    """Adjacent word pairs of each message."""
    rows = t("conversations").select("conv_id", "turn", "role", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = rows.select("conv_id", "turn", "role", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("bigrams"))


@query()
def s4_json_pieces(t):
    """Each document as a nested JSON text (its lines, and their sentences), cut into pieces that keep the structure."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n_chars"), F.split(x, "\\. ").alias("sentences")))
    whole = F.to_json(F.struct("source", "lang", lines.alias("lines")))
    pieces = t("documents").select("doc_id", F.posexplode(nested.json_pieces(whole, 400)).alias("piece_no", "content"))
    return pieces.withColumn("n_chars", F.length("content"))
