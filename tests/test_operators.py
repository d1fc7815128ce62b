import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions import vectors as vx
from spindrift.operators import chunking, evaluation, graph, search, store
from spindrift.operators.components import connected_components
from spindrift.sources import readers
from spindrift.streaming import queue


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_components_of_chains_rings_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 5), (7, None)]
    found = dict(pairs(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_sections_rules(spark):
    docs = spark.createDataFrame([(1, ["a b", "c d e", "f", "g h i j k"]), (2, []), (3, None)], "id long, sections array<string>")
    strict = chunking.merge_sections(docs, "sections", 5)
    assert pairs(strict, "id", "chunk_no", "tokens", "content") == [(1, 0, 5, "a bc d e"), (1, 1, 1, "f"), (1, 2, 5, "g h i j k")]
    loose = chunking.merge_sections(docs, "sections", 4, overshoot=True)
    assert pairs(loose, "chunk_no", "tokens") == [(0, 5), (1, 6)]


def test_delimiters_of_one_or_more_characters(spark):
    df = spark.createDataFrame([("a##b;c\n\nd",)], "t string")
    assert df.select(chunking.delimited(F.col("t"), "\n;`##`").alias("s")).first()["s"] == ["a", "b", "c", "d"]


def test_bullets_first_family_wins_ties(spark):
    df = spark.createDataFrame([(["Chapter I x", "1. y"],), (["1. x", "2. y"],), (["plain"],), (["第一章 x", "第二节 y"],), (["Section 1 x"],), (["0 x", "3 5"],), (None,)], "s array<string>")
    got = df.select(chunking.bullet_family(F.col("s")).alias("f"), chunking.bullet_level(F.get("s", F.lit(0)), F.lit(3)).alias("l")).collect()
    assert [r["f"] for r in got] == [1, 1, -1, 0, 3, -1, -1]
    assert [r["l"] for r in got] == [1, 5, 5, 5, 2, 5, 5]


def test_conditions_skip_empty_values_and_treat_null_as_available(spark):
    df = spark.createDataFrame([(1, "a", ["x"], None), (2, "b", ["y", "x"], 0), (3, "a", None, 1)], "id long, kb string, tags array<string>, available_int int")
    ids = lambda **c: pairs(df.where(store.condition(df, c)), "id")
    assert ids(kb="a", tags=[]) == [(1,), (3,)]
    assert ids(tags=["x"]) == [(1,), (2,)]
    assert ids(available_int=1) == [(1,), (3,)] and ids(available_int=0) == [(2,)]
    assert ids(exists="tags") == [(1,), (2,)] and ids(must_not_exist="tags") == [(3,)]


def test_store_round_trip(spark):
    s = store.ChunkStore(spark)
    s.drop("chunks_t")
    s.upsert("chunks_t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"))
    s.upsert("chunks_t", spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "id long, t string"))
    assert pairs(s.read("chunks_t"), "id", "t") == [(1, "a"), (2, "B"), (3, "c")]
    s.replace("chunks_t", store.delete(s.read("chunks_t"), {"id": [1, 3]}))
    assert pairs(s.search("chunks_t", {"t": "B"}, ["id"]), "id") == [(2,)]
    s.drop("chunks_t")
    assert not s.exists("chunks_t")


def test_update_adds_removes_and_assigns(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, tags array<string>")
    out = store.update(df, {"id": [1, 2]}, add={"tags": "b"})
    assert pairs(out, "id", "tags") == [(1, ["a", "b"]), (2, ["b"])]
    assert pairs(store.update(out, {"id": 1}, remove={"tags": "a"}), "id", "tags") == [(1, ["b"]), (2, ["b"])]


def test_records_of_wrong_arity_are_dropped(spark):
    said = '("entity"<|>bob<|>person<|>a man)##("entity"<|>x)##("relationship"<|>zed<|>bob<|>knows<|>k<|>2.5)##("relationship"<|>a<|>a<|>d<|>k<|>1)##("relationship"<|>b<|>a<|>d<|>k<|>none)'
    out = graph.parse_records(spark.createDataFrame([(1, said)], "source long, text string"), "text")
    got = sorted((r["kind"], r["name"], r["other"] or "", r["weight"] or 0.0) for r in out.collect())
    assert got == [("entity", "BOB", "", 0.0), ("relationship", "A", "B", 1.0), ("relationship", "BOB", "ZED", 2.5)]


def test_page_rank_sums_to_one_and_prefers_the_hub(spark):
    e = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 1.0), ("c", "h", 1.0)], "src string, tgt string, weight double")
    r = dict(pairs(graph.page_rank(e, 20), "id", "rank"))
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == "h"


def test_metrics_of_a_perfect_and_an_empty_run(spark):
    qrels = spark.createDataFrame([("q", 1, 2), ("q", 2, 1), ("r", 9, 1)], "qid string, doc_id long, rel int")
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, doc_id long, rank int")
    m = {r["qid"]: r for r in evaluation.metrics(run, qrels, 10).collect()}
    assert m["q"]["recall"] == m["q"]["mrr"] == m["q"]["ap"] == 1 and abs(m["q"]["ndcg"] - 1) < 1e-12 and m["q"]["ndcg_flat"] < 1
    assert [m["r"][c] for c in ("recall", "hit", "mrr", "ap", "ndcg")] == [0, 0, 0, 0, 0]


def test_paging_and_budget(spark):
    df = spark.createDataFrame([("q", i, float(i // 2)) for i in range(10)], "q string, doc_id long, score double")
    assert [r["doc_id"] for r in search.top(df, "q", 3, page=2).orderBy("rank").collect()] == [7, 4, 5]
    ranked = spark.createDataFrame([("q", 1, 60), ("q", 2, 30), ("q", 3, 50)], "q string, rank int, n int")
    assert pairs(search.pack_budget(ranked, "q", "rank", "n", 100), "rank") == [(1,), (2,), (3,)]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(vx.cosine(F.col("a"), F.col("b")).alias("x"), vx.cosine(F.col("a"), F.col("z")).alias("y"), vx.blend(F.col("a"), F.col("z")).alias("w")).first()
    assert abs(r["x"] - 1) < 1e-12 and r["y"] == 0 and abs(r["w"][0] - 0.3) < 1e-12


def test_spaces_stay_beside_letters_of_either_case(spark):
    rows = ["Hello World and New York", "数据 库 的 Test 一", "a ( b ) c", "x  。 y"]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(tx.tight(F.col("s")).alias("t")).collect()]
    assert got == ["Hello World and New York", "数据库的Test一", "a (b) c", "x。y"]


def test_a_failed_write_leaves_the_index(spark):
    s = store.ChunkStore(spark)
    s.drop("safe_t")
    s.create("safe_t", spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Exception):  # noqa: B017
        s.replace("safe_t", spark.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    assert pairs(s.read("safe_t"), "id") == [(1,)]
    s.drop("safe_t")
    assert not s.versions("safe_t")


def test_hybrid_similarity_goes_by_terms_without_vectors(spark):
    rows = [("q", 1, 0.5, [1.0, 0.0], [1.0, 0.0]), ("q", 2, 0.9, [1.0, 0.0], [0.0, 1.0]), ("r", 1, 0.4, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "q string, doc_id long, tok double, a array<double>, b array<double>")
    got = search.hybrid_similarity(df, "q", "tok", "a", "b")
    assert [(x, y, round(z, 9)) for x, y, z in pairs(got, "q", "doc_id", "similarity")] == [("q", 1, 0.65), ("q", 2, 0.63), ("r", 1, 0.4)]
    assert (search.rerank_window(10), search.rerank_window(30), search.rerank_window(100)) == (70, 90, 100)


def test_text_functions(spark):
    df = spark.createDataFrame([("what is the best engine", "Engines", "engine"), (None, "数据库", "数据仓库")], "q string, a string, b string")
    r = df.select(tx.strip_question_words(F.col("q")).alias("s"), tx.alike_names(F.col("a"), F.col("b")).alias("l"), tx.tokens(F.col("q")).alias("t")).collect()
    assert r[0]["s"].split() == ["best", "engine"] and r[0]["l"] and r[1]["l"] and r[1]["t"] == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "t.csv").write_text("name,size\nx,1\ny,\n")
    (tmp_path / "m.eml").write_text("Subject: hi\nFrom: a@b.c\nContent-Type: text/plain\n\nbody text\n")
    assert readers.read_text_files(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    lines = readers.row_lines(readers.read_rows(spark, str(tmp_path / "t.csv")), ["name", "size"])
    assert sorted(r["line"] for r in lines.collect()) == ["name：x; size：1", "name：y"]
    mail = readers.read_mail(spark, str(tmp_path / "m.eml")).first()
    assert (mail["subject"], mail["sender"], mail["text"].strip()) == ("hi", "a@b.c", "body text")
    p = readers.ranked_passages(spark.createDataFrame([("q", ["a", "b"], [0, 1])], "query string, t array<string>, m array<int>"), "query", "t", "m")
    assert pairs(p, "pos", "passage", "mark") == [(0, "a", 0), (1, "b", 1)]


def test_stream_of_tasks_is_idempotent(spark, tmp_path):
    folder, s = str(tmp_path / "in"), store.ChunkStore(spark)
    s.drop("tasks_t")
    for _ in range(2):  # the same tasks arrive twice
        spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "id long, body string, priority int").write.mode("append").parquet(folder)
    tasks = queue.read_tasks(spark, folder, "id long, body string, priority int", 1)
    q = queue.run_tasks(tasks, lambda b: b.withColumn("done", F.upper("body")).drop("priority"), s, "tasks_t", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert pairs(s.read("tasks_t"), "id", "done") == [(1, "X"), (2, "Y")]
    s.drop("tasks_t")
