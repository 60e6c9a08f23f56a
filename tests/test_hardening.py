"""Inputs that once lost rows or ended a job."""

import time

import pytest
from pyspark.sql import functions as F

from fathomdoc.functions import payload as P
from fathomdoc.operators import answer as A, history as H, limits as L, rerank as R, search as S, sqltool as Q
from fathomdoc.operators.chunking import fixed_windows
from fathomdoc.session import spread
from fathomdoc.sources import collection as C
from fathomdoc.sources.json_docs import json_documents
from fathomdoc.streaming import jobs


def test_null_text_is_kept_by_a_delete(spark):
    kept, deleted = C.split_by_content(spark.createDataFrame([(1, None), (2, "a needle")], "id int, chunk_text string"), "NEEDLE")
    assert [r.id for r in kept.collect()] == [1] and deleted.head()[0] == 1


def test_null_keys_are_keys(spark):
    events = spark.createDataFrame([(None, 0), (None, 10), ("a", 0), ("a", None)], "user string, at int").select(
        "user", F.timestamp_seconds("at").alias("ts"))
    found = L.request_rate(events, "user", "ts", 60, inclusive=True).collect()
    assert sorted((r.user or "", r.demand) for r in found) == [("", 1), ("", 2), ("a", 1)]
    turns = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "user", "y"), (1, 0, "user", "z")],
                                  "conv_id long, turn long, role string, text string")
    assert sorted(r.context for r in H.recent_context(turns).collect()) == ["user: x", "user: x\nuser: y", "user: z"]


@pytest.mark.parametrize("index", ["3000000000", "1e30", '"99999999999999999999"'])
def test_index_beyond_any_list(spark, index):
    items = spark.createDataFrame([(1, 0, f'{{"index": {index}, "score": 0.9}}'), (1, 1, '{"index": 0, "score": 0.5}')],
                                  "query_id int, response_order int, item string")
    candidates = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, cand_idx int, content string")
    found = R.rerank(candidates, R.parse_scores(items)).collect()
    assert [(r.cand_idx, r.rerank_position, r.rerank_score) for r in found] == [(0, 2, 0.5)]
    assert spark.range(1).select(P.rerank_index(P.strict_json(F.lit(index)))).head()[0] is not None


def test_lone_surrogate_beside_a_good_file(spark):
    files = spark.createDataFrame([("/a.json", 10, '{"k": "\\ud800"}'), ("/b.json", 10, '{"content": "good"}')],
                                  "path string, length long, body string")
    documents, rejects = json_documents(files)
    assert "good" in [r.text for r in documents.collect()]
    assert documents.count() + rejects.count() == 2


def test_ragged_vectors_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, embedding array<double>")
    with pytest.raises(Exception, match="different length"):
        S.knn_join(queries, corpus.coalesce(1), 2).collect()
    with pytest.raises(Exception, match="different length"):
        S.knn_join(queries, corpus.filter("chunk_id = 1"), 2).collect()


def test_many_wide_queries_go_through_the_grid(spark):
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("embedding"))
    corpus = spark.range(20).select(F.col("id").alias("chunk_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("embedding"))
    plan = S.knn_join(queries, corpus, 1, broadcast_bytes=300 * 64 * 8)
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().toString()
    assert {(r.query_id, r.chunk_id) for r in plan.collect()} == {(i, min(i, 19)) for i in range(300)}


def test_windows_of_a_long_text_take_linear_time(spark):
    text = "abcdefghij" * 400_000
    frame = spark.createDataFrame([(text,), ("x" * 1801,), ("",), (None,), ("é😀" * 700,)], "text string")
    start = time.perf_counter()
    rows = fixed_windows(frame, "text").select("chunk_no", "chunk_text", F.length("text").alias("n")).collect()
    assert time.perf_counter() - start < 30
    for n, whole in ((4_000_000, text), (1801, "x" * 1801), (1400, "é😀" * 700)):
        own = sorted((r.chunk_no, r.chunk_text) for r in rows if r.n == n)
        assert own == [(i, whole[i * 800 : i * 800 + 1000]) for i in range(1 + max(0, -(-(n - 1000) // 800)))]


def test_files_by_path_are_refused(spark):
    with pytest.raises(Exception, match="(?i)table|view"):
        Q.read_only_sql(spark, "SELECT * FROM text.`/etc/hostname`").collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_summary_of_a_statement(spark):
    rows, summary = Q.guarded_sql(spark, "SELECT id AS a FROM range(5)", max_rows=3)
    assert rows.count() == 3 and tuple(summary.head()) == ("SELECT id AS a FROM range(5)", ["a"], 3, True, 3)
    rows, summary = Q.guarded_sql(spark, "SELECT id AS a FROM range(0)")
    assert rows.columns == ["a"] and summary.head().row_count == 0


def test_order_of_upload_reasons(spark):
    mb = 1_000_000
    files = spark.createDataFrame([("a", i, f"{i}.txt", 9 * mb) for i in range(5)] + [("a", 5, "5.txt", 20 * mb)]
                                  + [("b", 0, "0.txt", 20 * mb)], "batch string, file_no int, file_name string, size long")
    found = {r.batch: r.reason for r in L.admit_batches(files, max_file=10 * mb, max_total=50 * mb).collect()}
    assert found == {"a": "total_size", "b": "file_size"}


def test_unknown_tasks_and_failing_functions(spark):
    templates = spark.createDataFrame([("fix", "Fix: ", None, "!")], "task string, head string, middle string, tail string")
    inputs = spark.createDataFrame([("fix", "good", None), ("other", "x", None), ("fix", "bad", None)],
                                   "task string, first_input string, second_input string")
    prompts = A.task_prompts(inputs, templates)
    assert prompts.count() == 3

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    found = {r.prompt: (r.answer, r.error, r.failure) for r in A.generate(prompts, model).collect()}
    assert found["Fix: good!"] == ("FIX: GOOD!", None, None) and found[None][0] and found[None][1] is None
    assert found["Fix: bad!"] == ("Error processing query. Please try again later.", "internal_error", "RuntimeError: no answer")

    def scorer(queries, contents):
        if "bad" in queries:
            raise RuntimeError
        return [float(len(c)) for c in contents]

    candidates = spark.createDataFrame([(1, "q", 0, "a"), (1, "q", 1, "bb"), (2, "bad", 0, "a"), (2, "bad", 1, "bb")],
                                       "query_id int, question string, cand_idx int, content string")
    scored = candidates.join(R.model_scores(candidates, scorer).drop("response_order"), ["query_id", "cand_idx"])
    best = sorted((r.query_id, r.retrieval_rank, r.cand_idx) for r in R.best_scored(scored).collect())
    assert best == [(1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 1)]


def test_every_ingested_file_ends_somewhere(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = {"a.txt": b"plain text", "b.json": b'{"content": "json text"}'}
    bad = {"c.txt": b"\xff\xfe\x00", "d.json": b"{bad", "e.pdf": b"%PDF", "f.docx": b"no archive", "g.json": b'"' + b"x" * (10 * 1024 * 1024) + b'"'}
    for name, content in (good | bad).items():
        (folder / name).write_bytes(content)
    target = str(tmp_path / "collection")
    jobs.ingest_stream(spark, str(folder), target, str(tmp_path / "cp"), files_per_batch=3).awaitTermination()
    found = {r.source.rsplit("/", 1)[-1] for r in C.read_collection(spark, target).select("source").collect()}
    rejects = {r.path.rsplit("/", 1)[-1]: r.reason for r in jobs.read_rejects(spark, target).collect()}
    assert found == set(good) and set(rejects) == set(bad)
    assert (rejects["c.txt"], rejects["d.json"], rejects["e.pdf"], rejects["g.json"]) == ("not UTF-8", "invalid JSON", "no extractor", "too large")


def test_scans_of_many_splits_are_not_shuffled(spark):
    assert "Exchange" not in spread(spark.range(0, 100, 1, 64))._jdf.queryExecution().toString()
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
