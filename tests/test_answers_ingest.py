import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from fathomdoc.functions import fixed
from fathomdoc.operators import sqltool as Q
from fathomdoc.operators.embedding import hashing_embedder
from fathomdoc.plans.answering import answer_questions
from fathomdoc.plans import documents  # noqa: F401
from fathomdoc.plans.registry import QUERIES
from fathomdoc.sources.files import PARTS_PER_CORE, list_files, read_files
from fathomdoc.sources.json_docs import json_documents
from fathomdoc.streaming import jobs

PASSAGES = [("p1", "the red fox jumps", None, {"page": "1"}), ("p2", "a blue whale swims", "sea.txt", {"page": "2"})]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(PASSAGES, "passage_id string, content string, source string, metadata map<string,string>")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, question string")


def test_failed_refused_and_unanswered_questions(spark, passages):
    def model(prompts):
        if any("whale" in p.split(fixed.PROMPT_QUESTION)[1] for p in prompts):
            raise RuntimeError("secret host name")
        return ["fine " for _ in prompts]

    rows = [(1, "where is the red fox"), (2, "whale?"), (3, " x "), (4, None), (5, "y" * 2001)]
    found = {r.query_id: r for r in answer_questions(asked(spark, rows), passages, generator=model).collect()}
    assert (found[1].answer, found[1].error, len(found[1].sources)) == ("fine", None, 2)
    assert sorted(s.metadata["page"] for s in found[1].sources) == ["1", "2"]
    assert {s.source for s in found[1].sources} == {"Unknown", "sea.txt"} and [s.retrieval_rank for s in found[1].sources] == [1, 2]
    assert (found[2].answer, found[2].error, found[2].sources) == (fixed.REFUSALS["internal_error"], "internal_error", [])
    for number, status in ((3, "question_too_short"), (4, "validation_failed"), (5, "question_too_long")):
        assert (found[number].answer, found[number].error, found[number].sources) == (fixed.REFUSALS[status], status, [])
    none = answer_questions(asked(spark, rows[:1]), passages.filter("false")).head()
    assert (none.answer, none.sources, none.error) == (fixed.NO_DOCUMENTS, [], None)


def test_the_limit_comes_first(spark, passages):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "?" if i < 2 else "where is the fox", start + dt.timedelta(seconds=i)) for i in range(12)] + [(99, "where is the fox", None)]
    questions = spark.createDataFrame(rows, "query_id long, question string, asked_at timestamp_ntz")
    found = {r.query_id: (r.error, r.answer) for r in answer_questions(questions, passages).collect()}
    assert found[10] == ("rate_limited", "Rate limit exceeded. Please try again in 50 seconds.")
    assert found[11][0] == "rate_limited" and found[0][0] == "question_too_short" and found[9][0] is None and found[99][0] is None


def test_slow_statement_is_interrupted_and_the_session_goes_on(spark):
    # Python keeps Spark from knowing the sum beforehand.
    spark.udf.register("slowly", lambda x: time.sleep(0.05) or x, "long")
    started = time.time()
    rows, summary = Q.query_database(spark, "SELECT sum(slowly(id)) AS s FROM range(100000)", timeout_ms=1500)
    assert rows is None and summary.head().error == "Query timed out or was canceled" and time.time() - started < 60
    rows, summary = Q.query_database(spark, "SELECT 1 AS one /* quick */;")
    assert rows.collect() == [(1,)] and summary.head().error is None and summary.head().sql == "SELECT 1 AS one"


@pytest.mark.parametrize("sql, error", [
    ("DROP TABLE t", fixed.NOT_READ_ONLY), ("SELECT nothing FROM nowhere", "Invalid query syntax"), ("SELECT FROM WHERE", "Invalid query syntax"),
    ("SELECT 1 / id FROM range(2)", "Invalid data format"), ("SELECT CAST('x' AS INT)", "Invalid data format")])
def test_errors_have_labels(spark, sql, error):
    rows, summary = Q.query_database(spark, sql)
    assert rows is None and (summary.head().error, summary.head()["columns"], summary.head().row_count) == (error, [], 0)


def test_items_behind_a_bad_one_are_told(spark):
    body = '[{"content":"first"},{"content":5},{"content":"third"}]'
    files = spark.createDataFrame([("/a.json", len(body), body), ("/b.json", 9, '["x","y"]')], "path string, length long, body string")
    documents, rejects = json_documents(files)
    assert sorted(r.text for r in documents.collect()) == ["first", "x", "y"]
    assert [tuple(r) for r in rejects.collect()] == [("/a.json", "content of an item is no text")]


def test_every_file_ends_and_is_extracted_once(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def extract(content):
        counted.add(1)
        return [(content.decode(), 1, {}), (content.decode() + " again", 2, {})] if content else []

    contents = {"/a.txt": b"text", "/b.txt": b"", "/c.txt": b" \n\t", "/d.json": b"[]", "/e.json": b'{"chunks":[1,2]}', "/f.pdf": b"page", "/g.pdf": b"",
                "/h.json": b'["kept",{"content":1}]', "/i.odt": b"?", "/j.json": b"\xff", "/k.json": b'{"content":" "}'}
    files = spark.createDataFrame([(p, None, len(c), bytearray(c)) for p, c in contents.items()], jobs.FILES)
    passages, rejects = jobs.passages_of(files, hashing_embedder, 0, {".pdf": extract})
    found = sorted((r.source, r.chunk_text) for r in passages.collect())
    assert found == [("/a.txt", "text"), ("/f.pdf", "page"), ("/f.pdf", "page again"), ("/h.json", "kept")]
    told = sorted(map(tuple, rejects.collect()))
    assert told == sorted([("/b.txt", "no text"), ("/c.txt", "no text"), ("/d.json", "no text"), ("/e.json", "no text"), ("/g.pdf", "no text"),
                           ("/h.json", "content of an item is no text"), ("/i.odt", "no extractor"), ("/j.json", "not UTF-8"), ("/k.json", "no text")])
    # The checkpoint is made of one pass over the files, and both results of the checkpoint.
    assert counted.value <= 4


def test_many_files_are_read_in_few_parts(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}") for i in range(1500)] + [(7, "again"), (6, None), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    parts = []

    def passages_of(files, *rest):
        parts.append(files.rdd.getNumPartitions())
        return known(files, *rest)

    known = jobs.passages_of
    monkeypatch.setattr(jobs, "passages_of", passages_of)
    found = {r.outcome: (r.files, r.ids) for r in QUERIES["j4_ingest_of_mixed_files"](spark, str(tmp_path)).collect()}
    assert parts[0] <= 4 * spark.sparkContext.defaultParallelism

    def of(*kinds):
        ids = [i for i in range(1500) if i % 6 in kinds and i != 7]
        return len(ids), sum(ids)

    # Two rows share a file: a second value after the JSON of document 7 makes it no JSON.
    assert found == {"passages": of(0, 1, 2), "content of an item is no text": of(2), "no text": of(3, 4), "invalid JSON": (of(5)[0] + 1, of(5)[1] + 7)}


def test_the_driver_holds_no_names_of_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    listed = []

    def passages_of(files, *rest):
        listed.extend(files.inputFiles())
        return known(files, *rest)

    known = jobs.passages_of
    monkeypatch.setattr(jobs, "passages_of", passages_of)
    found = {r.outcome: r.files for r in QUERIES["j4_ingest_of_mixed_files"](spark, str(tmp_path)).collect()}
    assert found == {"passages": 30, "content of an item is no text": 10, "no text": 20, "invalid JSON": 10}
    assert listed and not [name for name in listed if "doc_id" in name]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_files_are_listed_and_read_in_tasks(spark, tmp_path, scheme):
    contents = {"a.txt": b"one", "b b/c%20+.json": b'"two"', "b b/d/e/f.TXT": b"", "b b/d/_k=1/g.odt": b"?", "b b/d/big.json": b" " * 30,
                "_hidden/h.txt": b"no", ".i.txt": b"no", "b b/_j.txt": b"no"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").mkdir()
    files, opened = list_files(spark, f"{scheme}{tmp_path}")
    seen = {n: c for n, c in contents.items() if not n.startswith(("_", ".")) and "/_j" not in n}
    assert sorted(map(tuple, files.select("path", "length").collect())) == sorted((f"{tmp_path}/{n}", len(c)) for n, c in seen.items())
    assert opened(f"{tmp_path}/b b/c%20+.json") == b'"two"'
    wanted = spark.sparkContext.accumulator(0)

    def counted(path):
        wanted.add(1)
        return opened(path)

    read = {r.path.removeprefix(f"{tmp_path}/"): (r.body, r.reason) for r in read_files(files, {}, 20, counted).collect()}
    assert read == {"a.txt": ("one", None), "b b/c%20+.json": ('"two"', None), "b b/d/e/f.TXT": ("", None),
                    "b b/d/_k=1/g.odt": (None, "no extractor"), "b b/d/big.json": (None, "too large")}
    assert wanted.value == 3
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, f"{scheme}{tmp_path}/nowhere")


def test_files_of_a_task_leave_in_several_batches(spark):
    texts = [f"text {i}" * (200_000 if i % 1000 == 7 else 1) for i in range(2500)]
    rows = [(f"/{i}.txt", None, len(t), bytearray(t.encode())) for i, t in enumerate(texts)]
    read = read_files(spark.createDataFrame(rows, jobs.FILES).coalesce(1), {}, 1 << 30).collect()
    assert sorted((r.path, r.body) for r in read) == sorted((f"/{i}.txt", t) for i, t in enumerate(texts))


def test_parts_of_a_listing_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text("x" * 10)
    few = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert list_files(spark, str(tmp_path))[0].rdd.getNumPartitions() == few
    monkeypatch.setattr("fathomdoc.sources.files.FILES_PER_PART", 2)
    assert list_files(spark, str(tmp_path))[0].rdd.getNumPartitions() == 100
    monkeypatch.setattr("fathomdoc.sources.files.BYTES_PER_PART", 15)
    files, _ = list_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 134 and files.distinct().count() == 200
