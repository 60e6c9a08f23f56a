import io
import json
import zipfile

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from fathomdoc.functions import text as X
from fathomdoc.operators.chunking import fixed_windows, recursive_chunks, split_text
from fathomdoc.operators.embedding import embed, hashing_embedder
from fathomdoc.sources import collection as C, files as FS
from fathomdoc.sources.catalog import jdbc_options, list_tables, postgres_url, table_count
from fathomdoc.sources.json_docs import json_documents, read_json_documents
from fathomdoc.streaming import jobs


@pytest.mark.parametrize("text, sizes", [
    ("", []), ("  \n ", []), ("a" * 1000, [1000]), ("a" * 1001, [1000, 201]), ("a" * 1800, [1000, 1000]),
    ("a" * 1801, [1000, 1000, 201]), ("b" * 600 + "\n\n" + "c" * 600, [600, 600]),
    ("\n".join(chr(65 + i) * 100 for i in range(12)), [908, 403]), ("字" * 3000, [1000, 1000, 1000, 600]),
])
def test_split_sizes(text, sizes):
    assert [len(c) for c in split_text(text, 1000, 200)] == sizes


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_split_properties(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for chunk in chunks:
        at = text.find(chunk, max(0, at))
        assert at >= 0
    assert "".join(text.split()) == "" or chunks


def test_windows_equal_splitter_without_separators(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 999, 1000, 1001, 1800, 1801, 5000)], "id int, text string")
    fixed = fixed_windows(df, "text").select("id", "chunk_no", "chunk_text").collect()
    split = recursive_chunks(df, "text").select("id", "chunk_no", "chunk_text").collect()
    assert sorted(fixed) == sorted(split)


JSON_CASES = {
    "content": ('{"content":"x","metadata":{"a":1,"source":"m"},"source":"t","n":2,"l":[1],"z":null}',
                [("x", "t", None, None, None, {"a": "1", "n": "2"})]),
    "chunks": ('{"chunks":["a",2,"c"]}', [("a", None, 0, None, None, {}), ("c", None, 2, None, None, {})]),
    "nolist": ('{"chunks":"a"}', [('{\n  "chunks": "a"\n}', None, None, None, "object", {})]),
    "object": ('{"k":{"n":1}}', [('{\n  "k": {\n    "n": 1\n  }\n}', None, None, None, "object", {})]),
    "array": ('[{"content":"x","n":1,"metadata":{"a":1}},"s",5,{"k":1}]', [
        ("x", None, None, 0, None, {"n": "1"}), ("s", None, None, 1, None, {}), ("5", None, None, 2, None, {}),
        ('{\n  "k": 1\n}', None, None, 3, None, {})]),
    "scalar": ('"hello"', [('"hello"', None, None, None, None, {})]),
    "empty": ("[]", []),
    "aborted": ('[{"content":"q"},{"content":5},"z"]', [("q", None, None, 0, None, {})]),
}


def test_json_shapes(spark, tmp_path):
    for name, (body, _) in JSON_CASES.items():
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    (tmp_path / "bad.JSON").write_text("{bad", encoding="utf-8")
    (tmp_path / "more.json").write_text('{"content":"a"} x', encoding="utf-8")
    (tmp_path / "exact.json").write_text(json.dumps("y" * 298), encoding="utf-8")
    (tmp_path / "big.json").write_text(json.dumps("y" * 299), encoding="utf-8")
    (tmp_path / "latin.json").write_bytes('{"content":"é"}'.encode("latin-1"))
    documents, rejects = read_json_documents(spark, str(tmp_path), max_bytes=300)
    found = {}
    for r in documents.orderBy("chunk_index", "item_index").collect():
        name = r.file_name.removesuffix(".json")
        plain = r.source if r.source != str(tmp_path / r.file_name) else None
        found.setdefault(name, []).append((r.text, plain, r.chunk_index, r.item_index, r.json_structure, r.extra))
    assert len(found.pop("exact")) == 1
    assert found == {k: v for k, (_, v) in JSON_CASES.items() if v}
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    # A list that ends early at an item whose content is no text is told of, beside the items before it.
    cut = {name for name, (body, _) in JSON_CASES.items() if body.startswith("[") and any(
        isinstance(i, dict) and not isinstance(i.get("content", ""), str) for i in json.loads(body))}
    assert {n.removesuffix(".json") for n, r in reasons.items() if r == "content of an item is no text"} == cut and cut
    reasons = {n: r for n, r in reasons.items() if n.removesuffix(".json") not in cut}
    assert reasons == {"bad.JSON": "invalid JSON", "more.json": "invalid JSON", "big.json": "too large",
                       "latin.json": "invalid JSON"}


def test_duplicate_keys(spark):
    body = '{"content":"a","content":"b"}'
    df = spark.createDataFrame([("/x.json", len(body), body)], "path string, length long, body string")
    assert json_documents(df)[0].count() == 0
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    try:
        assert json_documents(df)[0].head()["text"] == "b"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_directory_scan_and_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b+c.txt").write_text("one\ntwo")
    (tmp_path / "B.TXT").write_text("big")
    (tmp_path / "sub" / "d.docx").write_bytes(docx("first", "second"))
    (tmp_path / "sub" / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "e.md").write_text("ignored")
    files = FS.scan_files(spark, str(tmp_path))
    names = {p.rsplit("/", 1)[1] for (p,) in files.select("path").collect()}
    assert names == {"a b+c.txt", "B.TXT", "d.docx", "broken.docx"}
    texts = {r.file_name: (r.text, r.file_type, r.source)
             for r in FS.read_text_documents(spark, str(tmp_path)).collect()}
    assert texts["a b+c.txt"] == ("one\ntwo", "txt", str(tmp_path / "a b+c.txt")) and texts["B.TXT"][0] == "big"
    documents, failures = FS.extract_documents(files, {".docx": FS.docx_text})
    assert [(r.text, r.file_type, r.file_name) for r in documents.collect()] == [("first\n\nsecond", "docx", "d.docx")]
    assert [r.path.rsplit("/", 1)[1] for r in failures.collect()] == ["broken.docx"]
    with pytest.raises(Exception):
        FS.scan_files(spark, str(tmp_path / "missing"))


def test_paths_and_names(spark):
    def value(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).head()[0]

    assert value(X.resolved_path, "/a/./b/../../../c//d/") == "/c/d"
    assert [value(X.suffix, t) for t in ("x/A.TXT", ".txt", "a.b/c", "a.tar.gz")] == [".txt", "", "", ".gz"]
    assert [value(X.safe_name, t) for t in ("../x.txt", "..", "a/.", "", "dir/")] == ["x.txt", None, None, None, "dir"]
    allowed = lambda c: X.path_under(c, ["/app/docs", ""])
    assert [value(allowed, t) for t in ("/app/docs", "/app/docs/a", "/app/docs_evil/a", "/app")] == [
        True, True, False, False]
    for text in ("ab\x00", "a​b c", "tab\t\x1c\x85x", "­\U000e0001k"):
        assert value(X.sanitize, text) == "".join(c for c in text if c.isprintable() or c.isspace())
        padded = " \x1f " + text + "　\x85"
        assert value(X.strip, padded) == padded.strip()


def test_question_status(spark):
    cases = [("", "validation_failed"), (None, "validation_failed"), ("  ", "question_too_short"),
             ("ab", "question_too_short"), ("abc", "ok"), ("x" * 2000, "ok"), (" " + "x" * 2000 + "\n", "ok"),
             ("x" * 2001, "question_too_long"), ("ab\x00", "ok")]
    df = spark.createDataFrame([(q,) for q, _ in cases], "q string").select("q", X.question_status(F.col("q")))
    assert [tuple(r) for r in df.collect()] == cases


def test_embedding_calls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "b a")], "id int, text string")
    rows = {r.id: r.embedding for r in embed(df, "text").collect()}
    assert rows[2] is None and rows[1] == rows[4] and not any(rows[3])
    assert abs(sum(v * v for v in rows[1]) - 1) < 1e-6
    assert len(hashing_embedder([])) == 0
    with pytest.raises(Exception, match="vectors for"):
        embed(df, "text", lambda texts: []).collect()


def test_collection_life(spark, tmp_path):
    folder = str(tmp_path / "c")
    df = spark.createDataFrame([(i, 0, f"text {i % 3}") for i in range(9)], "doc_id int, chunk_no int, chunk_text string")
    passages = C.assign_ids(df, 5, ["doc_id", "chunk_no"])
    ids = [r.id for r in passages.orderBy("doc_id").collect()]
    assert len(set(ids)) == 9 and ids[0].endswith("_5") and ids[3].endswith("_5_3_0")
    assert C.current_version(spark, folder) is None
    C.append_collection(passages, folder, "one")
    C.append_collection(passages, folder, "one")
    C.append_collection(passages, folder)
    assert C.read_collection(spark, folder).count() == 18
    with pytest.raises(RuntimeError):
        C.delete_by_content(spark, folder, "TEXT 1", max_scan=5)
    with pytest.raises(ValueError):
        C.delete_by_content(spark, folder, "")
    assert C.delete_by_content(spark, folder, "TEXT 1") == 6
    assert C.read_collection(spark, folder).count() == 12
    assert C.delete_by_content(spark, folder, "t_xt%") == 0
    assert C.clear_collection(spark, folder) == 0
    seeded = C.with_seed(C.read_collection(spark, folder), C.seed_documents(spark))
    assert seeded.count() == 4


def test_ingest_stream_picks_up_new_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha " * 400)
    (tmp_path / "in" / "b.json").write_text('["same", "same", {"content": "c", "lang": "en"}]')
    jobs.ingest_stream(spark, source, target, state).awaitTermination()
    first = C.read_collection(spark, target)
    assert first.filter("file_type = 'txt'").count() == len(split_text("alpha " * 400, 1000, 200))
    assert first.filter("file_type = 'json'").select("id").distinct().count() == 3
    (tmp_path / "in" / "d.docx").write_bytes(docx("new"))
    jobs.ingest_stream(spark, source, target, state).awaitTermination()
    assert C.read_collection(spark, target).filter("chunk_text = 'new'").count() == 1


def test_catalog_and_jdbc(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS some_db LOCATION '%s'" % (tmp_path / "db"))
    spark.range(1).write.mode("overwrite").saveAsTable("some_db.numbers", path=str(tmp_path / "t"))
    spark.range(1).createOrReplaceTempView("only_a_view")
    try:
        tables = list_tables(spark)
        assert ("some_db", "numbers") in [tuple(r) for r in tables.collect()]
        assert "only_a_view" not in [r.table_name for r in tables.collect()]
        assert table_count(tables).head()[0] == tables.count()
    finally:
        spark.sql("DROP TABLE some_db.numbers")
    plain = jdbc_options(postgres_url("h", "d"), "SELECT 1", user="u", password="p@ss", timeout_ms=5000)
    assert plain["queryTimeout"] == "5" and plain["query"] == "SELECT 1" and "READ ONLY" in plain["sessionInitStatement"]
    split = jdbc_options("jdbc:x", "SELECT 1", bounds=("id", 0, 100, 8))
    assert split["dbtable"] == "(SELECT 1) AS q" and split["numPartitions"] == "8" and "query" not in split
