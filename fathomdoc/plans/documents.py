"""Registered queries over documents, pages and files derived from them."""

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import functions as F

from fathomdoc.functions import payload as P, text as X
from fathomdoc.operators import limits as L
from fathomdoc.operators.chunking import fixed_windows, recursive_chunks, register_splitter
from fathomdoc.operators.embedding import HASH_DIMENSIONS, hashing_embedder
from fathomdoc.operators.skew import union_all
from fathomdoc.operators.sqltool import read_only_sql
from fathomdoc.plans import sql_parts as S
from fathomdoc.plans.registry import query, table
from fathomdoc.session import once, spread, work_folder
from fathomdoc.sources import collection as C, files as FS
from fathomdoc.sources.json_docs import json_documents
from fathomdoc.streaming import jobs

BATCH_MS = 1_700_000_000_000


def long(column):
    return column.cast("bigint")


def documents(spark, folder):
    return table(spark, folder, "documents")


def spread_documents(spark, folder):
    return spread(documents(spark, folder))


def written_texts(spark, folder):
    """The documents as .txt files, one folder per source; files stay small, however large a source is."""
    target = work_folder(spark, "texts")
    documents(spark, folder).select("source", "text").write.partitionBy("source").option(
        "maxRecordsPerFile", 500).text(target)
    return target


def source_of(path):
    return F.regexp_extract(path, r"/source=([^/]+)/", 1)


@query("a1_directory_scan", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def directory_scan(spark, folder):
    found = FS.scan_files(spark, written_texts(spark, folder), [".txt"])
    return found.groupBy(source_of(F.col("path")).alias("source")).agg(F.sum("length").alias("bytes"))


@query("a2_text_scan", """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, 'txt' AS file_type
FROM documents GROUP BY source""")
def text_scan(spark, folder):
    found = FS.read_text_documents(spark, written_texts(spark, folder))
    return found.groupBy(source_of(F.col("source")).alias("source"), "file_type").agg(
        F.sum(long(F.length("text"))).alias("chars"))


@query("a9_k5_extracted_pages", """SELECT source, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT)
  AS pages, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents GROUP BY source""")
def extracted_pages(spark, folder):
    """An extractor that gives one document per line, as a PDF reader gives one per page."""
    def lines(content):
        return [(line, number, {}) for number, line in enumerate(content.decode("utf-8").removesuffix("\n").split("\n"))]

    found, _ = FS.extract_documents(FS.scan_files(spark, written_texts(spark, folder)), {".txt": lines})
    return found.groupBy(source_of(F.col("source")).alias("source")).agg(
        F.count("page").alias("pages"), F.sum(long(F.length("text"))).alias("chars"))


def json_files(df, body):
    return df.select(F.concat(F.lit("/data/"), F.col("doc_id"), F.lit(".json")).alias("path"),
                     long(F.octet_length(body)).alias("length"), body.alias("body"))


PATH = "'/data/' || doc_id || '.json' AS path"


@query("a3_c5_json_content", f"""SELECT {PATH}, text, source, doc_id || '.json' AS file_name, 'json' AS file_type,
  lang, CAST(n_chars AS VARCHAR) AS n_chars, CAST(n_chars > 1000 AS VARCHAR) AS long_text, NULL::VARCHAR AS skipped
FROM documents""")
def json_content(spark, folder):
    body = F.to_json(F.struct(
        F.col("text").alias("content"),
        F.struct(F.lit("nested").alias("source"), "lang", F.lit("path").alias("path")).alias("metadata"),
        "source", "n_chars", (F.col("n_chars") > 1000).alias("long_text"), F.array(F.lit(1)).alias("skipped"),
        F.concat(F.lit("/data/"), "doc_id", F.lit(".json")).alias("path")))
    found, _ = json_documents(json_files(spread_documents(spark, folder), body))
    names = ("path", "lang", "n_chars", "long_text", "skipped")
    return found.select("text", "source", "file_name", "file_type",
                        *[F.element_at("extra", n).alias(n) for n in names])


@query("a4_json_chunks", f"""SELECT {PATH.replace(' AS path', ' AS source')}, CAST(i AS BIGINT) AS chunk_index,
  lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def json_chunks(spark, folder):
    """A number in front of the lines: it is skipped and keeps its position."""
    lines = F.to_json(F.split("text", "\n"))
    body = F.concat(F.lit('{"chunks": ['), F.col("n_chars"), F.lit(","), F.substring(lines, F.lit(2), F.length(lines)),
                    F.lit("}"))
    found, _ = json_documents(json_files(spread_documents(spark, folder), body))
    return found.select("source", long(F.col("chunk_index")).alias("chunk_index"), "text")


@query("a5_json_object", """SELECT '{' || chr(10) || '  "lang": "' || lang || '",' || chr(10) || '  "size": {' || chr(10)
  || '    "n_chars": ' || n_chars || chr(10) || '  },' || chr(10) || '  "doc_id": ' || doc_id || chr(10) || '}' AS text,
  '/data/' || doc_id || '.json' AS source, 'object' AS json_structure FROM documents""")
def json_object(spark, folder):
    body = F.to_json(F.struct("lang", F.struct("n_chars").alias("size"), "doc_id"))
    found, _ = json_documents(json_files(spread_documents(spark, folder), body))
    return found.select("text", "source", "json_structure")


@query("a6_json_array", """SELECT doc_id, 0 AS item_index, text, lang FROM documents
UNION ALL SELECT doc_id, 1, source, NULL FROM documents
UNION ALL SELECT doc_id, 2, CAST(n_chars AS VARCHAR), NULL FROM documents
UNION ALL SELECT doc_id, 3, '[' || chr(10) || '  ' || doc_id || chr(10) || ']', NULL FROM documents""")
def json_array(spark, folder):
    item = F.to_json(F.struct(F.col("text").alias("content"), "lang", F.struct("source").alias("metadata")))
    body = F.concat(F.lit("["), item, F.lit(', "'), F.col("source"), F.lit('", '), F.col("n_chars"), F.lit(", ["),
                    F.col("doc_id"), F.lit("]]"))
    found, _ = json_documents(json_files(spread_documents(spark, folder), body))
    return found.select(long(F.regexp_extract("source", r"(\d+)\.json", 1)).alias("doc_id"), "item_index", "text",
                        F.element_at("extra", "lang").alias("lang"))


@query("a7_json_scalar", """SELECT '/data/' || doc_id || '.json' AS source, '"' || lang || '"' AS text FROM documents""")
def json_scalar(spark, folder):
    found, _ = json_documents(json_files(spread_documents(spark, folder), F.concat(F.lit('"'), "lang", F.lit('"'))))
    return found.select("source", "text")


@query("a8_json_rejects", f"""SELECT {PATH}, CASE WHEN octet_length(encode(b)) > 4000 THEN 'too large' ELSE 'invalid JSON' END
  AS reason FROM (SELECT doc_id, lang, '{{"k": "' || source || repeat('x', CAST(n_chars AS INTEGER)) || '"' ||
  CASE WHEN lang = 'en' THEN '}}' ELSE '' END AS b FROM documents) WHERE octet_length(encode(b)) > 4000 OR lang <> 'en'""")
def json_rejects(spark, folder):
    body = F.concat(F.lit('{"k": "'), "source", F.repeat(F.lit("x"), F.col("n_chars").cast("int")), F.lit('"'),
                    F.when(F.col("lang") == "en", "}").otherwise(""))
    return json_documents(json_files(spread_documents(spark, folder), body), max_bytes=4000)[1]


@query("k4_s1_fixed_windows", f"WITH {S.WINDOWS} SELECT doc_id, chunk_no, content FROM windows")
def windows(spark, folder):
    return fixed_windows(documents(spark, folder), "text").select(
        "doc_id", long(F.col("chunk_no")).alias("chunk_no"), F.col("chunk_text").alias("content"))


@query("k4_d9_recursive_chunks", """SELECT doc_id, source, lang, true AS within_size, true AS from_text,
  true AS covers_ends FROM documents WHERE length(trim(text, E' \\n')) > 0""")
def recursive(spark, folder):
    """What holds for every document: passages fit, are found in the text, and reach from its start to its end."""
    given = once(spread_documents(spark, folder), whole=X.strip(F.col("text")))
    chunks = recursive_chunks(given, "text")
    whole, part = F.col("whole"), F.col("chunk_text")
    return chunks.groupBy("doc_id", "source", "lang").agg(
        F.bool_and(F.length(part) <= 1000).alias("within_size"),
        F.bool_and(F.contains("text", part)).alias("from_text"),
        (F.bool_or(F.startswith(whole, part)) & F.bool_or(F.endswith(whole, part))).alias("covers_ends"))


JOINED = "translate(text, E' \\n\\t\\r', '____')"


@query("k4_lateral_splitter", f"""WITH joined AS (SELECT * REPLACE ({JOINED} AS text) FROM documents),
{S.WINDOWS.replace("FROM documents", "FROM joined")} SELECT doc_id, chunk_no, content FROM windows""")
def lateral_splitter(spark, folder):
    """The splitter inside a guarded statement; without blanks, texts fall into fixed windows, which SQL can say."""
    name, view = register_splitter(spark), "splitter_documents"
    spread_documents(spark, folder).createOrReplaceTempView(view)
    return read_only_sql(spark, f"""SELECT d.doc_id, CAST(p.chunk_no AS BIGINT) AS chunk_no, p.chunk_text AS content FROM {view} d,
        LATERAL {name}(translate(d.text, concat(' ', chr(10), chr(9), chr(13)), '____'), 1000, 200) p""")


IDS = f"""{S.WINDOWS}, hashed AS (
  SELECT doc_id, chunk_no, content, substring(sha256(content), 1, 16) AS h FROM windows)
SELECT doc_id, chunk_no, 'doc_' || h || '_{BATCH_MS}' ||
  CASE WHEN row_number() OVER (PARTITION BY h ORDER BY doc_id, chunk_no) > 1
       THEN '_' || doc_id || '_' || chunk_no ELSE '' END AS id"""


def passages(spark, folder):
    chunks = fixed_windows(spread(documents(spark, folder).select("doc_id", "lang", "source", "text")), "text").drop("text")
    return C.assign_ids(chunks, BATCH_MS, ["doc_id", "chunk_no"])


@query("b1_i1_i2_i3_passage_ids", f"WITH {IDS} FROM hashed")
def passage_ids(spark, folder):
    return passages(spark, folder).select("doc_id", long(F.col("chunk_no")).alias("chunk_no"), "id")


@query("a10_b1_e1_collection_scan", f"WITH {IDS}, content FROM hashed")
def collection_scan(spark, folder):
    """Written in two loads, one of them twice; read back whole."""
    target = work_folder(spark, "collection")
    found = passages(spark, folder)
    for load, part in (("en", F.col("lang") == "en"), ("others", F.col("lang") != "en"), ("en", F.col("lang") == "en")):
        C.append_collection(found.filter(part), target, load)
    return C.read_collection(spark, target).select(
        "doc_id", long(F.col("chunk_no")).alias("chunk_no"), "id", F.col("chunk_text").alias("content"))


@query("b2_e1_cleared_collection", "SELECT 'passages' AS collection_name, count(*) AS document_count FROM documents WHERE false")
def cleared_collection(spark, folder):
    target = work_folder(spark, "collection")
    C.append_collection(passages(spark, folder), target)
    C.clear_collection(spark, target)
    return C.collection_info(C.read_collection(spark, target), "passages", target).drop("persist_directory")


NEEDLE = "THE RE"


@query("b3_c9_rewrite_without_content", f"""WITH {S.WINDOWS} SELECT doc_id, chunk_no, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END)
  OVER () AS BIGINT) AS deleted_count FROM (SELECT *, contains(lower(content), lower('{NEEDLE}')) AS hit FROM windows)
QUALIFY NOT hit""")
def rewrite_without_content(spark, folder):
    target = work_folder(spark, "collection")
    C.append_collection(passages(spark, folder), target)
    deleted = C.delete_by_content(spark, target, NEEDLE)
    return C.read_collection(spark, target).select(
        "doc_id", long(F.col("chunk_no")).alias("chunk_no"), F.lit(deleted).cast("bigint").alias("deleted_count"))


@query("b3_d6_markers_and_compaction", f"""WITH {S.WINDOWS} SELECT source, count(*) AS passages FROM windows
WHERE NOT contains(lower(content), lower('{NEEDLE}')) AND doc_id % 7 <> 0 GROUP BY source""")
def markers_and_compaction(spark, folder):
    """Two loads, passages deleted by content and by id, and one more delete after a compaction."""
    target, found = work_folder(spark, "collection"), passages(spark, folder)
    for number in (0, 1):
        C.append_collection(found.filter(F.col("doc_id") % 2 == number), target, f"half-{number}")
    C.delete_by_content(spark, target, NEEDLE)
    C.compact_collection(spark, target)
    C.delete_ids(spark, target, C.read_collection(spark, target).filter("doc_id % 7 = 0").select("id"))
    return C.read_collection(spark, target).groupBy("source").agg(F.count("*").alias("passages"))


@query("b3_e8_delete_by_content", f"SELECT count(*) AS deleted_count FROM documents WHERE contains(lower(text), lower('{NEEDLE}'))")
def delete_by_content(spark, folder):
    return C.split_by_content(documents(spark, folder), NEEDLE, "text")[1]


@query("d6_delete_by_id", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_id(spark, folder):
    gone = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return C.delete_by_id(documents(spark, folder).withColumnRenamed("doc_id", "id"), gone).select(
        F.col("id").alias("doc_id"), "source")


@query("a13_seed_or_documents", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def seed_or_documents(spark, folder):
    found = documents(spark, folder).select("text", "source", F.col("lang").alias("type"))
    return C.with_seed(found, C.seed_documents(spark)).groupBy("source").agg(F.count("*").alias("n"))


@query("h1_concatenated_formats", """SELECT text, source, NULL::BIGINT AS chunk_index, 'txt' AS file_type FROM documents
WHERE lang = 'fr' UNION ALL SELECT text, '/data/' || doc_id || '.json', 0, 'json' FROM documents WHERE lang <> 'fr'""")
def concatenated_formats(spark, folder):
    found = spread_documents(spark, folder)
    texts = FS.text_documents(found.filter("lang = 'fr'").select(
        F.col("source").alias("path"), F.col("text").alias("body")))
    body = F.to_json(F.struct(F.array("text").alias("chunks")))
    chunks, _ = json_documents(json_files(found.filter("lang <> 'fr'"), body))
    return union_all([texts, chunks]).select("text", "source", long(F.col("chunk_index")).alias("chunk_index"), "file_type")


# Uploads: eight documents each; endings by language, a few not allowed.
UPLOADS = """uploads AS (SELECT doc_id // 8 AS batch, doc_id % 8 AS file_no, n_chars AS size,
  '../' || source || '/' || doc_id || CASE WHEN n_chars < 100 THEN '.exe' WHEN lang = 'en' THEN '.TXT'
    WHEN lang = 'fr' THEN '.pdf' WHEN lang = 'de' THEN '.json' ELSE '.docx' END AS file_name FROM documents)"""
LIMITS = {"max_files": 7, "max_file": 20000, "max_total": 30000}


def uploads(spark, folder):
    ending = (
        F.when(F.col("n_chars") < 100, ".exe").when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "fr", ".pdf")
        .when(F.col("lang") == "de", ".json").otherwise(".docx"))
    return documents(spark, folder).select(
        F.floor(F.col("doc_id") / 8).alias("batch"), (F.col("doc_id") % 8).alias("file_no"), F.col("n_chars").alias("size"),
        F.concat(F.lit("../"), "source", F.lit("/"), "doc_id", ending).alias("file_name"))


JUDGED = f"""{UPLOADS}, judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(lower(file_name), '\\.(txt|pdf|docx|json)$') THEN 'file_type'
    WHEN size > 20000 AND sum(size) OVER (PARTITION BY batch ORDER BY file_no) - size + 20000 <= 30000 THEN 'file_size'
    WHEN sum(size) OVER (PARTITION BY batch ORDER BY file_no) > 30000 THEN 'total_size' END AS r FROM uploads),
verdicts AS (SELECT batch, CASE WHEN count(*) > {{files}} THEN 'file_count' ELSE min_by(r, file_no)
  FILTER (WHERE r IS NOT NULL) END AS reason FROM judged GROUP BY batch)"""


@query("c3_f4_batch_admission", f"WITH {JUDGED.format(files=8)} SELECT batch, reason, reason IS NULL AS admitted FROM verdicts")
def batch_admission(spark, folder):
    return L.admit_batches(uploads(spark, folder), **{**LIMITS, "max_files": 8})


@query("c3_batch_admission_by_count", f"WITH {JUDGED.format(files=7)} SELECT batch, reason, reason IS NULL AS admitted FROM verdicts")
def batch_admission_by_count(spark, folder):
    return L.admit_batches(uploads(spark, folder), **LIMITS)


@query("e3_batch_totals", """SELECT source AS batch, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes,
  max(n_chars) AS max_bytes FROM documents GROUP BY source""")
def batch_totals(spark, folder):
    return L.batch_totals(documents(spark, folder).select(F.col("source").alias("batch"), F.col("n_chars").alias("size")))


@query("b5_ingest_report", f"""WITH {JUDGED.format(files=8)}, {S.WINDOWS},
named AS (SELECT batch, count(*) AS n, '["' || string_agg(file_name, '","' ORDER BY file_no) || '"]' AS file_names
          FROM uploads JOIN verdicts USING (batch) WHERE reason IS NULL GROUP BY batch),
added AS (SELECT doc_id // 8 AS batch, count(*) AS a FROM windows GROUP BY 1)
SELECT batch, file_names, coalesce(a, 0) AS documents_added,
  CASE WHEN coalesce(a, 0) > 0 THEN 'Successfully uploaded and processed ' || n || ' files'
       ELSE 'No processable content found in uploaded files' END AS message
FROM named LEFT JOIN added USING (batch)""")
def ingest_report(spark, folder):
    files = uploads(spark, folder)
    admitted = L.admit_batches(files, **{**LIMITS, "max_files": 8}).filter("admitted").select("batch")
    chunks = fixed_windows(documents(spark, folder), "text")
    return C.ingest_report(files.join(admitted, "batch"), chunks.withColumn("batch", F.floor(F.col("doc_id") / 8)))


@query("c1_h2_extension_filter", f"""WITH {UPLOADS} SELECT file_name, lower(regexp_extract(file_name, '\\.[^./]+$')) AS suffix
FROM uploads WHERE regexp_matches(lower(file_name), '\\.(txt|pdf|docx|json)$')""")
def extension_filter(spark, folder):
    name = F.col("file_name")
    return uploads(spark, folder).filter(X.has_known_suffix(name)).select("file_name", X.suffix(name).alias("suffix"))


@query("c2_d7_path_allow_list", """SELECT page_id, '/' || lang || '/docs' || rtrim(substr(p, 1 + length(lang) + 1), '/') AS path
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p,
  regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS lang FROM pages) WHERE lang IN ('en', 'de')""")
def path_allow_list(spark, folder):
    """Paths such as /en/x/../docs/825 against bases; /en/docs is allowed, /en/docs_old would not be."""
    url = F.col("url")
    part = F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1)
    lang = F.regexp_extract(url, r"^https?://[^/]+/([^/?#]*)", 1)
    rest = F.substring(part, F.length(lang) + 2, F.length(part))
    given = F.concat(F.lit("/"), lang, F.lit("/x/..//./docs"), rest)
    paths = table(spark, folder, "pages").select("page_id", X.resolved_path(given).alias("path"))
    evil = paths.select("page_id", F.regexp_replace("path", "/docs", "/docs_old").alias("path"))
    return paths.union(evil).filter(X.path_under(F.col("path"), ["/en/docs", "", "/de/docs/"]))


@query("c4_i24_safe_name", """SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS name,
  regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages""")
def safe_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.safe_name(F.col("url")).alias("name"), X.scheme(F.col("url")).alias("scheme"))


@query("c5_metadata_overlay", """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'base' END AS source, 'kept' AS kind
FROM documents""")
def metadata_overlay(spark, folder):
    base = F.create_map(F.lit("source"), F.lit("base"), F.lit("kind"), F.lit("kept"))
    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    given = F.when(F.col("lang") == "en", F.create_map(F.lit("source"), "source")).otherwise(empty)
    both = documents(spark, folder).select("doc_id", P.overlay(base, given).alias("m"))
    return both.select("doc_id", F.element_at("m", "source").alias("source"), F.element_at("m", "kind").alias("kind"))


STATUS = """CASE WHEN text = '' THEN 'validation_failed' WHEN length(trim(text, E' \\n')) > 2000 THEN 'question_too_long'
  WHEN length(trim(text, E' \\n')) < 3 THEN 'question_too_short' ELSE 'ok' END"""


@query("c7_i6_question_status", f"""SELECT doc_id, {STATUS} AS status FROM
(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN n_chars > 3000 THEN ''
  WHEN lang = 'fr' THEN '  ' || substring(text, 1, 2) || chr(10) ELSE chr(10) || text || '   ' END AS text FROM documents)""")
def question_status(spark, folder):
    text = (
        F.when(F.col("lang") == "en", F.col("text")).when(F.col("n_chars") > 3000, "")
        .when(F.col("lang") == "fr", F.concat(F.lit("  "), F.substring("text", 1, 2), F.lit("\n")))
        .otherwise(F.concat(F.lit("\n"), "text", F.lit("   "))))
    rows = documents(spark, folder)
    asked = rows.select("doc_id", "text").union(rows.select("doc_id", text))
    return asked.select("doc_id", X.question_status(F.col("text")).alias("status"))


@query("c8_control_characters", "SELECT doc_id, text || chr(9) AS text FROM documents")
def control_characters(spark, folder):
    dirty = F.concat(F.lit("\x00"), F.replace(F.col("text"), F.lit("a"), F.lit("\x07a\u200b")), F.lit("\x7f\t"))
    return documents(spark, folder).select("doc_id", X.sanitize(dirty).alias("text"))


@query("c9_substring_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'er.') OR contains(text, '%')")
def substring_filter(spark, folder):
    hit = X.contains_ignore_case(F.col("text"), F.lit("ER.")) | X.contains_ignore_case(F.col("text"), F.lit("%"))
    return documents(spark, folder).filter(hit).select("doc_id")


@query("c14_blank_filter", "SELECT doc_id FROM documents WHERE length(trim(text, E' \\n')) > 0")
def blank_filter(spark, folder):
    """Every document, and beside it a blank one that goes."""
    rows = documents(spark, folder).select("doc_id", "text")
    blank = rows.withColumn("text", F.lit("  \n\t"))
    return rows.union(blank).filter(~X.is_blank(F.col("text"))).select("doc_id")


@query("e9_documents_per_source", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def documents_per_source(spark, folder):
    return documents(spark, folder).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("i9_h3_keywords", """SELECT item_id, len(w) AS keywords, len(list_distinct(w)) AS different FROM (SELECT item_id,
  list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 2) AS w FROM benchmark)""")
def keywords(spark, folder):
    found = X.keywords(F.col("text"))
    return table(spark, folder, "benchmark").select(
        "item_id", long(F.size(found)).alias("keywords"), long(F.size(F.array_distinct(found))).alias("different"))


# Files in a folder, which a task that lists it holds.
FILES_PER_FOLDER = 1000


def one_file_each(rows, folder):
    """Writes the ``value`` of each row and a blank after it to a file of its own, named by ``doc_id`` and ``ending``;
    rows that share both share the file. A task that runs again writes the same files. Spark's writer would make a folder
    and several renames for each file."""
    def write(part):
        fs, root = pafs.FileSystem.from_uri(folder)
        made, name, out, number = None, None, None, 0
        for doc_id, ending, value in part:
            if name != (doc_id, ending):
                if out:
                    out.close()
                name, at = (doc_id, ending), f"{root}/{ending}/{TaskContext.get().partitionId()}/{number // FILES_PER_FOLDER}"
                number += 1
                if at != made:
                    fs.create_dir(at, recursive=True)
                    made = at
                out = fs.open_output_stream(f"{at}/doc_id={doc_id}.{ending}")
            out.write(((value or "") + " ").encode())
        if out:
            out.close()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    parts = FS.PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    rows.select("doc_id", "ending", "value").repartition(parts, "doc_id").sortWithinPartitions("ending", "doc_id").foreachPartition(write)


def mixed_files(spark, folder):
    """The documents as files of several kinds: text, JSON objects, lists whose second item is no text, blank files,
    lists of numbers and files that are no JSON."""
    target = work_folder(spark, "mixed")
    text = F.to_json(F.struct(F.col("text").alias("content")))
    kind = F.col("doc_id") % 6
    body = (F.when(kind == 0, F.col("text")).when(kind == 1, text).when(kind == 2, F.concat(F.lit("["), text, F.lit(', {"content": 5}, "behind"]')))
            .when(kind == 3, " ").when(kind == 4, '{"chunks": [1, 2]}').otherwise(F.concat(F.lit("{"), "text")))
    ending = F.when(kind.isin(0, 3), "txt").otherwise("json")
    one_file_each(documents(spark, folder).filter("doc_id IS NOT NULL").select("doc_id", ending.alias("ending"), body.alias("value")), target)
    return target


@query("j4_ingest_of_mixed_files", """SELECT outcome, count(*) AS files, sum(doc_id)::BIGINT AS ids FROM (
  SELECT doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN ['passages'] WHEN 1 THEN ['passages'] WHEN 2 THEN ['passages', 'content of an item is no text']
    WHEN 3 THEN ['no text'] WHEN 4 THEN ['no text'] ELSE ['invalid JSON'] END) AS outcome FROM documents) GROUP BY outcome""")
def ingest_of_mixed_files(spark, folder):
    """How each file ends: as passages, or as a reject, or both."""
    files, opened = FS.list_files(spark, mixed_files(spark, folder))
    passages, rejects = jobs.passages_of(files, hashing_embedder, 0, jobs.EXTRACTORS, opened)
    ended = passages.select(F.col("source").alias("path"), F.lit("passages").alias("outcome")).distinct().unionByName(
        rejects.withColumnRenamed("reason", "outcome"))
    doc_id = F.regexp_extract("path", r"doc_id=(-?\d+)", 1).cast("bigint")
    return ended.groupBy("outcome").agg(F.count("*").alias("files"), F.sum(doc_id).alias("ids"))


@query("j4_ingest_stream", """SELECT source, true AS within_size, true AS embedded, true AS different_ids
FROM documents GROUP BY source""")
def ingest_stream(spark, folder):
    """Text files of the documents ingested as a stream, in two runs over the same files: nothing is added twice."""
    target = work_folder(spark, "ingest")
    texts = written_texts(spark, folder)
    for _ in range(2):
        jobs.ingest_stream(spark, texts, target, f"{target}-checkpoint").awaitTermination()
    found = C.read_collection(spark, target)
    return found.groupBy(source_of(F.col("source")).alias("source")).agg(
        F.bool_and(F.length("chunk_text") <= 1000).alias("within_size"),
        F.bool_and(F.size("embedding") == HASH_DIMENSIONS).alias("embedded"),
        (F.countDistinct("id") == F.count("*")).alias("different_ids"))
