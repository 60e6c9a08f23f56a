"""Directory, text and binary file scans.

Spark itself skips names that begin with '_' or '.'. Object stores have no symbolic links; on a file system that
has them, keep links out of the folder, as Spark follows them.
"""

from collections.abc import Callable, Iterator
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomdoc.functions import fixed, text as X
from fathomdoc.operators.skew import union_all
from fathomdoc.schemas import EXTRACTED, READ
from fathomdoc.session import written

# bytes of one file -> list of (text, page or None, extra metadata)
Extractor = Callable[[bytes], list[tuple[str, int | None, dict[str, str]]]]
# path of a file -> its bytes
Opener = Callable[[str], bytes]
# Parts for each core in which many small files are listed, read or written.
PARTS_PER_CORE = 4
# Files and bytes in a part of a large listing: what is read from a part is later sent to workers in batches of many rows.
FILES_PER_PART, BYTES_PER_PART = 10_000, 1 << 26
# What leaves a worker together: names of a listing, and rows and characters of files that were read.
NAMES_AT_ONCE, ROWS_AT_ONCE, CHARACTERS_AT_ONCE = 10_000, 1000, 1 << 22


def plain_path(uri: Column) -> Column:
    """Local path of a file URI; other URIs stay as they are, decoded."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def scan_files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, length, modificationTime and content of the files below ``path`` with a known ending.

    Content is only read where it is selected. A missing folder is an error when the plan is made.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return (
        found.withColumn("path", plain_path(F.col("path")))
        .filter(X.suffix(F.col("path")).isin(extensions or fixed.EXTENSIONS))
    )


class Folder:
    """A folder that tasks list and read by Arrow's file systems; each process opens it for itself. Paths are as those of
    ``plain_path``."""

    def __init__(self, uri: str):
        self.uri = uri
        self.system, root = pafs.FileSystem.from_uri(uri)
        self.root = root.rstrip("/")
        self.shown = self.root if isinstance(self.system, pafs.LocalFileSystem) else uri.rstrip("/")

    def __reduce__(self):
        return Folder, (self.uri,)

    def children(self, name: str) -> list[tuple[str, int | None, bool]]:
        """(name, length, whether it is a folder) of what is in the folder ``name`` below this one; names as Spark's readers
        take them."""
        found = self.system.get_file_info(pafs.FileSelector(f"{self.root}/{name}".rstrip("/")))
        return [(f"{name}/{f.base_name}".lstrip("/"), f.size, f.type == pafs.FileType.Directory) for f in found
                if f.type in (pafs.FileType.Directory, pafs.FileType.File)
                and not f.base_name.startswith(".") and (not f.base_name.startswith("_") or "=" in f.base_name)]

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(self.root + path.removeprefix(self.shown)) as file:
            return file.read()


def list_files(spark: SparkSession, folder: str) -> tuple[DataFrame, Opener]:
    """path and length of every file below ``folder``, dealt out in parts for each core, or more if these would be large, and
    what reads one of them in a task.

    For more files than the driver can hold, as Spark's own readers list all of them there and send their names with the
    tasks. Here each round lists the folders that the round before found, in tasks, and writes what it finds; a task
    holds the names of one folder at a time. A missing folder is an error at once.
    """
    below, parts = Folder(folder), PARTS_PER_CORE * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = below.children(name)
                for at in range(0, len(found), NAMES_AT_ONCE):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found[at:at + NAMES_AT_ONCE]), (pa.string(), pa.int64(), pa.bool_()))],
                        ["name", "length", "is_folder"])

    folders, files = spark.createDataFrame([("",)], "name string"), []
    while not files or not folders.isEmpty():
        found = written(folders.mapInArrow(run, "name string, length long, is_folder boolean"), "listed")
        files.append(found.filter("NOT is_folder"))
        folders = found.filter("is_folder").select("name").repartition(parts)
    path = F.concat(F.lit(f"{below.shown}/"), "name")
    listed = union_all(files).select(path.alias("path"), "length")
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    return listed.repartition(max(parts, -(-count // FILES_PER_PART), -(-size // BYTES_PER_PART))), below.read


def decoded_files(files: DataFrame) -> DataFrame:
    """Binary files as path, length, body; body is null where the bytes are not UTF-8."""
    return files.select("path", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("body"))


def text_documents(files: DataFrame) -> DataFrame:
    """One document per file (path, body)."""
    path = F.col("path")
    return files.filter(F.col("body").isNotNull()).select(
        F.col("body").alias("text"), path.alias("source"), F.lit("txt").alias("file_type"),
        X.base_name(path).alias("file_name"))


def _read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and body of every .txt file below ``path``, whatever the case of its ending; body is null where the bytes
    are not UTF-8."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]")
        .text(path, wholetext=True)
    )
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.try_validate_utf8("value").alias("body"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every .txt file below ``path`` as one document; files that are not UTF-8 are in ``text_rejects``."""
    return text_documents(_read_texts(spark, path))


def text_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the .txt files below ``path`` that ``read_text_documents`` leaves out."""
    return _read_texts(spark, path).filter("body IS NULL").select("path", F.lit("not UTF-8").alias("reason"))


def docx_text(content: bytes) -> list[tuple[str, int | None, dict[str, str]]]:
    """Paragraph texts of a .docx file, joined by blank lines."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    blanks = {f"{name}tab": "\t", f"{name}br": "\n", f"{name}cr": "\n"}
    paragraphs = [
        "".join(e.text or "" if e.tag == f"{name}t" else blanks.get(e.tag, "") for e in p.iter())
        for p in body.iter(f"{name}p")]
    return [("\n\n".join(paragraphs), None, {})]


def read_files(files: DataFrame, extractors: dict[str, Extractor], max_json_bytes: int, opened: Opener | None = None) -> DataFrame:
    """What is in files (path, length, content), in one pass: a row with ``body`` for each text and JSON file, a row
    with text, page and extra for each document that an extractor finds, and a row with ``reason`` for each file that
    cannot be read. Every file gives a row at least.

    With ``opened`` the files need no content: it gives the bytes of a path, one file at a time, if they are wanted.
    """

    def rows_of(path: str, ending: str, length: int, content: bytes | None) -> list[tuple]:
        body = reason = None
        if ending not in extractors and ending not in (".txt", ".json"):
            reason = "no extractor"
        elif ending not in extractors and ending == ".json" and length > max_json_bytes:
            reason = "too large"
        else:
            content = bytes(content) if opened is None else opened(path)
            if ending in extractors:
                try:
                    rows = [(path, ending, length, None, text, page, {k: str(v) for k, v in extra.items()}, None)
                            for text, page, extra in extractors[ending](content)]
                    if rows:
                        return rows
                    reason = "no text"
                except Exception as error:  # any reader, any file
                    reason = f"{type(error).__name__}: {error}"
            else:
                try:
                    body = content.decode()
                except UnicodeDecodeError:
                    reason = "not UTF-8"
        return [(path, ending, length, body, None, None, None, reason)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=READ.names)
        out["page"] = out["page"].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path, ending, length, content in batch.itertuples(index=False):
                rows = rows_of(path, ending, length, content)
                held += rows
                size += sum(len(r[3] or r[4] or "") for r in rows)
                if len(held) >= ROWS_AT_ONCE or size >= CHARACTERS_AT_ONCE:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    content = F.col("content") if opened is None else F.lit(None).cast("binary").alias("content")
    return files.select("path", X.suffix(F.col("path")).alias("ending"), "length", content).mapInPandas(run, READ)


def extract_documents(files: DataFrame, extractors: dict[str, Extractor]) -> tuple[DataFrame, DataFrame]:
    """Documents and failures of files (path, content), by ending: ``{".docx": docx_text, ".pdf": ...}``.

    A file that cannot be read gives a row among the failures and stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ending, content in batch.itertuples(index=False):
                try:
                    rows = [(path, text, page, {k: str(v) for k, v in extra.items()}, None)
                            for text, page, extra in extractors[ending](bytes(content))]
                except Exception as error:  # any reader, any file
                    rows = [(path, None, None, None, f"{type(error).__name__}: {error}")]
                out = pd.DataFrame(rows, columns=EXTRACTED.names)
                out["page"] = out["page"].astype("Int32")
                yield out

    wanted = files.select("path", X.suffix(F.col("path")).alias("ending"), "content")
    read = wanted.filter(F.col("ending").isin(list(extractors))).mapInPandas(run, EXTRACTED)
    path = F.col("path")
    documents = read.filter("error IS NULL").select(
        "text", path.alias("source"), F.ltrim(X.suffix(path), F.lit(".")).alias("file_type"),
        X.base_name(path).alias("file_name"), "page", "extra")
    return documents, read.filter("error IS NOT NULL").select("path", F.col("error").alias("reason"))
