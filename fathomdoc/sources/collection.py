"""A collection: passages with ids, text, metadata and embeddings in a folder of parquet loads.

``<folder>/v<number>/load=<label>``: every append is one load, and writing a load again replaces it, so a repeated
append (a task or a streaming batch that ran twice) changes nothing. A load written again, or compacted, is
``load=<label>~<generation>``; readers take the newest finished generation of each, so they see the old one until the
new one is complete.

Deletes write markers, (load, id) of each deleted passage, beside the loads in ``<folder>/v<number>-deleted``. Readers
leave marked passages out by an anti-join; ``compact_collection`` rewrites only the loads that have markers. A load
that is written again holds what it is then given, marked before or not. One writer at a time.
"""

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from fathomdoc.functions import fixed, text as X
from fathomdoc.operators.late import late_join

FIRST, MARKER = "v000001", "_load string, id string"


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def current_version(spark: SparkSession, folder: str) -> str | None:
    """Newest version with a finished load."""
    versions = sorted((v for v in _children(spark, folder) if re.fullmatch(r"v\d{6}", v)), reverse=True)
    for version in versions:
        loads = [c for c in _children(spark, f"{folder}/{version}") if c.startswith("load=")]
        if any("_SUCCESS" in _children(spark, f"{folder}/{version}/{load}") for load in loads):
            return version
    return None


def assign_ids(chunks: DataFrame, batch_ms: int, key: list[str], text: str = "chunk_text") -> DataFrame:
    """Adds id = doc_<hash>_<ms>. The same text in a later batch is a new row.

    Within the batch, copies of a text after the first (by ``key``, which is unique) get the key as a suffix. Copies are
    counted on hashes and keys alone. The hashes that occur twice are sent to the texts, or, if there are too many, met
    by a shuffle of the texts that may be copies, spread over tasks; a text without a copy is never shuffled.
    """
    hashed = chunks.withColumn("_hash", X.content_hash(F.col(text)))
    copied = (
        hashed.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(F.struct(*key)).alias("_first"))
        .filter("_n > 1").drop("_n")
    )
    marked = late_join(hashed, copied, "_hash", "left", F.struct(*key))
    suffix = F.when(F.col("_first").isNotNull() & (F.col("_first") != F.struct(*key)),
                    F.concat(F.lit("_"), F.concat_ws("_", *[F.col(k).cast("string") for k in key])))
    plain = F.concat(F.lit("doc_"), F.col("_hash"), F.lit(f"_{batch_ms}"))
    return marked.withColumn("id", F.concat(plain, F.coalesce(suffix, F.lit("")))).drop("_hash", "_first")


def _finished(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Names of the complete ``<kind>=...`` folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}=*/_SUCCESS")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getParent().getName().split("=", 1)[1] for s in system.globStatus(path) or [])


def _generation(load: str) -> tuple[str, int]:
    label, _, generation = load.partition("~")
    return label, int(generation or 0)


def _live(spark: SparkSession, folder: str, version: str) -> dict[str, str]:
    """The newest finished generation of each load, by label."""
    loads = sorted(_finished(spark, f"{folder}/{version}", "load"), key=_generation)
    return {_generation(load)[0]: load for load in loads}


def append_collection(passages: DataFrame, folder: str, load: str | None = None) -> None:
    """Adds passages as one load; the same ``load`` label again replaces what it wrote before."""
    spark, label = passages.sparkSession, load or uuid.uuid4().hex
    if "~" in label or "/" in label:
        raise ValueError("a load's label has no ~ and no /")
    version = current_version(spark, folder) or FIRST
    before = _live(spark, folder, version).get(label)
    name = label if before is None else f"{label}~{_generation(before)[1] + 1}"
    passages.write.mode("overwrite").parquet(f"{folder}/{version}/load={name}")


def _stored(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame | None]:
    """The current version, its rows with their ``_load``, and its delete markers."""
    version = current_version(spark, folder)
    if version is None:
        raise ValueError(f"no collection in {folder}")
    loads = [f"{folder}/{version}/load={name}" for name in _live(spark, folder, version).values()]
    rows = spark.read.parquet(*loads).withColumn("_load", F.regexp_extract(F.col("_metadata.file_path"), "/load=([^/]+)/", 1))
    marks = [f"{folder}/{version}-deleted/mark={name}" for name in _finished(spark, f"{folder}/{version}-deleted", "mark")]
    return version, rows, spark.read.schema(MARKER).parquet(*marks) if marks else None


def _unmarked(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Without marked rows. Spark sends the markers to the scan while they are below its own size threshold."""
    return rows if marks is None else rows.join(marks, ["_load", "id"], "left_anti")


def read_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of all loads but the deleted ones, as of now: what is written later is not seen."""
    _, rows, marks = _stored(spark, folder)
    return _unmarked(rows, marks).select(*[c for c in rows.columns if c != "_load"])


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """(_load, id) of the delete markers of the current version."""
    marks = _stored(spark, folder)[2]
    return marks if marks is not None else spark.createDataFrame([], MARKER)


def _next_version(spark: SparkSession, folder: str) -> str:
    return f"{folder}/v{int(current_version(spark, folder)[1:]) + 1:06d}/load=rewrite"


def clear_collection(spark: SparkSession, folder: str) -> int:
    """Empties the collection; gives the rows left, which is 0."""
    read_collection(spark, folder).filter("false").write.mode("overwrite").parquet(_next_version(spark, folder))
    return read_collection(spark, folder).count()


def _hit(text: str, needle: str):
    """A null text contains nothing, so it is kept."""
    return F.coalesce(X.contains_ignore_case(F.col(text), F.lit(needle)), F.lit(False))


def split_by_content(passages: DataFrame, needle: str, text: str = "chunk_text") -> tuple[DataFrame, DataFrame]:
    """Rows kept, and one row with deleted_count: literal, case ignored. An empty needle is refused."""
    if not needle:
        raise ValueError("content to delete must not be empty")
    hit = _hit(text, needle)
    return passages.filter(~hit), passages.agg(F.count_if(hit).alias("deleted_count"))


def _mark(spark: SparkSession, folder: str, version: str, gone: DataFrame) -> int:
    """Writes a marker for each row (_load, id) to delete; gives their number."""
    seen = Observation("markers")
    marks = gone.select("_load", "id").observe(seen, F.count(F.lit(1)).alias("n"))
    marks.write.parquet(f"{folder}/{version}-deleted/mark={uuid.uuid4().hex}")
    return seen.get["n"]


def delete_by_content(spark: SparkSession, folder: str, needle: str, text: str = "chunk_text",
                      max_scan: int = 0) -> int:
    """Marks the matching passages (see ``split_by_content``) as deleted and gives their number, in one scan of their
    texts and ids; nothing else is read or written.

    ``max_scan`` > 0 refuses larger collections.
    """
    if not needle:
        raise ValueError("content to delete must not be empty")
    version, rows, marks = _stored(spark, folder)
    left = _unmarked(rows, marks)
    if max_scan > 0 and left.count() > max_scan:
        raise RuntimeError(f"delete by content is limited to {max_scan} passages")
    return _mark(spark, folder, version, left.filter(_hit(text, needle)))


def delete_ids(spark: SparkSession, folder: str, ids: DataFrame) -> int:
    """Marks the passages with these ids (column ``id``) as deleted; gives their number."""
    version, rows, marks = _stored(spark, folder)
    return _mark(spark, folder, version, _unmarked(rows, marks).join(ids.select("id").distinct(), "id", "left_semi"))


def compact_collection(spark: SparkSession, folder: str) -> list[str]:
    """Rewrites the loads that have markers, without the deleted passages; gives their labels.

    Each is complete before a reader sees it, and loads without markers are not touched. Older generations stay in the
    folder for readers that began with them.
    """
    version, rows, marks = _stored(spark, folder)
    if marks is None:
        return []
    # As many rows as loads with markers.
    marked = {r["_load"] for r in marks.select("_load").distinct().collect()}
    compacted = []
    for label, name in _live(spark, folder, version).items():
        if name in marked:
            own = spark.read.parquet(f"{folder}/{version}/load={name}").withColumn("_load", F.lit(name))
            kept = _unmarked(own, marks.filter(F.col("_load") == name)).select(*[c for c in own.columns if c != "_load"])
            kept.write.mode("overwrite").parquet(f"{folder}/{version}/load={label}~{_generation(name)[1] + 1}")
            compacted.append(label)
    return compacted


def delete_by_id(passages: DataFrame, ids: DataFrame) -> DataFrame:
    return passages.join(ids, "id", "left_anti")


def collection_info(passages: DataFrame, name: str, folder: str) -> DataFrame:
    """collection_name, document_count (passages, not files) and persist_directory."""
    return passages.agg(F.count("*").alias("document_count")).select(
        F.lit(name).alias("collection_name"), "document_count", F.lit(folder).alias("persist_directory"))


def seed_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.SEED_DOCUMENTS, "text string, source string, type string")


def with_seed(documents: DataFrame, seed: DataFrame) -> DataFrame:
    """The documents, or the seed while there are none."""
    return seed if documents.isEmpty() else documents


def ingest_report(files: DataFrame, passages: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, message, documents_added and file_names (JSON list in upload order) per admitted batch.

    ``files`` (batch, file_no, file_name) holds admitted batches only, so names per batch are few.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("file_no", "file_name"))), lambda f: f["file_name"])
    named = files.groupBy(batch).agg(F.count("*").alias("_files"), F.to_json(listed).alias("file_names"))
    added = passages.groupBy(batch).agg(F.count("*").alias("_added"))
    message = F.when(
        F.col("documents_added") > 0,
        F.format_string(fixed.UPLOADED, F.col("_files")),
    ).otherwise(fixed.NOTHING_UPLOADED)
    return (
        named.join(added, batch, "left")
        .withColumn("documents_added", F.coalesce("_added", F.lit(0)))
        .select(batch, message.alias("message"), "documents_added", "file_names")
    )
