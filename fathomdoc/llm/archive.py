"""Content-addressed web archive: payload bytes once per digest, exact record headers apart, records by a join.

A folder of the archive holds two Parquet tables. ``payloads`` has one row for each distinct payload, keyed by its
SHA-256; payloads count as equal only if SHA-256, SHA-1 and length all agree, and all three are computed anew from the
stored bytes when the archive is read. ``headers`` has one row for each record, with the bytes of its WARC header.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomdoc.llm.common import columns_of
from fathomdoc.session import work_folder

#: Shorter payloads are never turned into revisits.
LEAST_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: How blanks of an address are written in a header line; other control characters are left out.
ESCAPES = {"\r": "%0D", "\n": "%0A", "\t": "%09", " ": "%20", r"[\x00-\x1f\x7f]": ""}
KEY = ["digest", "sha1", "length"]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(line_of: dict[str, Column]) -> Column:
    """Header bytes; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in line_of.items()]
    return F.encode(F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n")), "UTF-8")


def write_archive(pages: DataFrame, folder: str, least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Writes a record for each row of (page_id, url, html).

    Null html is an empty payload, a null url becomes ``urn:page:<id>``; blanks and control characters
    of a url are escaped. Among equal payloads of at least ``least_revisit_bytes`` the record with the largest page_id is
    the response and the others revisit it; rows that repeat this page_id with the same payload are responses too, and
    if all ids are null every record is one. Other columns are ignored.
    """
    rows = columns_of(pages, "page_id", "url", "html").withColumn(
        "payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keyed = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"),
                        F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    # Grouping keeps one payload per key and task before the shuffle, so a payload of a third of the pages is no load.
    stored = keyed.groupBy(*KEY).agg(F.max("page_id").alias("owner"), F.first("payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")
    owners = pages.sparkSession.read.parquet(f"{folder}/payloads").select(*KEY, "owner")
    first = F.coalesce(F.col("page_id") == F.col("owner"), F.col("owner").isNull())
    kind = F.when((F.col("length") < least_revisit_bytes) | first, "response").otherwise("revisit")
    target = F.col("url")
    for character, code in ESCAPES.items():
        target = F.regexp_replace(target, character, code)
    revisit = F.col("kind") == "revisit"
    header = _header({
        "WARC-Type": F.col("kind"),
        "WARC-Record-ID": _record_id(F.col("page_id")),
        "WARC-Date": F.lit(DATE),
        "WARC-Target-URI": F.coalesce(target, F.concat(F.lit("urn:page:"), F.coalesce(
            F.col("page_id").cast("string"), F.lit("none")))),
        "Content-Type": F.lit("text/html; charset=utf-8"),
        "Content-Length": F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string"),
        "WARC-Payload-Length": F.col("length").cast("string"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("sha1")),
        "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(revisit, _record_id(F.col("owner"))),
    })
    (keyed.drop("payload").join(owners, KEY).withColumn("kind", kind)
     .select("digest", "sha1", "length", header.alias("header")).write.parquet(f"{folder}/headers"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload): the original records, each header joined with the payload it names."""
    headers, payloads = (spark.read.parquet(f"{folder}/{n}") for n in ("headers", "payloads"))
    return headers.join(payloads.select(*KEY, "payload"), KEY).select("header", "payload", *KEY)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) from an archive.

    Size and SHA-1 are those of the stored bytes; a payload that no longer has the digests it is stored under, or a
    header that names another digest or length, ends the job with an error. Payloads are checked once each, and only
    their digests meet the headers.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        *KEY, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("digest")).alias("intact"))
    headers = spark.read.parquet(f"{folder}/headers").select(
        *KEY, _page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("named_digest"), _field("WARC-Payload-Length").alias("named_length"))
    agree = (F.col("intact") & (F.col("named_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
             & (F.col("named_length") == F.col("payload_bytes").cast("string")))
    return (headers.join(payloads, KEY, "left")
            .withColumn("record_type", F.when(F.coalesce(agree, F.lit(False)), F.col("record_type")).otherwise(
                F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))
            .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads its index back."""
    spark = pages.sparkSession
    folder = work_folder(spark, "archive")
    write_archive(pages, folder)
    return read_index(spark, folder)
