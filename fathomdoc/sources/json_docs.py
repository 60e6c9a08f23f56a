"""JSON files as documents, by the shape of the file."""

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import payload as P, text as X
from fathomdoc.schemas import DOCUMENTS
from fathomdoc.session import once

BASE_KEYS = ("source", "file_type", "file_name")
ENTRY = ("array<struct<text:string,chunk_index:int,item_index:int,json_structure:string,"
         "extra:map<string,string>>>")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pretty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Indented form of JSON texts; nulls stay, and half of a surrogate pair becomes a question mark."""
    for batch in batches:
        yield batch.map(
            lambda texts: None if texts is None else
            [None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2)
             .encode("utf-8", "replace").decode() for t in texts])


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _as_strings(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: v.try_cast("string"))


def _scalars(value: Column, *skip: str) -> Column:
    """Scalar fields of an object as strings."""
    return _as_strings(F.map_filter(_fields(value), lambda k, v: ~k.isin(*skip) & P.is_scalar(v)))


def _has(value: Column, key: str) -> Column:
    return (P.kind(value) == "OBJECT") & F.coalesce(F.map_contains_key(_fields(value), key), F.lit(False))


def _entry(text: Column, chunk_index=None, item_index=None, structure=None, extra: Column | None = None) -> Column:
    def typed(value, kind):
        return (F.lit(None) if value is None else value).cast(kind)

    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    return F.struct(
        text.alias("text"), typed(chunk_index, "int").alias("chunk_index"), typed(item_index, "int").alias("item_index"),
        typed(structure, "string").alias("json_structure"), (empty if extra is None else extra).alias("extra"))


def json_documents(files: DataFrame, max_bytes: int = DEFAULTS.max_json_bytes) -> tuple[DataFrame, DataFrame]:
    """``documents_by_path`` without the path."""
    documents, rejects = documents_by_path(files, max_bytes)
    return documents.drop("path"), rejects


def documents_by_path(files: DataFrame, max_bytes: int = DEFAULTS.max_json_bytes) -> tuple[DataFrame, DataFrame]:
    """Documents with their file's path (see schemas.DOCUMENTS) and rejects (path, reason) of JSON files (path, length, body).

    - object with ``content``: one document; its ``metadata`` fields, then its other scalar fields, are metadata
    - object with a ``chunks`` list: one document per string in it
    - any other object, or a scalar: the indented JSON
    - array: one document per item, with its position; an item whose ``content`` is no string ends the file, which
      then is among the rejects too

    Metadata may replace source, file_type and file_name. Numbers keep their JSON form. With duplicate keys the
    last one wins if spark.sql.variant.allowDuplicateKeys is set, else the file is rejected.
    """
    c = F.col
    small = c("length") <= max_bytes
    parsed = once(files, _v=P.strict_json(F.when(small, c("body"))))
    parsed = once(parsed, _kind=P.kind(c("_v")), _fields=F.when(P.kind(c("_v")) == "OBJECT", _fields(c("_v"))))
    parsed = once(parsed, _content=F.coalesce(F.map_contains_key("_fields", "content"), F.lit(False)),
                  _meta=F.element_at("_fields", "metadata"))
    reason = (
        F.when(~small, "too large")
        .when(c("_v").isNull(), "invalid JSON")
        .when(c("_content") & (P.kind(F.element_at("_fields", "content")) != "STRING"), "content is no text")
        .when(c("_content") & F.map_contains_key("_fields", "metadata") & (P.kind(c("_meta")) != "OBJECT"),
              "metadata is no object")
    )
    judged = once(parsed, reason=reason)
    rejects = judged.filter("reason IS NOT NULL").select("path", "reason")

    listed = c("_kind") == "ARRAY"
    ready = once(
        judged.filter("reason IS NULL"),
        _items=F.when(listed, F.try_variant_get("_v", "$", "array<variant>")),
        _raw=F.when(listed, F.from_json("body", "array<string>")),
        _chunks=F.when((c("_kind") == "OBJECT") & ~c("_content"),
                       F.try_variant_get("_v", "$.chunks", "array<variant>")))
    is_chunks = c("_chunks").isNotNull()
    whole = ~listed & ~c("_content") & ~is_chunks
    plain = F.transform("_items", lambda v, i: F.when(~_has(v, "content") & (P.kind(v) != "STRING"),
                                                      F.coalesce(F.get("_raw", i), F.lit("null"))))
    ready = ready.withColumn("_pretty", _pretty(F.when(listed, plain).when(whole, F.array("body"))))

    own = F.element_at("_fields", "content").try_cast("string")
    metadata = F.coalesce(_as_strings(_fields(c("_meta"))),
                          F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    from_content = F.array(_entry(own, extra=P.overlay(metadata, _scalars(c("_v"), "content", "metadata"))))
    from_chunks = F.filter(
        F.transform("_chunks", lambda v, i: _entry(F.when(P.kind(v) == "STRING", v.try_cast("string")), chunk_index=i)),
        lambda e: e["text"].isNotNull())
    from_whole = F.array(_entry(F.get("_pretty", F.lit(0)),
                                structure=F.when(c("_kind") == "OBJECT", F.lit("object"))))

    def from_item(v, i):
        return (
            F.when(_has(v, "content"),
                   _entry(F.when(P.kind(P.field(v, "content")) == "STRING", P.field(v, "content", "string")),
                          item_index=i, extra=_scalars(v, "content")))
            .when(P.kind(v) == "STRING", _entry(v.try_cast("string"), item_index=i))
            .otherwise(_entry(F.get("_pretty", i), item_index=i))
        )

    ready = once(ready, _each=F.transform("_items", from_item))
    first_bad = F.array_position(F.transform("_each", lambda e: e["text"].isNull()), True)
    from_items = F.when(first_bad > 0, F.slice("_each", F.lit(1), first_bad.cast("int") - 1)).otherwise(c("_each"))
    cut = ready.filter(first_bad > 0).select("path", F.lit("content of an item is no text").alias("reason"))
    entries = (
        F.when(listed, from_items).when(c("_content"), from_content).when(is_chunks, from_chunks).otherwise(from_whole)
    )

    base = {"source": c("path"), "file_type": F.lit("json"), "file_name": X.base_name(c("path"))}
    rows = ready.select("path", F.explode(entries.cast(ENTRY)).alias("e")).select("path", "e.*")
    documents = rows.select(
        "path", "text", *[F.coalesce(F.element_at("extra", k), base[k]).alias(k) for k in BASE_KEYS],
        F.lit(None).cast("int").alias("page"), "chunk_index", "item_index", "json_structure",
        F.map_filter("extra", lambda k, v: ~k.isin(*BASE_KEYS)).alias("extra"))
    return documents.select("path", *DOCUMENTS.names), rejects.unionByName(cut)


def read_json_documents(spark, path: str, max_bytes: int = DEFAULTS.max_json_bytes) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of every .json file below ``path``; oversize files are not opened."""
    from fathomdoc.sources.files import decoded_files, scan_files

    files = scan_files(spark, path, [".json"])
    documents, bad = json_documents(decoded_files(files.filter(F.col("length") <= max_bytes)), max_bytes)
    big = files.filter(F.col("length") > max_bytes).select("path", F.lit("too large").alias("reason"))
    return documents, bad.unionByName(big)
