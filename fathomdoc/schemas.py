"""Schemas shared by scans, chunking and search."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("body", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("item_index", T.IntegerType()),
    T.StructField("json_structure", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

EXTRACTED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])

READ = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("ending", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reason", T.StringType()),
])

HISTORY = T.ArrayType(T.StructType([
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
]))
