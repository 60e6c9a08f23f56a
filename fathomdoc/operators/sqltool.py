"""Read-only SQL: a guard over query texts, row caps, and JSON-safe rows."""

from collections.abc import Iterator
import re
import threading
import unicodedata
import uuid

import pandas as pd
from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, ParseException)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import fixed, text as X
from fathomdoc.session import once

QUOTED_OR_COMMENT = re.compile(
    r"""(?P<quoted>'(?:[^']|'')*+(?:'|\Z)|"(?:[^"]|"")*+(?:"|\Z))|(?P<line>--[^\n]*(?P<end>\n)?)|(?P<block>/\*)""")
NOT_ASCII = r"[^\x00-\x7F]"
JVM_CALL = re.compile(r"\b(?:try_reflect|reflect|java_method)\W*\(", re.IGNORECASE)
BLOCK_EDGE = re.compile(r"/\*|\*/")


def without_comments(sql: str) -> str:
    """Comments replaced by a space, text in quotes untouched; blocks nest, an open block runs to the end."""
    out, at = [], 0
    while found := QUOTED_OR_COMMENT.search(sql, at):
        out.append(sql[at:found.start()])
        at = found.end()
        if found["quoted"]:
            out.append(found["quoted"])
        elif found["line"]:
            out.append(" " if found["end"] else "")
        else:
            depth = 1
            while depth:
                edge = BLOCK_EDGE.search(sql, at)
                at = edge.end() if edge else len(sql)
                depth = depth + (1 if edge[0] == "/*" else -1) if edge else 0
            out.append(" ")
    return "".join(out) + sql[at:]


@F.pandas_udf(T.StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _uncommented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(without_comments, na_action="ignore")


def _only_where(needed: Column, fn, sql: Column) -> Column:
    """``fn`` in Python for the rows that need it; the others are passed as null and keep their text."""
    return F.coalesce(fn(F.when(needed, sql)), sql)


def _judged(df: DataFrame, sql: str, max_chars: int) -> DataFrame:
    """The rules over ``_n`` (compatible form) and ``_c`` (without comments)."""
    c = F.col
    one = once(df, _q=X.strip(F.regexp_replace("_c", r";\s*$", "")))
    words = r"(?i)\b(" + "|".join(fixed.FORBIDDEN_WORDS) + r")\b"
    reason = (
        F.when(c(sql).isNull(), fixed.EMPTY)
        .when(c("_n").rlike(NOT_ASCII), fixed.NOT_ASCII)
        .when(F.length("_n") > max_chars, fixed.TOO_LONG.format(max_chars))
        .when(F.length("_c") == 0, fixed.EMPTY)
        .when(F.contains(c("_q"), F.lit(";")), fixed.MANY_STATEMENTS)
        .when(c("_q").rlike(words), fixed.NOT_READ_ONLY)
        .when(~c("_q").rlike(r"(?i)^(select|with)\b"), fixed.NOT_SELECT)
    )
    return (
        once(one, reason=reason)
        .withColumn("ok", c("reason").isNull())
        .withColumn("normalised", F.when(c("ok"), c("_q")))
        .drop("_n", "_c", "_q")
    )


def validate_select(df: DataFrame, sql: str = "sql", max_chars: int = DEFAULTS.sql_max_chars) -> DataFrame:
    """Adds ok, reason and normalised for a column of query texts; the first rule that fails gives the reason."""
    c = F.col
    known = once(df, _n=_only_where(c(sql).rlike(NOT_ASCII), _compatible, c(sql)))
    bare = once(known, _c=X.strip(_only_where(c("_n").rlike(r"--|/\*"), _uncommented, c("_n"))))
    return _judged(bare, sql, max_chars)


def row_limit(requested: int | None, most: int = DEFAULTS.sql_max_rows) -> int:
    return min(requested, most) if requested and requested > 0 else most


def cap_rows(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """At most ``n`` rows, and one row with row_count, truncated and max_rows."""
    summary = df.limit(n + 1).agg(
        F.least(F.count("*"), F.lit(n)).cast("bigint").alias("row_count"),
        (F.count("*") > n).alias("truncated"),
    ).withColumn("max_rows", F.lit(n).cast("bigint"))
    return df.limit(n), summary


def normalised(spark: SparkSession, sql: str) -> str:
    """The one read-only statement that a text holds, without comments and a last semicolon. Others raise ValueError.

    Spark functions that call into the JVM are refused too: a SELECT could do more with them than read tables.
    """
    known = unicodedata.normalize("NFKC", sql)
    row = spark.sql("SELECT :sql AS sql, :known AS _n, :bare AS _c",
                    args={"sql": sql, "known": known, "bare": without_comments(known).strip()})
    verdict = _judged(row, "sql", DEFAULTS.sql_max_chars).head()
    if not verdict["ok"]:
        raise ValueError(verdict["reason"])
    if JVM_CALL.search(verdict["normalised"]):
        raise ValueError(fixed.NOT_READ_ONLY)
    return verdict["normalised"]


def read_only_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """The rows of one read-only statement (see ``normalised``); ``args`` fill named parameters such as ``:low``. Files by
    their path are refused."""
    statement = normalised(spark, sql)
    # A path as a table name would read any file the job can.
    files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        return spark.sql(statement, args=args or {})
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", files)


def within(spark: SparkSession, timeout_ms: int | None, run):
    """What ``run`` returns; its Spark jobs are interrupted, and TimeoutError raised, once it took longer."""
    if timeout_ms is None:
        return run()
    context, tag, late = spark.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event()

    def interrupt() -> None:
        # Again until the statement gives up, as it may be between two jobs.
        late.set()
        while not done.wait(0.2):
            context.cancelJobsWithTag(tag)

    done = threading.Event()
    timer = threading.Timer(timeout_ms / 1000, interrupt)
    context.addJobTag(tag)
    timer.start()
    try:
        return run()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"statement took more than {timeout_ms} ms") from error
        raise
    finally:
        done.set()
        timer.cancel()
        context.removeJobTag(tag)


def guarded_sql(spark: SparkSession, sql: str, args: dict | None = None, max_rows: int | None = None,
                timeout_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Capped rows of one read-only statement, and one row with sql, columns, row_count, truncated and max_rows.

    The statement runs once: at most one row more than the cap is fetched, and both results come from these rows.
    ``sql`` is the statement that ran, without comments. After ``timeout_ms`` it is interrupted (TimeoutError).
    """
    found, n = read_only_sql(spark, sql, args), row_limit(max_rows)
    fetched = within(spark, timeout_ms, found.limit(n + 1).toArrow)
    summary = [(normalised(spark, sql), found.columns, min(fetched.num_rows, n), fetched.num_rows > n, n)]
    return (spark.createDataFrame(fetched.slice(0, n), found.schema),
            spark.createDataFrame(summary, "sql string, columns array<string>, row_count bigint, truncated boolean, max_rows bigint"))


def error_of(error: Exception) -> str:
    """What a caller is told of a failed statement: the guard's reason, or the label of the kind of error, never the
    error's own text."""
    if isinstance(error, ValueError):
        return str(error)
    kinds = {"QueryCanceled": TimeoutError, "ProgrammingError": (ParseException, AnalysisException), "DataError": (
        ArithmeticException, NumberFormatException, DateTimeException, ArrayIndexOutOfBoundsException)}
    known = [name for name, classes in kinds.items() if isinstance(error, classes)]
    return fixed.ERROR_LABELS[known[0]] if known else fixed.DEFAULT_ERROR_LABEL


def query_database(spark: SparkSession, sql: str, args: dict | None = None, max_rows: int | None = None,
                   timeout_ms: int | None = DEFAULTS.sql_timeout_ms) -> tuple[DataFrame | None, DataFrame]:
    """``guarded_sql`` that does not raise: the summary has ``error`` besides, null or what a caller is told; without
    rows if there is one. The session goes on after a statement that failed or took too long."""
    try:
        rows, summary = guarded_sql(spark, sql, args, max_rows, timeout_ms)
        return rows, summary.withColumn("error", F.lit(None).cast("string"))
    except Exception as error:  # any statement
        fields = "sql string, columns array<string>, row_count bigint, truncated boolean, max_rows bigint, error string"
        return None, spark.createDataFrame([(sql, [], 0, False, row_limit(max_rows), error_of(error))], fields)


def _as_text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(column, ".SSSSSS")
        column = F.concat(whole, F.when(micros != ".000000", micros).otherwise(""))
    elif isinstance(field.dataType, (T.DecimalType, T.DateType)):
        column = column.cast("string")
    elif isinstance(field.dataType, T.BinaryType):
        column = F.base64(column)
    return column.alias(field.name)


def json_safe(df: DataFrame, name: str = "row") -> DataFrame:
    """One JSON text per row; decimals, dates, times and bytes become strings, nulls stay."""
    columns = F.struct(*[_as_text(f) for f in df.schema.fields])
    return df.select(F.to_json(columns, {"ignoreNullFields": "false"}).alias(name))
