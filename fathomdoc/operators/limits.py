"""Request rates and upload admission."""

from pyspark.sql import DataFrame, Window, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import text as X
from fathomdoc.functions.time import epoch_micros
from fathomdoc.operators.skew import null_safe_join, running_total, top_per_group

# Windows of one key that are summed together.
STRETCH_WINDOWS = 16


def request_rate(events: DataFrame, key: str, ts: str, window_seconds: int, inclusive: bool,
                 name: str = "demand") -> DataFrame:
    """Requests of the key within the window that ends at this row, this row included.

    Every request counts +1 at its time and -1 when it leaves the window, so the rate is a running total of
    per-instant sums. Requests without a time are left out; a null key is a key. ``inclusive`` keeps a request exactly one window old.
    """
    window = window_seconds * 1_000_000
    # Times are doubled: odd places between them are where requests leave.
    timed = events.withColumn("_at", epoch_micros(events, ts) * 2)
    steps = F.explode(F.array(
        F.struct(F.col("_at").alias("_at"), F.lit(1).alias("_step")),
        F.struct((F.col("_at") + 2 * window + (1 if inclusive else -1)).alias("_at"), F.lit(-1).alias("_step")),
    ))
    instants = (
        timed.select(key, steps.alias("_s")).select(key, "_s.*")
        .groupBy(key, "_at").agg(F.sum("_step").alias("_step"))
    )
    totals = running_total(instants, [key], "_at", "_step", 2 * window * STRETCH_WINDOWS, name)
    return null_safe_join(timed, totals.select(key, "_at", name), [key, "_at"]).drop("_at")


def batch_totals(files: DataFrame, batch: str = "batch", size: str = "size") -> DataFrame:
    return files.groupBy(batch).agg(
        F.count("*").alias("file_count"), F.sum(size).alias("total_bytes"), F.max(size).alias("max_bytes"))


def admit_batches(files: DataFrame, batch: str = "batch", file_no: str = "file_no", file_name: str = "file_name",
                  size: str = "size", max_files: int = DEFAULTS.max_files_per_upload,
                  max_file: int = DEFAULTS.max_file_bytes, max_total: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """One row per batch: admitted, and the reason of the first violation in file order.

    Too many files are refused before anything else, so only the first ``max_files + 1`` files of a batch are
    looked at in order; the rest is dropped before the shuffle. Bytes are counted while a file is read, so a file that
    is too large by both limits is refused for the one that it meets first.
    """
    looked_at = top_per_group(files, [batch], [F.col(file_no)], max_files + 1, "_n", F.col(file_no))
    order = Window.partitionBy(batch).orderBy(file_no)
    running = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    reason = (
        F.when(~X.has_known_suffix(F.col(file_name)), "file_type")
        .when(X.safe_name(F.col(file_name)).isNull(), "file_name")
        .when((F.col(size) > max_file) & (running - F.col(size) + max_file <= max_total), "file_size")
        .when(running > max_total, "total_size")
    )
    return (
        looked_at.withColumn("_reason", reason)
        .groupBy(batch)
        .agg(F.max("_n").alias("_files"),
             F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col(file_no), F.col("_reason")))).alias("_first"))
        .select(batch, F.when(F.col("_files") > max_files, "file_count").otherwise(F.col("_first._reason"))
                .alias("reason"))
        .withColumn("admitted", F.col("reason").isNull())
    )
