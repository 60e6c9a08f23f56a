"""Failures of model calls, counted while a job runs, so that a model that is down does not pass unseen."""

from pyspark.sql import Column, DataFrame, Observation, functions as F


class TooManyFailures(RuntimeError):
    """More rows failed than a job allows."""


def watched(df: DataFrame, failed: Column, name: str = "failures") -> tuple[DataFrame, Observation]:
    """``df`` and an observation of how many of its rows there are and failed, taken by the job that reads it.

    ``failed`` is a condition on the rows, such as ``F.col("error").isNotNull()`` for answers or
    ``F.col("score").isNull()`` for scores; null counts as not failed. No second pass is made.
    """
    seen = Observation(name)
    rows, bad = F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed")
    return df.observe(seen, rows, bad), seen


def require(seen: Observation, most: float) -> None:
    """Ends with ``TooManyFailures`` if a larger share than ``most`` failed; call it after the job has written.

    A stage that runs again after an executor is lost may count its rows again, in both numbers. Without rows nothing
    failed.
    """
    rows, failed = seen.get["rows"], seen.get["failed"]
    if failed > most * rows:
        raise TooManyFailures(f"{failed} of {rows} rows failed, more than the share of {most} that is allowed")
