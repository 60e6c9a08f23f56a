"""Tool calls and their results, and readiness of components."""

from pyspark.sql import DataFrame, functions as F

from fathomdoc.functions import payload as P
from fathomdoc.session import once


def parse_tool_results(results: DataFrame, result: str = "result") -> DataFrame:
    """Adds error (text or null) and ok."""
    parsed = once(results, _payload=P.object_or_null(F.col(result)))
    return once(parsed, error=P.error_of(F.col("_payload"))).withColumn("ok", F.col("error").isNull()).drop("_payload")


def parse_tool_arguments(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """Adds args, a map of strings; anything but a JSON object gives an empty one."""
    return once(calls, _payload=P.object_or_null(F.col(arguments))).withColumn(
        "args", P.arguments_of(F.col("_payload"))).drop("_payload")


def match_calls(calls: DataFrame, results: DataFrame, on: str = "tool_call_id") -> DataFrame:
    """Calls with their result; a call without a result stays, with nulls."""
    return calls.join(results, on, "left")


def trace_status(trace: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Per chat: number of calls and whether any failed."""
    return trace.groupBy(chat).agg(F.count("*").alias("calls"), F.bool_or(~F.col("ok")).alias("any_failed"))


def readiness(components: DataFrame, group: str, up: str = "up") -> DataFrame:
    """``ready`` where every component is up, else ``partial``."""
    return components.groupBy(group).agg(
        F.when(F.bool_and(up), "ready").otherwise("partial").alias("readiness"))
