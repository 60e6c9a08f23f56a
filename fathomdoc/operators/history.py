"""Conversation history: recent context, summaries, JSON form."""

from pyspark.sql import DataFrame, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import text as X
from fathomdoc.operators.skew import last_items
from fathomdoc.schemas import HISTORY

# Turns of one conversation that are handled together.
STRETCH = 1024
SEGMENT = 256


def recent_context(conversations: DataFrame, n: int = DEFAULTS.history_messages, stretch: int = STRETCH) -> DataFrame:
    """Adds the last ``n`` messages up to this one, one ``role: text`` line each."""
    line = X.chat_line(F.col("role"), F.col("text"))
    return (
        last_items(conversations, ["conv_id"], "turn", line, n, stretch, "_lines")
        .withColumn("context", F.array_join("_lines", "\n"))
        .drop("_lines")
    )


def contextual_questions(conversations: DataFrame, n: int = DEFAULTS.history_messages,
                         remember: bool = True) -> DataFrame:
    """The question sent for every non-blank user message, with its recent context in front."""
    asked = recent_context(conversations, n) if remember else conversations.withColumn("context", F.lit(""))
    return (
        asked.filter((F.col("role") == "user") & ~X.is_blank(F.col("text")))
        .withColumn("question", X.contextual_question(F.col("context"), F.col("text")))
    )


def conversation_summary(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"))


def pack_history(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """JSON text per conversation and segment of ``segment`` turns; most conversations have one segment.

    Segments bound what one row holds, however long a conversation is.
    """
    message = F.struct("turn", "role", "text")
    return (
        conversations.groupBy("conv_id", F.floor(F.col("turn") / segment).alias("segment"))
        .agg(F.to_json(F.sort_array(F.collect_list(message))).alias("history"))
    )


def unpack_history(packed: DataFrame) -> DataFrame:
    return packed.select("conv_id", F.explode(F.from_json("history", HISTORY)).alias("m")).select("conv_id", "m.*")
