"""Second stage of retrieval: score the candidates of a query again and keep the best."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import payload as P
from fathomdoc.functions.scoring import display_score, lexical_score
from fathomdoc.session import once

ScoreFn = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def lexical_scores(candidates: DataFrame, query: str = "question", content: str = "content") -> DataFrame:
    """Scores by word overlap: query_id, cand_idx, score, response_order."""
    return candidates.select(
        "query_id", "cand_idx",
        lexical_score(F.lower(F.col(query)), F.col(content), F.col("cand_idx")).alias("score"),
        F.col("cand_idx").alias("response_order"),
    )


def _scores(fn: ScoreFn, queries: list, contents: list) -> list:
    """Scores of a batch; where the function fails, each pair is tried alone, and those that fail have none."""
    try:
        return list(fn(queries, contents))
    except Exception:  # any scorer, any input
        if len(queries) == 1:
            return [None]
        return [s for q, c in zip(queries, contents) for s in _scores(fn, [q], [c])]


def model_scores(candidates: DataFrame, fn: ScoreFn, query: str = "question", content: str = "content") -> DataFrame:
    """Scores from a batch function over (queries, contents); a pair it fails for has a null score, and a query
    without any score keeps its vector order (``best_scored``)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, contents in batches:
            yield pd.Series(_scores(fn, queries.tolist(), contents.tolist()), index=queries.index, dtype=float)

    return candidates.select(
        "query_id", "cand_idx", run.asNondeterministic()(query, content).alias("score"), F.col("cand_idx").alias("response_order"))


def parse_scores(results: DataFrame, item: str = "item") -> DataFrame:
    """Scores from a reranker's JSON items (query_id, response_order, item).

    Items without an index are dropped; one beyond any list keeps its place and meets no candidate. One index that is not a number voids all items of its query, which then
    falls back to vector order.
    """
    read = once(results, _item=P.object_or_null(F.col(item)))
    read = once(read, _index=P.field(F.col("_item"), "index"))
    parsed = once(read, cand_idx=P.rerank_index(F.col("_index")), score=P.rerank_score(F.col("_item"))).select(
        "query_id", "response_order", "cand_idx", "score",
        (F.col("_index").isNotNull() & (P.kind(F.col("_index")) != "VOID")).alias("_given"))
    voided = F.max(F.col("_given") & F.col("cand_idx").isNull()).over(Window.partitionBy("query_id"))
    return (
        parsed.withColumn("_void", voided)
        .filter(F.col("_given") & ~F.col("_void"))
        .select("query_id", F.coalesce(F.col("cand_idx").try_cast("int"), F.lit(-1)).alias("cand_idx"), "score", "response_order")
    )


def best_scored(candidates: DataFrame, top_n: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """Best ``top_n`` candidates by a score column of their own (null: no score), ties in vector order.

    Same columns as ``rerank``, without a join.
    """
    query = Window.partitionBy("query_id")
    position = F.row_number().over(query.orderBy(F.col("score").desc_nulls_last(), "cand_idx"))
    scored = F.max(F.col("score").isNotNull()).over(query)
    place = F.when(F.col("_scored"), position).otherwise(F.col("cand_idx") + 1)
    ranked = candidates.withColumn("_scored", scored).withColumn("retrieval_rank", place)
    return (
        ranked.filter((F.col("retrieval_rank") <= max(1, top_n)) & (F.col("score").isNotNull() | ~F.col("_scored")))
        .withColumn("rerank_position", F.when(F.col("_scored"), F.col("retrieval_rank")))
        .withColumnRenamed("score", "rerank_score").drop("_scored")
    )


def rerank(candidates: DataFrame, scores: DataFrame, top_n: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """Best ``top_n`` candidates (query_id, cand_idx 0-based, ...) by the scores of a reranker's response.

    Adds rerank_score, rerank_position and retrieval_rank. A position counts scores, so one that points outside
    the candidates leaves a gap. A query without usable scores keeps its first candidates, with null score and
    position. Groups are bounded by the number of candidates per query.
    """
    top_n = max(1, top_n)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "response_order")
    best = (
        scores.withColumn("rerank_position", F.row_number().over(by_score))
        .filter(F.col("rerank_position") <= top_n)
        .select("query_id", "cand_idx", F.col("score").alias("rerank_score"), "rerank_position")
    )
    query = Window.partitionBy("query_id")
    scored = F.max(F.col("rerank_position").isNotNull()).over(query)
    kept = (
        candidates.join(best, ["query_id", "cand_idx"], "left")
        .withColumn("_scored", scored)
        .filter(F.when(F.col("_scored"), F.col("rerank_position").isNotNull()).otherwise(F.col("cand_idx") < top_n))
        .drop("_scored")
    )
    order = F.coalesce("rerank_position", F.col("cand_idx") + 1)
    return kept.withColumn("retrieval_rank", F.row_number().over(query.orderBy(order, "cand_idx")))


def display_results(results: DataFrame) -> DataFrame:
    """Order of a result list: by shown score, ties in given order (query_id, cand_idx, similarity, ...)."""
    shown = results.withColumn(
        "calculated_score",
        display_score(F.col("similarity"), F.lower(F.col("question")), F.col("content"), F.col("cand_idx")))
    order = Window.partitionBy("query_id").orderBy(F.col("calculated_score").desc(), "cand_idx")
    return shown.withColumn("display_rank", F.row_number().over(order))
