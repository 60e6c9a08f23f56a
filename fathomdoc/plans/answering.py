"""Answering a table of questions in one job."""

from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions.scoring import lexical_score
from fathomdoc.operators.answer import (
    GenerateFn, build_prompts, classify_questions, context_of, extractive_answers, generate, limit_questions, refusal, sources_of)
from fathomdoc.operators.cells import CellIndex, build_cell_index, search_cells
from fathomdoc.operators.embedding import EmbedFn, embed, hashing_embedder
from fathomdoc.operators.late import late_join
from fathomdoc.operators.rerank import best_scored
from fathomdoc.operators.search import knn_join
from fathomdoc.session import written


def index_passages(passages: DataFrame, path: str | None = None, embedder: EmbedFn = hashing_embedder, **options) -> CellIndex:
    """The passages with their embeddings, stored by cell; see ``build_cell_index`` for the options."""
    # Written, as the index reads its rows several times and would make the vectors again each time.
    known = passages if "embedding" in passages.columns else written(embed(passages, "content", embedder), "embedded")
    return build_cell_index(known, path, corpus_id="passage_id", **options)


def candidates(questions: DataFrame, passages: DataFrame | CellIndex, embedder: EmbedFn = hashing_embedder,
               k: int = DEFAULTS.retrieval_candidates, where: Column | None = None) -> DataFrame:
    """The k nearest passages of every question with both texts; cand_idx is the 0-based rank.

    questions: query_id, question. passages: passage_id, content, source, and embedding if they have one; or an index
    of them, which is searched approximately. ``where`` filters the passages, by any column, before the search. The hits
    are found on ids and vectors and written; texts are then fetched for them, and the other texts are not shuffled.
    """
    asked = embed(questions, "question", embedder)
    if isinstance(passages, CellIndex):
        hits, passages = search_cells(asked, passages, k, where=where), passages.rows
    else:
        passages = passages.filter(where) if where is not None else passages
        known = passages if "embedding" in passages.columns else embed(passages, "content", embedder)
        hits = knn_join(asked, known, k, corpus_id="passage_id")
    kept = [c for c in ("passage_id", "content", "source", "metadata") if c in passages.columns]
    return (
        late_join(passages.select(*kept), hits, "passage_id")
        .join(questions.select("query_id", "question"), "query_id")
        .withColumn("cand_idx", F.col("rank") - 1)
    )


def retrieve(questions: DataFrame, passages: DataFrame | CellIndex, embedder: EmbedFn = hashing_embedder,
             k: int = DEFAULTS.retrieval_candidates, top_n: int = DEFAULTS.rerank_top_k, where: Column | None = None) -> DataFrame:
    """Two stages: k candidates by vector, then the best ``top_n`` by word overlap."""
    found = candidates(questions, passages, embedder, k, where)
    score = lexical_score(F.lower("question"), F.col("content"), F.col("cand_idx"))
    return best_scored(found.withColumn("score", score), top_n)


def answer_questions(questions: DataFrame, passages: DataFrame, embedder: EmbedFn = hashing_embedder,
                     generator: GenerateFn = extractive_answers) -> DataFrame:
    """query_id, question, answer, sources, error: one row per question; only valid questions are searched.

    Questions with a time (``asked_at``) first pass the limit of the whole service. A refused question has a fixed
    answer, no sources and its status as error; a failing generator gives internal_error; without hits the answer
    says so. Sources are never null, and have the passages' ``metadata`` if there is such a column.
    """
    checked = classify_questions(limit_questions(questions) if "asked_at" in questions.columns else questions)
    valid = checked.filter("status = 'ok'").select("query_id", F.col("clean_question").alias("question"))
    hits = retrieve(valid, passages, embedder)
    found = hits.groupBy("query_id").agg(
        context_of().alias("context"), sources_of(metadata="metadata" in hits.columns).alias("sources"))
    none = F.array().cast(found.schema["sources"].dataType)
    answered = generate(build_prompts(valid, found), generator).withColumn(
        "sources", F.when(F.col("error").isNull(), F.coalesce("sources", none)).otherwise(none))
    wait = F.col("retry_after") if "retry_after" in checked.columns else None
    refused = checked.filter("status <> 'ok'").select(
        "query_id", "question", refusal(F.col("status"), wait).alias("answer"), none.alias("sources"), F.col("status").alias("error"))
    return answered.select(*refused.columns).unionByName(refused)
