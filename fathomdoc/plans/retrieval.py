"""Registered queries over embeddings, questions and passages."""

from dataclasses import replace

from pyspark.sql import functions as F

from fathomdoc.functions import fixed, scoring, text as X
from fathomdoc.operators import answer as A, rerank as R
from fathomdoc.operators.cells import build_cell_index, search_cells
from fathomdoc.operators.chunking import fixed_windows
from fathomdoc.operators.embedding import embed
from fathomdoc.operators.search import knn_join, similarity_search
from fathomdoc.operators.skew import union_all
from fathomdoc.plans import sql_parts as S
from fathomdoc.plans.activity import admission_sql
from fathomdoc.plans.answering import answer_questions, candidates, index_passages, retrieve
from fathomdoc.plans.registry import query, table
from fathomdoc.session import spread, written

LSH = (8, 4)


def vectors(spark, folder):
    found = table(spark, folder, "embeddings")
    queries = found.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = found.select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    return queries, spread(corpus)


def long_rank(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("d1_nearest_neighbours", f"WITH {S.nearest(4)} SELECT query_id, chunk_id, rank FROM hits")
def nearest_neighbours(spark, folder):
    return long_rank(knn_join(*vectors(spark, folder), 4).drop("distance"), "rank")


SIMILAR = f"""WITH {S.nearest(4)}
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank,
  round(CASE WHEN distance = 0 THEN greatest(50.0, 90.0 - (rank - 1) * 10)
             ELSE greatest(0.0, least(100.0, (1 - distance / 2) * 100)) END, 8) AS similarity
FROM hits"""


@query("d2_f1_i4_i5_similarity_search", SIMILAR)
def similarity(spark, folder):
    hits = similarity_search(*vectors(spark, folder), 4)
    return long_rank(hits, "rank").withColumns(
        {"distance": F.round("distance", 6), "similarity": F.round("similarity", 8)})


@query("d2_grid_join_for_many_queries", SIMILAR)
def similarity_on_grid(spark, folder):
    hits = similarity_search(*vectors(spark, folder), 4, broadcast_bytes=0, cell_rows=256)
    return long_rank(hits, "rank").withColumns(
        {"distance": F.round("distance", 6), "similarity": F.round("similarity", 8)})


APPROXIMATE = (f"WITH {S.nearest(4, S.shares_code(*LSH, 64))} SELECT query_id, chunk_id, round(distance, 6) AS distance, "
               "rank FROM hits")


@query("d3_approximate_neighbours", APPROXIMATE)
def approximate_neighbours(spark, folder):
    hits = knn_join(*vectors(spark, folder), 4, lsh=LSH)
    return long_rank(hits, "rank").withColumn("distance", F.round("distance", 6))


@query("d3_bucket_join_for_many_queries", APPROXIMATE)
def approximate_in_buckets(spark, folder):
    hits = knn_join(*vectors(spark, folder), 4, lsh=LSH, broadcast_bytes=0, cell_rows=64)
    return long_rank(hits, "rank").withColumn("distance", F.round("distance", 6))


@query("d3_cell_index_neighbours")
def neighbours_by_cells(spark, folder):
    """Approximate: the ten nearest by as many cells as the index measured for a recall of 0.95."""
    queries, corpus = vectors(spark, folder)
    hits = search_cells(queries, build_cell_index(corpus), 10)
    return long_rank(hits, "rank").withColumn("distance", F.round("distance", 6))


@query("d3_cell_index_every_cell_filtered", f"""WITH {S.nearest(10, 'b.label <> 3')}
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM hits""")
def neighbours_by_every_cell(spark, folder):
    """With every cell, and a filter, the search by cells is exact."""
    queries, corpus = vectors(spark, folder)
    index = build_cell_index(corpus, cells=16)
    hits = search_cells(queries, index, 10, where=F.col("label") != 3, probes=16, cell_rows=50)
    return long_rank(hits, "rank").withColumn("distance", F.round("distance", 6))


@query("c6_g1_filtered_question_candidates",
       f"WITH {S.candidates_where('lang <> ' + S.quoted('en'))} SELECT query_id, passage_id, cand_idx, round(distance, 6) AS distance FROM candidates")
def filtered_question_candidates(spark, folder):
    """The question path over an index of the passages, with a filter on them; every cell, so that it is exact."""
    passages = windows(spark, folder)
    index = replace(index_passages(passages, cells=24), probes=24)
    return candidates(questions(spark, folder), index, where=F.col("lang") != "en").select(
        "query_id", "passage_id", F.col("cand_idx").cast("bigint").alias("cand_idx"), F.round("distance", 6).alias("distance"))


@query("i5_squared_distance",
       f"""WITH {S.VECTORS} SELECT a.vec_id, {S.DISTANCE.replace('b.e[i]', 'a.e[len(a.e) + 1 - i]')} AS distance
FROM v a""")
def squared_distance(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(scoring.squared_l2(F.col("embedding"), F.reverse("embedding")), 9).alias("distance"))


@query("c6_g4_filtered_neighbours",
       f"WITH {S.nearest(6, 'b.label = 3')} SELECT query_id, chunk_id, rank FROM hits WHERE rank <= 4")
def filtered_neighbours(spark, folder):
    hits = knn_join(*vectors(spark, folder), 6, where=F.col("label") == 3)
    return long_rank(hits.filter("rank <= 4").drop("distance"), "rank")


def windows(spark, folder):
    return fixed_windows(spread(table(spark, folder, "documents")), "text").select(
        "doc_id", "chunk_no", "lang", "source", F.col("chunk_text").alias("content"),
        F.concat_ws("-", "doc_id", "chunk_no").alias("passage_id"))


def questions(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query("k1_hash_embedding", f"WITH {S.hashed('q', 'documents', 'doc_id', 'text')} SELECT doc_id, b, v FROM q")
def hash_embedding(spark, folder):
    return (
        embed(spread(table(spark, folder, "documents")), "text")
        .select("doc_id", F.posexplode("embedding").alias("b", "v")).filter("v <> 0")
        .select("doc_id", F.col("b").cast("bigint").alias("b"), F.col("v").cast("double").alias("v"))
    )


@query("g1_question_candidates",
       f"WITH {S.CANDIDATES} SELECT query_id, passage_id, cand_idx, round(distance, 6) AS distance FROM candidates")
def question_candidates(spark, folder):
    return candidates(questions(spark, folder), windows(spark, folder)).select(
        "query_id", "passage_id", F.col("cand_idx").cast("bigint").alias("cand_idx"),
        F.round("distance", 6).alias("distance"))


@query("g2_k2_two_stage_retrieval",
       f"WITH {S.RETRIEVED} SELECT query_id, passage_id, score, cand_idx, retrieval_rank FROM hits")
def two_stage_retrieval(spark, folder):
    return long_rank(retrieve(questions(spark, folder), windows(spark, folder)), "cand_idx", "retrieval_rank").select(
        "query_id", "passage_id", F.col("rerank_score").alias("score"), "cand_idx", "retrieval_rank")


@query("e2_i16_context_and_prompt", f"""WITH {S.RETRIEVED}, contexts AS (
  SELECT query_id, any_value(question) AS question, string_agg(content, chr(10) || chr(10) ORDER BY retrieval_rank) AS c
  FROM hits GROUP BY query_id)
SELECT query_id, {S.rag_prompt('c', 'question')} AS prompt FROM contexts""")
def context_and_prompt(spark, folder):
    asked = questions(spark, folder)
    return A.build_prompts(asked, A.build_context(retrieve(asked, windows(spark, folder)))).select("query_id", "prompt")


ANSWERS = f"""WITH {S.RETRIEVED}
SELECT query_id, retrieval_rank, source, score AS rerank_score,
  CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS content,
  trim(first_value(content) OVER (PARTITION BY query_id ORDER BY retrieval_rank), E' \\n') AS answer
FROM hits"""


@query("c11_e11_k3_answers_with_sources", ANSWERS)
def answers_with_sources(spark, folder):
    answered = answer_questions(questions(spark, folder), windows(spark, folder))
    return answered.select("query_id", "answer", F.explode("sources").alias("s")).select(
        "query_id", "answer", F.col("s.retrieval_rank").cast("bigint").alias("retrieval_rank"), "s.source",
        "s.rerank_score", "s.content")


# Two questions for each benchmark item, two seconds apart, of which every third is too short.
ASKED = """(SELECT 2 * item_id + k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (2 * (2 * item_id + k)) SECOND AS ts,
  CASE WHEN (2 * item_id + k) % 3 = 0 THEN ' ? ' ELSE text END AS text FROM benchmark, (SELECT unnest([0, 1]) AS k))"""
LIMITED = admission_sql("'all'", 10, 60, True).replace("FROM events", f"FROM {ASKED}")


@query("c7_k3_e11_refused_questions", f"""WITH decided AS ({LIMITED})
SELECT event_id AS query_id, CASE WHEN NOT admitted THEN 'rate_limited' WHEN event_id % 3 = 0 THEN 'question_too_short' END AS error,
  CASE WHEN NOT admitted THEN 'Rate limit exceeded. Please try again in ' || retry_after || ' seconds.'
    WHEN event_id % 3 = 0 THEN {S.quoted(fixed.REFUSALS['question_too_short'])} END AS refusal,
  CASE WHEN admitted AND event_id % 3 <> 0 THEN 5 ELSE 0 END AS n_sources FROM decided""")
def refused_questions(spark, folder):
    """Questions behind the limit of the whole service, and what those that are refused are told."""
    asked = table(spark, folder, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    number = 2 * F.col("item_id") + F.col("k")
    asked = asked.select(
        number.alias("query_id"), F.when(number % 3 == 0, " ? ").otherwise(F.col("text")).alias("question"),
        F.timestamp_seconds(F.lit(1_704_067_200) + 2 * number).cast("timestamp_ntz").alias("asked_at"))
    answered = answer_questions(asked, windows(spark, folder))
    return answered.select("query_id", "error", F.when(F.col("error").isNotNull(), F.col("answer")).alias("refusal"),
                           F.size("sources").cast("bigint").alias("n_sources"))


@query("i10_i11_g5_display_results", f"""WITH {S.CANDIDATES}, shown AS (
  SELECT *, greatest(0.0, least(100.0, (1 - distance / 2) * 100)) - 60 AS similarity FROM candidates),
rated AS (SELECT *, CASE WHEN similarity > 0 THEN round(similarity, 1)
                    ELSE {S.lexical('question', 'content', 'cand_idx')} END AS calculated_score FROM shown)
SELECT query_id, passage_id, calculated_score,
  row_number() OVER (PARTITION BY query_id ORDER BY calculated_score DESC, cand_idx) AS display_rank FROM rated""")
def display_results(spark, folder):
    """Similarities lowered by 60 so that some results need the lexical score."""
    plain = scoring.similarity_percent(F.col("distance"), F.col("cand_idx"), zero_distance_quirk=False)
    results = candidates(questions(spark, folder), windows(spark, folder)).withColumn("similarity", plain - 60)
    return long_rank(R.display_results(results), "display_rank").select(
        "query_id", "passage_id", "calculated_score", "display_rank")


# A reranker's answer per candidate, made from the hit itself: some indexes point outside, some queries get none.
ITEMS = """items AS (
  SELECT query_id, rank AS response_order,
    CASE WHEN query_id % 7 = 0 THEN 100 + rank ELSE 10 - rank END AS cand_idx,
    CASE WHEN rank % 3 = 0 THEN 0.0 ELSE round(1 / (1 + distance), 6) END AS score
  FROM hits WHERE query_id % 5 <> 0)"""
RERANKED = f"""WITH {S.nearest(8)}, {ITEMS},
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, response_order) AS rerank_position
           FROM items QUALIFY rerank_position <= 5),
joined AS (
  SELECT h.query_id, h.chunk_id, h.rank - 1 AS cand_idx, p.score AS rerank_score, p.rerank_position,
         count(p.rerank_position) OVER (PARTITION BY h.query_id) > 0 AS scored
  FROM hits h LEFT JOIN placed p ON p.query_id = h.query_id AND p.cand_idx = h.rank - 1)
SELECT query_id, chunk_id, cand_idx, rerank_score, rerank_position,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_position, cand_idx + 1), cand_idx) AS retrieval_rank
FROM joined WHERE CASE WHEN scored THEN rerank_position IS NOT NULL ELSE cand_idx < 5 END"""


@query("d4_d5_f2_g3_i21_rerank_response", RERANKED)
def rerank_response(spark, folder):
    hits = written(knn_join(*vectors(spark, folder), 8), "hits")
    score = F.round(1 / (1 + F.col("distance")), 6)
    item = F.to_json(F.struct(
        F.when(F.col("query_id") % 7 == 0, 100 + F.col("rank")).otherwise(10 - F.col("rank")).alias("index"),
        F.when(F.col("rank") % 2 == 0, score).otherwise(0.0).alias("score"),
        F.when(F.col("rank") % 3 != 0, score).alias("relevance_score"),
    ))
    item = F.when(F.col("rank") % 3 == 0, F.to_json(F.struct(
        F.when(F.col("query_id") % 7 == 0, 100 + F.col("rank")).otherwise(10 - F.col("rank")).alias("index"),
        F.lit("none").alias("score")))).otherwise(item)
    results = hits.filter("query_id % 5 <> 0").select(
        "query_id", F.col("rank").alias("response_order"), item.alias("item"))
    # an item without an index is dropped
    extra = hits.filter("rank = 1").select(
        "query_id", F.lit(99).alias("response_order"), F.lit('{"score": 0.99}').alias("item"))
    found = hits.withColumn("cand_idx", F.col("rank") - 1).drop("rank", "distance")
    ranked = R.rerank(found, R.parse_scores(union_all([results, extra.filter("query_id % 5 <> 0")])))
    return long_rank(ranked, "cand_idx", "rerank_position", "retrieval_rank")


@query("c12_i7_i8_source_labels", """SELECT doc_id, coalesce(CASE WHEN lang <> 'es' THEN source END, 'Unknown') AS source,
  CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet,
  substring(text, 1, 100) || '...' AS chip FROM documents""")
def source_labels(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", X.source_or_unknown(F.when(F.col("lang") != "es", F.col("source"))).alias("source"),
        X.snippet(text).alias("snippet"), X.chip(text).alias("chip"))
