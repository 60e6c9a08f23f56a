import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomdoc.functions.scoring import lexical_score, similarity_percent
from fathomdoc.operators import answer as A, rerank as R, search
from fathomdoc.operators.embedding import HashingEmbedder, embed
from fathomdoc.operators.search import knn_join
from fathomdoc.plans.answering import answer_questions


def brute(queries, corpus, k):
    out = []
    for q, a in queries:
        ranked = sorted((round(float(((np.array(a) - np.array(b)) ** 2).sum()), 9), c) for c, b in corpus if b)
        out += [(q, c, d, n + 1) for n, (d, c) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("ids", ["number", "text"])
def test_knn_ways_agree_with_brute_force(spark, ids):
    """A third of the corpus is one vector, so that ties reach far beyond k."""
    rng = np.random.default_rng(1)
    name = (lambda i: i) if ids == "number" else (lambda i: f"c{i}")
    corpus = [(name(i), [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).round(2).tolist()) for i in range(300)]
    corpus.append((name(999), None))
    queries = [(i, v) for i, (_, v) in enumerate(corpus[:40])]
    kind = "long" if ids == "number" else "string"
    c = spark.createDataFrame(corpus, f"chunk_id {kind}, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    expected = brute(queries, corpus, 5)
    for options in ({}, {"broadcast_bytes": 0, "cell_rows": 37}, {"lsh": (1, 0)}):
        found = sorted(tuple(r) for r in knn_join(q, c, 5, **options).collect())
        assert found == expected, options
    ways = [sorted(tuple(r) for r in knn_join(q, c, 5, lsh=(3, 2), **options).collect())
            for options in ({}, {"broadcast_bytes": 0, "cell_rows": 20})]
    assert ways[0] == ways[1]


def test_knn_edges(spark):
    c = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    one = spark.createDataFrame([(7, [1.0])], "query_id long, embedding array<float>")
    assert knn_join(none, c, 3).count() == 0
    assert [r.chunk_id for r in knn_join(one, c, 9).orderBy("rank").collect()] == [1, 2]
    assert knn_join(one, c, 9, where=F.col("chunk_id") == 2).count() == 1
    assert knn_join(one, c.filter("false"), 2).count() == 0


def test_similarity_percent(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (0.5, 2), (2.0, 3), (2.5, 4), (0.0, 4), (0.0, 5)], "d double, i int")
    with_quirk = [r[0] for r in df.select(similarity_percent(F.col("d"), F.col("i"))).collect()]
    assert with_quirk == [90, 80, 75, 0, 0, 50, 50]
    assert df.select(similarity_percent(F.col("d"), F.col("i"), False)).head()[0] == 100


def test_lexical_score(spark):
    def score(query, content, index):
        df = spark.createDataFrame([(query, content, index)], "q string, c string, i int")
        return df.select(lexical_score(F.col("q"), F.col("c"), F.col("i"))).head()[0]

    assert score("big red", "A Big Red dog", 0) == 90 and score("big red", "A Big Red dog", 3) == 85
    assert score("zz", "x" * 15, 0) == 30 and score("", "abc", 2) == 75 and score(None, "abc", 0) == 85
    assert score("red fox red", "the red RED red fox.", 0) == pytest.approx(60 * 3 / 3 + 30 - 5, abs=.1)
    assert score("red dog", "red red red red x", 1) == 95


def scores(spark, *items):
    rows = [(1, n, json.dumps(i)) for n, i in enumerate(items)]
    return R.parse_scores(spark.createDataFrame(rows, "query_id long, response_order int, item string"))


def candidates(spark, n):
    return spark.createDataFrame([(1, i, f"d{i}") for i in range(n)], "query_id long, cand_idx int, content string")


def ranked(df):
    return [(r.cand_idx, r.rerank_position, r.retrieval_rank) for r in df.orderBy("retrieval_rank").collect()]


def test_rerank(spark):
    found = scores(spark, {"index": 1, "score": .9}, {"index": 7, "score": .8}, {"index": 0, "score": .1})
    assert ranked(R.rerank(candidates(spark, 2), found)) == [(1, 1, 1), (0, 3, 2)]
    fallback = [(0, None, 1), (1, None, 2)]
    for items in ([{"index": 9, "score": 1}], [{"score": 1}], [{"index": "x", "score": 1}, {"index": 0, "score": 1}]):
        assert ranked(R.rerank(candidates(spark, 3), scores(spark, *items), 2)) == fallback
    values = [r.score for r in scores(
        spark, {"index": 0, "score": 0, "relevance_score": .4}, {"index": 1, "score": "x"}, {"index": "2", "score": "0"},
        {"index": 3, "similarity": .7, "score": None}, {"index": 4}).orderBy("cand_idx").collect()]
    assert values == [.4, 0, 0, .7, 0]
    tied = scores(spark, {"index": 2, "score": 1}, {"index": 0, "score": 1}, {"index": 1, "score": 2})
    assert [c for c, _, _ in ranked(R.rerank(candidates(spark, 3), tied, 2))] == [1, 2]
    own = candidates(spark, 3).withColumn("score", F.lit(None).cast("double"))
    assert ranked(R.best_scored(own, 2)) == fallback
    own = candidates(spark, 3).withColumn("score", F.when(F.col("cand_idx") > 0, F.col("cand_idx").cast("double")))
    assert ranked(R.best_scored(own, 3)) == [(2, 1, 1), (1, 2, 2)]


def test_model_scores(spark):
    df = candidates(spark, 3).withColumn("question", F.lit("q"))
    found = R.model_scores(df, lambda qs, cs: [float(c[1:]) for c in cs])
    assert [r.cand_idx for r in R.rerank(df, found).orderBy("retrieval_rank").collect()] == [2, 1, 0]


def test_answers(spark):
    passages = spark.createDataFrame(
        [("a", "the cat sat on the mat", None), ("b", "x" * 300, "f.txt")],
        "passage_id string, content string, source string")
    questions = spark.createDataFrame([(1, " where sat the cat? "), (2, "ab"), (3, None)], "query_id long, question string")
    rows = {r.query_id: r for r in answer_questions(questions, passages).collect()}
    assert rows[1].answer == "the cat sat on the mat" and rows[1].question == "where sat the cat?"
    assert [(s.source, len(s.content)) for s in rows[1].sources] == [("Unknown", 22), ("f.txt", 203)]
    assert rows[2].error == "question_too_short" and rows[3].error == "validation_failed"
    nothing = answer_questions(questions, passages.filter("false")).filter("query_id = 1").head()
    assert nothing.answer.startswith("No relevant documents") and nothing.sources == [] and rows[2].sources == []


def test_prompts_without_context_are_not_sent(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    rows = A.generate(df, lambda prompts: [p + " done " for p in prompts]).orderBy("id").collect()
    assert rows[0].answer == "p done" and rows[1].answer.startswith("No relevant")


@pytest.mark.parametrize("lsh", [None, (2, 1)])
def test_rows_sent_to_cells_grow_with_the_table(spark, monkeypatch, lsh):
    """Twice the rows are twice the rows sent, also with small cells; each row was sent once for each slice before."""
    sent, plain = [], search.join_cells

    def counted(left, right, *rest):
        sent.append(left.count() + right.count())
        return plain(left, right, *rest)

    monkeypatch.setattr(search, "join_cells", counted)
    for n in (3000, 6000):
        vectors = spark.range(n).select(F.col("id").alias("query_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
        knn_join(vectors, vectors.withColumnRenamed("query_id", "chunk_id"), 2, lsh=lsh, broadcast_bytes=0, cell_rows=16)
    assert sent[1] <= 2.2 * sent[0] and sent[1] <= 6000 * 2 * 8 * (lsh or (1,))[0]


def test_an_embedder_remembers_a_bounded_number_of_words():
    embedder, plain = HashingEmbedder(), HashingEmbedder(remembered=0)
    for start in range(0, 200_000, 20_000):
        texts = [" ".join(f"w{i}" for i in range(at, at + 100)) + " again" for at in range(start, start + 20_000, 100)]
        assert np.array_equal(embedder(texts), plain(texts))
    assert len(embedder.known) <= 100_000


def test_vectors_leave_in_parts_in_order(spark):
    texts = [None if i % 7 == 3 or 20 <= i < 60 else f"word{i} common" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = {r.id: r.embedding for r in embed(df, "text", batch_size=2).collect()}
    assert len(found) == 100
    for i, text in enumerate(texts):
        assert found[i] is None if text is None else np.array_equal(np.float32(found[i]), HashingEmbedder()([text])[0])
