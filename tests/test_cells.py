import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomdoc.operators import cells, search
from fathomdoc.operators.cells import build_cell_index, nearest_cells, search_cells
from fathomdoc.operators.embedding import hashing_embedder
from fathomdoc.operators.search import knn_join
from fathomdoc.plans.answering import candidates, index_passages

SCHEMA = "chunk_id long, embedding array<float>, label int"


def clustered(n=3000, clusters=40, width=16, seed=1):
    random = np.random.default_rng(seed)
    centre = random.normal(size=(clusters, width))
    which = random.integers(0, clusters, n)
    return (centre[which] + 0.08 * random.normal(size=(n, width))).astype(np.float32), which


def frame(spark, vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), v if v is None else [float(x) for x in v], int(c)) for i, v, c in zip(ids, vectors, labels)], SCHEMA)


def rows(hits):
    return sorted((r[0], r[1], round(r.distance, 6), r["rank"]) for r in hits.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return frame(spark, *clustered()).repartition(6).cache()


@pytest.fixture(scope="module")
def asked(spark, corpus):
    return corpus.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding").cache()


def recall(found, exact):
    exact = {(r[0], r[1]) for r in exact.collect()}
    return len(exact & {(r[0], r[1]) for r in found.collect()}) / len(exact)


def test_recall_with_few_pairs_on_clusters(corpus, asked):
    index = build_cell_index(corpus)
    exact, found = knn_join(asked, corpus, 10), search_cells(asked, index, 10)
    assert recall(found, exact) >= 0.95
    sizes = {r._cell: r["count"] for r in index.rows.groupBy("_cell").count().collect()}
    order = nearest_cells(np.array([r.embedding for r in asked.collect()], float), index.centroids, index.probes)
    assert sum(sizes.get(int(c), 0) for q in order for c in q) <= 0.1 * asked.count() * corpus.count()
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_recall_without_structure(spark):
    vectors = np.random.default_rng(4).normal(size=(1500, 24)).astype(np.float32)
    corpus = frame(spark, vectors, [0] * len(vectors))
    asked = corpus.filter("chunk_id < 150").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert recall(search_cells(asked, build_cell_index(corpus), 10), knn_join(asked, corpus, 10)) >= 0.95


def test_every_cell_is_exact_also_in_slices(corpus, asked):
    index = build_cell_index(corpus, cells=9)
    assert rows(search_cells(asked, index, 4, probes=9, cell_rows=100)) == rows(knn_join(asked, corpus, 4))


def test_filter_leaves_k_rows(corpus, asked):
    """Few rows are left, far from most queries: further cells are taken until k are found."""
    found = search_cells(asked, build_cell_index(corpus), 10, where=F.col("label") == 7, probes=1)
    assert found.groupBy("query_id").count().filter("count = 10").count() == asked.count()
    assert rows(found) == rows(knn_join(asked, corpus, 10, where=F.col("label") == 7))


def test_equal_vectors_null_vectors_and_small_tables(spark):
    same = frame(spark, [[1.0, 0.0]] * 300 + [None] * 5 + [[0.0, 1.0]] * 3, [0] * 308)
    asked = same.filter("chunk_id in (0, 301, 306)").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = search_cells(asked, build_cell_index(same), 4, cell_rows=16)
    assert rows(found) == rows(knn_join(asked, same, 4))
    one = frame(spark, [[1.0, 2.0]], [0])
    assert [r.chunk_id for r in search_cells(asked, build_cell_index(one), 4).collect()] == [0, 0]
    none = same.filter("false")
    assert search_cells(asked, build_cell_index(none), 4).count() == 0
    assert search_cells(asked.filter("false"), build_cell_index(same), 4).count() == 0


def test_index_is_kept_by_cell(spark, corpus, tmp_path):
    index = build_cell_index(corpus, f"{tmp_path}/cells")
    stored = spark.read.parquet(f"{tmp_path}/cells")
    assert stored.count() == corpus.count() and set(stored.columns) == {*corpus.columns, "_cell"}
    plan = index.rows.filter("_cell = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_cell), EqualTo(_cell,3)]" in plan


def test_question_path_takes_index_and_filter(spark):
    texts = ["red fox jumps", "blue whale swims", "green tree grows", "red car drives", "red fox sleeps"] * 6
    passages = spark.createDataFrame([(f"p{i:02d}", f"{t} {i}", "s", i % 2) for i, t in enumerate(texts)],
                                     "passage_id string, content string, source string, part int")
    questions = spark.createDataFrame([(1, "red fox"), (2, "tree")], "query_id long, question string")
    index = index_passages(passages, embedder=hashing_embedder, cells=4)
    for where in (None, F.col("part") == 1):
        exact = candidates(questions, passages, k=5, where=where).select("query_id", "passage_id", "cand_idx").collect()
        found = candidates(questions, index, k=30, where=where).filter("cand_idx < 5").select("query_id", "passage_id", "cand_idx").collect()
        assert sorted(exact) == sorted(found) and len(exact) == 10


def test_bounds_keep_rows_sent_apart_from_partitions(spark, monkeypatch):
    """With bounds from a sample, more partitions send hardly more rows."""
    vectors = np.random.default_rng(8).normal(size=(6000, 8)).astype(np.float32)
    corpus = frame(spark, vectors, [0] * len(vectors)).select("chunk_id", "embedding").cache()
    asked = corpus.filter("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "embedding")
    monkeypatch.setattr(search, "SAMPLED", 100)
    exact = rows(knn_join(asked, corpus, 5))
    monkeypatch.setattr(search, "FEW_PARTITIONS", 4)
    schema, queries = search.hit_schema(asked, "query_id", corpus, "chunk_id"), asked.toArrow()
    sent = []
    for parts in (16, 64):
        many = corpus.repartition(parts)
        bounds = search.upper_bounds(queries, many, 5, schema)
        sent.append(search._scan_join(queries, many, 5, schema, None, bounds).count())
        assert rows(knn_join(asked, many, 5)) == exact
    assert search._scan_join(queries, corpus.repartition(64), 5, schema, None).count() == 40 * 5 * 64
    assert sent[1] <= 1.5 * sent[0] and sent[1] <= 40 * 5 * 1000 / 100 * 2


def test_pivots_spare_comparisons():
    vectors, _ = clustered(20_000, 30, 12, 3)
    vectors = vectors.astype(float)
    nearest = search._Nearest(np.arange(60), vectors[:60], 5, None)
    nearest.add(np.arange(len(vectors)), vectors)
    assert nearest.compared < 0.5 * 60 * len(vectors)
    for q in (0, 17, 59):
        far = np.round(((vectors - vectors[q]) ** 2).sum(1), search.DECIMALS)
        assert nearest.found[q].tolist() == np.lexsort((np.arange(len(far)), far))[:5].tolist()


def test_queries_are_sent_to_parts_not_to_cells(spark, monkeypatch, corpus):
    """A query that meets every cell is sent once to each part, and small slices do not multiply rows."""
    sent, plain = [], cells._join_parts

    def counted(left, right, *rest):
        sent.append((left.count(), right.count()))
        return plain(left, right, *rest)

    monkeypatch.setattr(cells, "_join_parts", counted)
    asked = corpus.select(F.col("chunk_id").alias("query_id"), "embedding")
    search_cells(asked, build_cell_index(corpus, cells=200), 3, probes=200, cell_rows=20)
    assert max(sent[0]) <= 3000 * 8


def test_probing_gives_one_row_for_each_query(spark):
    vectors = np.random.default_rng(2).normal(size=(500, 8))
    known = spark.sparkContext.broadcast((vectors[:100], np.full(100, 5), np.arange(100) // 10, np.full(10, 2)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(vectors.tolist())], ["i", "v"])
    out = pa.Table.from_batches(cells._probe(known, 100, 3, ["i", "v", "r", "p"])(iter([batch])))
    assert out.num_rows == 500 and all(p == list(range(20)) for p in out["p"].to_pylist())


def test_index_makes_each_vector_once(spark, tmp_path):
    def embedder(texts):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as log:
            log.write("\n".join(texts))
        return hashing_embedder(texts)

    passages = spark.createDataFrame([(f"p{i}", f"red fox {i}", "s") for i in range(300)], "passage_id string, content string, source string")
    assert index_passages(passages, embedder=embedder, cells=4).rows.count() == 300
    assert sum(len(f.read_text().split("\n")) for f in tmp_path.iterdir()) == 300
