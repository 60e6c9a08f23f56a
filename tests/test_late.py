import random

import pytest
from pyspark.sql import functions as F

from fathomdoc.operators import late
from fathomdoc.operators.chunking import recursive_chunks, register_splitter
from fathomdoc.operators.sqltool import read_only_sql
from fathomdoc.sources import collection as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark):
    source = random.Random(5)
    rows = [(source.randrange(400) if i % 50 else None, f"text {i}") for i in range(3000)] + [(7, "hot")] * 500
    keys = [(k, k * 10) for k in range(0, 400, 9)] + [(None, -1), (5000, 1)]
    return spark.createDataFrame(rows, "k long, text string").repartition(4), spark.createDataFrame(keys, "k long, v long"), rows, dict(keys)


@pytest.mark.parametrize("sent", [1_000_000, 0])
@pytest.mark.parametrize("salted", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_late_join_equals_a_plain_one(spark, monkeypatch, sent, salted, how):
    monkeypatch.setattr(late, "SENT_ROWS", sent)
    left, right, rows, keys = sides(spark)
    found = late.late_join(left, right, "k", how, F.col("text") if salted else None)
    value = lambda k: keys.get(k) if k is not None else None
    expected = [(k, t, value(k)) for k, t in rows if how == "left" or value(k) is not None]
    assert sorted(map(repr, (tuple(r) for r in found.select("k", "text", "v").collect()))) == sorted(map(repr, expected))
    assert late.late_join(left, right.limit(0), "k", how).count() == (len(rows) if how == "left" else 0)
    assert late.late_join(left.limit(0), right, "k", how).count() == 0


def test_bitmap_has_no_misses_and_few_others(spark):
    keys = spark.range(0, 200_000, 2).withColumnRenamed("id", "k")
    bitmap, bits = late.key_bitmap(keys, "k", 100_000)
    assert bits == 1 << 21 and bitmap.count() == bits // late.ROW_BITS
    flagged = late.with_flag(spark.range(200_000).withColumnRenamed("id", "k"), "k", bitmap, bits)
    passed = {r.odd: r.n for r in flagged.filter("_may_match").groupBy((F.col("k") % 2).alias("odd")).agg(F.count("*").alias("n")).collect()}
    assert passed[0] == 100_000 and passed[1] < 7_000
    assert late.key_bitmap(keys, "k", 10**12)[1] == late.MOST_BITS


def test_only_rows_that_may_match_are_shuffled(spark, monkeypatch):
    left, right, rows, _ = sides(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sent = plan(late.late_join(left.coalesce(4), right, "k"))
        assert "SortMergeJoin" not in sent and sent.count("BroadcastHashJoin") == 1
        monkeypatch.setattr(late, "SENT_ROWS", 0)
        # The text passes an exchange only above the filter on its bit.
        far = late.late_join(left.sparkSession.range(10).withColumnsRenamed({"id": "k"}).withColumn("text", F.lit("x")), right, "k")
        assert "Filter" in plan(far) and "bitmap" in plan(far)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_ids_of_copies(spark, monkeypatch, sent):
    monkeypatch.setattr(late, "SENT_ROWS", sent)
    rows = [(d, n, "same" if (d + n) % 3 == 0 else f"own {d} {n}") for d in range(20) for n in range(5)] + [(50, 0, None), (51, 0, None)]
    found = C.assign_ids(spark.createDataFrame(rows, "doc_id int, chunk_no int, chunk_text string").repartition(3), 9, ["doc_id", "chunk_no"])
    ids = {(r.doc_id, r.chunk_no): r.id for r in found.collect()}
    assert len(ids) == len(rows)
    same = [ids[d, n] for d, n, t in rows if t == "same"]
    assert len(set(same)) == len(same) and same[0].count("_") == 2 and all(i.startswith(same[0] + "_") for i in same[1:])
    assert all(ids[d, n].count("_") == 2 for d, n, t in rows if t and t != "same")


def test_ids_shuffle_no_text(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.concat(F.lit("text "), F.col("id") % 90).alias("chunk_text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange hashpartitioning" not in plan(C.assign_ids(rows, 9, ["doc_id", "chunk_no"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_splitter_in_a_statement(spark):
    texts = ["", None, "one two\n\nthree " * 200, "x" * 2500, "a\n" * 900 + "\n\n" + "word " * 500, " \n ", "é😀 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    df.createOrReplaceTempView("late_texts")
    name = register_splitter(spark, "cut_passages")
    expected = sorted(tuple(r) for r in recursive_chunks(df, "text").select("id", "chunk_no", "chunk_text").collect())
    for arguments in ("t.text", "t.text, 1000, 200"):
        found = read_only_sql(spark, f"SELECT t.id, p.chunk_no, p.chunk_text FROM late_texts t, LATERAL {name}({arguments}) p").collect()
        assert sorted(tuple(r) for r in found) == expected
    small = read_only_sql(spark, f"SELECT t.id, p.* FROM late_texts t, LATERAL {name}(t.text, 50, 10) p WHERE length(p.chunk_text) > 50").collect()
    assert small == []
    with pytest.raises(Exception, match="overlap"):
        read_only_sql(spark, f"SELECT p.* FROM late_texts t, LATERAL {name}(t.text, 50, 50) p").collect()
