import pytest
from pyspark.sql import functions as F

from fathomdoc.operators.answer import generate
from fathomdoc.operators.failures import TooManyFailures, require, watched
from fathomdoc.operators.rerank import model_scores
from fathomdoc.sources import files as FS


def models():
    """Made here, so that they travel with the tasks."""

    def down(*_):
        raise RuntimeError("down")

    def half(prompts):
        if any(p.endswith("1") for p in prompts):
            raise ValueError("odd")
        return [p.upper() for p in prompts]

    return down, half


def prompts_of(spark, n=20):
    return spark.range(n, numPartitions=3).select(F.col("id").alias("query_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("prompt"))


def test_a_model_that_is_down_ends_the_job(spark, tmp_path):
    for fn, failed in zip(models(), (20, 10)):
        answers, seen = watched(generate(prompts_of(spark), fn), F.col("error").isNotNull())
        answers.write.parquet(str(tmp_path / fn.__name__))
        assert seen.get == {"rows": 20, "failed": failed}
        require(seen, failed / 20)
        with pytest.raises(TooManyFailures, match=f"{failed} of 20 rows"):
            require(seen, failed / 20 - 0.01)
    # The rows are written all the same, with their errors.
    assert spark.read.parquet(str(tmp_path / "down")).filter("error = 'internal_error'").count() == 20


def test_scores_empty_tables_and_null_conditions(spark):
    pairs = spark.range(6).select(F.col("id").alias("query_id"), F.lit(0).alias("cand_idx"), F.lit("q").alias("question"),
                                  F.lit("c").alias("content"))
    scored, seen = watched(model_scores(pairs, models()[0]), F.col("score").isNull(), "scores")
    scored.collect()
    assert seen.get == {"rows": 6, "failed": 6}
    none, seen = watched(pairs.limit(0), F.lit(True), "none")
    none.collect()
    require(seen, 0.0)
    unknown, seen = watched(pairs, F.lit(None).cast("boolean"), "unknown")
    unknown.collect()
    require(seen, 0.0)


def test_texts_that_are_not_utf8(spark, tmp_path):
    good = {"a.txt": "Zoë\r\nline", "sub/B.TXT": "two", "e.txt": ""}
    for name, text in good.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 \xff\xfe")
    (tmp_path / "other.md").write_bytes(b"\xff")
    found = {r.file_name: r.text for r in FS.read_text_documents(spark, str(tmp_path)).collect()}
    assert found["a.txt"] == "Zoë\r\nline" and found["B.TXT"] == "two" and "bad.txt" not in found
    assert [tuple(r) for r in FS.text_rejects(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/bad.txt", "not UTF-8")]
