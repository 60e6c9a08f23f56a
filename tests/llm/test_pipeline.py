import __spark_entry__ as entry
import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomdoc.llm import decontaminate, packing
from fathomdoc.llm.common import written
from tests.llm.test_jaccard import brute
from tests.llm.test_linededup_quality import brute_lines

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(9001, "123 456", None, "x", 7), (9002, None, None, "x", None), (9003, "", "en", "x", 0)], docs.schema)
    docs = docs.union(junk)
    tables = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, tables[-1], FOLDER)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        tables.append(written(out, name))
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    assert set(rows[1]) == set(rows[0]) - {9001, 9002, 9003} and all(rows[1][d] == rows[0][d] for d in rows[1])

    gone = {}
    for doc, line, *_ in brute_lines(sorted(rows[1].items())):
        gone.setdefault(doc, set()).add(line)
    texts = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows[1].items()}
    assert rows[2] == {d: t for d, t in texts.items() if d not in gone or t.strip(" \t\n\v\f\r")}
    assert tables[2].filter(F.length("text") != F.col("n_chars")).isEmpty()

    assert rows[3] == {d: rows[2][d] for d, _, c in brute(sorted(rows[2].items()), 5, 80) if d == c}

    items = [decontaminate._of_text(r.text).tobytes() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {d for d, t in rows[3].items() if not any(i in decontaminate._of_text(t).tobytes() for i in items)}
    assert set(rows[4]) <= clean and len(rows[4]) >= len(clean) - 2 and all(rows[4][d] == rows[3][d] for d in rows[4])

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    expected = sorted((d, length) for d, t in rows[4].items()
                      for length in packing.piece_lengths(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1))
    assert sorted((r.doc_id, r.length) for r in tables[5].collect()) == expected


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "stage") if docs.columns[0] == "doc_id" else docs
    assert docs.count() == 0


def test_registration():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert np.all([callable(f) for _, f in pipeline.STAGES])
