import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from fathomdoc.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, ids string, chunk string"
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a", " \nb", "a ", "a  b   c", "one two one two", "a▁b ▁▁c", "tab\tand\r\nline", "\u00a0nbsp\u3000wide",
    "<s> </s> <unk> <0x0A>", "x\x00y", "🙂 emoji🙂🙂 ﬁ é", "ยาวมากไม่มีช่องว่าง" * 50, "word " * 30_000, "q" * 20_000, "mixed, (punct) 'quotes' 3.14 1,000",
]


def expected(text):
    ids = LIBRARY.encode(text or "")
    return ids, LIBRARY.decode(ids) if ids else ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c\n▁é🙂,.\t")) | st.characters(codec="utf-8"), max_size=40))
def test_chunks_stand_alone(text):
    chunks = pieces.chunks_of(text)
    assert "".join(c if c[:1] == "\n" else " " + c for c in chunks) == (" " + text.replace("▁", " ") if text else "")
    ids, texts = SEGMENTER(chunks)
    assert [i for c in ids for i in c] == LIBRARY.encode(text)
    assert "".join(t if c[:1] == "\n" else " " + t for c, t in zip(chunks, texts))[1:] == (LIBRARY.decode(LIBRARY.encode(text)) if text else "")


SEGMENTER = pieces.Segmenter(PATH)


@pytest.mark.parametrize("sent_bytes", [0, 2000, 8 << 20])
def test_encode_equals_library(spark, monkeypatch, sent_bytes):
    rows = [(i if i % 5 else None, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(1, TEXTS[9], "", "")] * 3
    found = pieces.encode(spark.createDataFrame(rows, SCHEMA), PATH, sent_bytes).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in found) == sorted((str(d), *expected(t)) for d, t, *_ in rows)


def test_workers_forget_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "HELD", 5)
    empty = pa.table({"chunk": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32())), "other": pa.array([], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, empty.schema) as out:
        out.write_table(empty)

    class Sent:
        value = sink.getvalue().to_pybytes()

    texts = ["a b c d", "d e f g h i j", "a x\ud7a3y", "k\u2581l"] * 2
    batches = [pa.record_batch({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t])}) for i, t in enumerate(texts)]
    out = [r for b in pieces._encode(PATH, "test", Sent)(batches) for r in b.to_pylist()]
    assert [(r["ids"], r["decoded"]) for r in out] == [expected(t) for t in texts]


def test_chunk_table_counts_all(spark):
    rows = [(1, "to be or not to be\nto be", "", ""), (2, None, "", ""), (3, "be", "", "")]
    counts = {r.chunk: r.n for r in pieces.chunk_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert counts == {"to": 2, "be": 4, "or": 1, "not": 1, "\nto": 1}


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_equals_library(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in queries.QUERIES["op13_distinct_chunk_pieces"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids, text = expected(d.text)
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
