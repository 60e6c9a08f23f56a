import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomdoc.llm import archive, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "page_id long, url string, html string, digest string"


def test_archive_round_trip(spark, tmp_path):
    long = "ä" * 600
    pages = [(1, "http://a", long, "x"), (5, "http://b c\r\n", long, "y"), (3, None, long, None), (4, "u", "short", ""),
             (6, "u", "short", ""), (7, "u", None, ""), (8, "u", "", ""), (None, "n", long, ""), (5, "b", long, ""),
             (9, "u", "z" * 5_000_000, "")]
    frame = spark.createDataFrame(pages, SCHEMA)
    archive.write_archive(frame, str(tmp_path))
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in archive.read_index(spark, str(tmp_path)).collect()}
    assert found == {(1, "revisit", 5, 1200), (5, "response", None, 1200), (3, "revisit", 5, 1200), (4, "response", None, 5),
                     (6, "response", None, 5), (7, "response", None, 0), (8, "response", None, 0), (None, "revisit", 5, 1200),
                     (9, "response", None, 5_000_000)}
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 4
    records = archive.read_records(spark, str(tmp_path)).collect()
    assert len(records) == len(pages)
    for r in records:
        head = bytes(r.header)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.endswith(b"\r\n\r\n") and head.count(b"\r\n\r\n") == 1
    assert any(b"WARC-Target-URI: http://b%20c%0D%0A\r\n" in bytes(r.header) for r in records)
    assert any(b"WARC-Target-URI: urn:page:3\r\n" in bytes(r.header) for r in records)


def test_archive_notices_damage(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([(1, "u", "text", "")], SCHEMA), str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/payloads").toPandas()
    stored["payload"] = [b"tex_"]
    spark.createDataFrame(stored).write.mode("overwrite").parquet(f"{tmp_path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        archive.read_index(spark, str(tmp_path)).collect()


def test_archive_of_nothing(spark):
    assert archive.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(4096) == [4096]


def test_packing_against_the_tokenizer(spark, monkeypatch):
    texts = ["Hello, World!", None, "", "    naïve ÄÖÜ straße é İ ΑΣ x", "it's we'll don't 12,345.6 a.b ... ,.",
             "wörd. " * 3000, "<|endoftext|> x<|startoftext|>y", "\x1c a\x0bb\x85c", "x" * 20_000, "ﬁ ½ 中文字 😀😀"]
    rows = [(i, t, "de", i) for i, t in enumerate(texts)] + [(0, texts[0], "de", 0), (None, "Hello", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, bucket string, start int")
    found = packing.pack(frame, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for length in packing.piece_lengths(len(ids)):
            expected.append((doc, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
            at += length
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found], key=lambda x: (x[0] or -1, *x[1:])) \
        == sorted(expected, key=lambda x: (x[0] or -1, *x[1:]))
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 for r in found)
    assert all(r.length == 1 << r.bucket for r in found)


def test_packing_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["a b c d e f", "f g h a b", "a"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == \
            [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
