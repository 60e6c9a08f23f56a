"""Packing by powers of two: each document is cut into pieces of binary lengths, each piece a sequence of its own."""

import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomdoc.llm.common import columns_of

MOST = 4096
END_ID = 2
#: Words whose ids a Python worker remembers; it starts anew when they are more.
REMEMBERED = 800_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"

#: The bytes that the vocabulary's byte alphabet shows as themselves.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """``n`` as pieces of ``most`` and then of falling powers of two."""
    return [most] * (n // most) + [1 << b for b in reversed(range(most.bit_length())) if n % most >> b & 1]


class WordIds:
    """Ids of texts, word by word: the tokenizer never joins characters across white space, so words can be remembered.

    Plain lower-case words go straight to the merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int | None = None):
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered or REMEMBERED
        self.ids: dict[str, bytes] = {"": b""}
        self.plain = re.compile(r"([a-zß-öø-ÿ]+)([.,]?)")
        hidden = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in _SHOWN else next(hidden)) for b in range(256)}
        self.marks = {m: self._whole([m])[0] for m in ".,"} | {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > self.remembered:
            self.ids.clear()
            self.ids[""] = b""
        others, merge = [], self.tokenizer.model.tokenize
        for word in words:
            if match := self.plain.fullmatch(word.lower()):
                letters = match[1]
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(self.alphabet)
                self.ids[word] = np.array([t.id for t in merge(letters)], "<u4").tobytes() + self.marks[match[2]]
            else:
                others.append(word)
        for word, ids in zip(others, self._whole(others)):
            self.ids[word] = ids

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if new := {w for p in parts for w in p if w not in self.ids}:
            # Clearing the memory also forgets words of this batch, so ask again for all that are missing.
            self.learn(new)
            if missing := {w for p in parts for w in p if w not in self.ids}:
                self.learn(missing)
        return [b"".join(map(self.ids.__getitem__, p)) for p in parts]


def _tokenizer(path: str, remembered: int | None) -> WordIds:
    """One per worker process, kept between tasks."""
    kept = sys.modules.setdefault("fathomdoc_worker_tokenizers", types.ModuleType("fathomdoc_worker_tokenizers"))
    key = f"{remembered} {path}"
    if key not in kept.__dict__:
        kept.__dict__[key] = WordIds(path, remembered)
    return kept.__dict__[key]


def _pieces(path: str, most: int, remembered: int | None):
    def cut(batches):
        ids_of, end = _tokenizer(path, remembered), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                docs, rows = part.column(0).to_pylist(), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(docs, ids_of.of(texts)):
                    ids += end
                    at, total = 0, len(ids) // 4
                    for length in piece_lengths(total, most):
                        crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                        rows.append((doc, at, length, crc, total, length.bit_length() - 1))
                        at += length
                types_ = [pa.int64()] * 5 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types_)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"])

    return cut


def pack(documents: DataFrame, tokenizer_path: str, most: int = MOST, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text): each has a power of two of tokens, fills a sequence alone and needs no
    padding, so no sequence crosses documents.

    A document is the ids of its text and then id 2; null and empty texts are that one id. ``bucket`` is the binary
    logarithm of the length; sequences of one bucket can be stacked into batches. Sequence ids are unique and do not
    depend on ids, so repeated rows and null ids are packed like others. Nothing is shuffled. ``most`` is a power of
    two. ``remembered`` bounds the words whose ids a worker keeps. Other columns are ignored.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    docs = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = docs.mapInArrow(_pieces(tokenizer_path, most, remembered), PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
