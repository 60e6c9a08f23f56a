"""SentencePiece ids by a table of distinct chunks: each chunk is segmented once, its ids join back by position.

No piece of the vocabulary holds a white-space marker after another character, and none holds a line feed, so a text
can be cut before every run of blanks and before every line feed without cutting a piece. A corpus has far fewer
distinct chunks than chunks. All are counted; the commonest, as many as a fixed number of bytes holds, are segmented
once for the corpus and sent to the executors as a table, and each text joins its chunks to this table in their order.
The chunks outside the table are segmented once in each worker that meets them and remembered there, as joining them
to the texts by a shuffle would move all texts and, for each such chunk of each text, its key and ids.
"""

import re
import sys
import types
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomdoc.llm.common import columns_of, written

#: Bytes of chunks and ids that are sent to the executors.
SENT_BYTES = 16 << 20
#: Distinct chunks that a counting task holds before it passes them on, and that a worker remembers outside the table.
HELD = 100_000
#: Texts encoded at a time, and about how many characters of them.
TEXTS, CHARACTERS = 64, 1 << 20

MARK = "▁"
_CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")
_PROBE = "One  two▁three \n\n ﬁx é 　\U0001f642 a\tb "


def chunks_of(text: str) -> list[str]:
    """The chunks of a text in order. One that begins with a line feed is as it stands in the text; all others follow
    a blank, or the blank that encoding puts before a text, which is left off."""
    if not text:
        return []
    text = " " + text.replace(MARK, " ")
    if "  " in text or " \n" in text or text[-1] == " ":
        return [c if c[0] == "\n" else c[1:] for c in _CHUNK.findall(text)]
    return text[1:].replace("\n", " \n").split(" ")


class Segmenter:
    """Ids and text of chunks, by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}|\n", p)]
        ids, texts = self(chunks_of(_PROBE))
        if crossing or list(chain(*ids)) != self.model.encode(_PROBE):
            raise ValueError(f"chunks of this vocabulary do not stand alone: {crossing[:3]}")

    def __call__(self, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
        ids = self.model.encode(chunks, num_threads=1)
        # Before a line feed the marker that encoding adds is a piece of its own; alone it is added to no empty text.
        alone = [self.model.piece_to_id(MARK)]
        ids = [i[1:] if c[:1] == "\n" else i or alone for c, i in zip(chunks, ids)]
        return ids, self.model.decode(ids, num_threads=1) if ids else []


def _segmenter(path: str) -> Segmenter:
    """One per worker process, kept between tasks."""
    kept = sys.modules.setdefault("fathomdoc_worker_segmenters", types.ModuleType("fathomdoc_worker_segmenters"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Segmenter(path)
    return kept.__dict__[path]


def _texts(batches):
    """Parts of the batches of a few texts each, with the texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        if not texts:
            continue
        group = np.cumsum([len(t) for t in texts]) // CHARACTERS + np.arange(len(texts)) // TEXTS
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]).tolist()
        for first, last in zip(edges, edges[1:]):
            yield batch.slice(first, last - first), texts[first:last]


def _count(batches):
    def out():
        got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], ["chunk", "n"])
        held.clear()
        return got

    held: Counter[str] = Counter()
    for _, texts in _texts(batches):
        for text in texts:
            held.update(chunks_of(text))
            if len(held) > HELD:
                yield out()
    yield out()


def _segment(path: str):
    def segment(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                chunks = part.column(0).to_pylist()
                ids, texts = _segmenter(path)(chunks)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())),
                     pa.array([None if c == t else t for c, t in zip(chunks, texts)], pa.string())],
                    [*part.schema.names, "ids", "other"])

    return segment


def chunk_counts(documents: DataFrame) -> DataFrame:
    """(chunk, n) of all distinct chunks of the column ``text``: how often each occurs in the corpus."""
    counted = columns_of(documents, "text").mapInArrow(_count, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def _least_sent(counts: DataFrame, sent_bytes: int) -> int:
    """The least count of chunks that are sent, a power of two: those with it or more hold at most ``sent_bytes``.

    A chunk has at most one id for each of its bytes and one for the marker.
    """
    size = 5 * F.octet_length("chunk") + F.lit(16)
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum(size).alias("bytes")).collect()
    least, total = 62, 0
    for row in sorted(levels, key=lambda r: -r.level):
        total += row.bytes
        if total > sent_bytes:
            break
        least = row.level
    return 1 << least


def chunk_table(documents: DataFrame, model_path: str, sent_bytes: int = SENT_BYTES) -> pa.Table:
    """(chunk, n, ids, other) of the commonest chunks of the corpus, at most ``sent_bytes`` of them: how often each
    occurs, its ids, and the text that these stand for if it is not the chunk itself."""
    counts = written(chunk_counts(documents), "chunks")
    common = counts.filter(F.col("n") >= _least_sent(counts, sent_bytes))
    return common.mapInArrow(_segment(model_path), "chunk string, n long, ids array<int>, other string").toArrow()


class _Known:
    """Ids as bytes of each chunk, and the text of chunks that decode to another one."""

    def __init__(self, sent: bytes):
        rows = pa.ipc.open_stream(sent).read_all()
        chunks, ids, others = (rows.column(c).combine_chunks() for c in ("chunk", "ids", "other"))
        chunks, edges = chunks.to_pylist(), ids.offsets.to_numpy()
        data = ids.values.to_numpy().astype("<i4").tobytes()
        self.ids = {c: data[4 * a : 4 * b] for c, a, b in zip(chunks, edges, edges[1:])}
        self.other = {c: o for c, o in zip(chunks, others.to_pylist()) if o is not None}
        self.learned: list[str] = []

    def learn(self, present: set[str], segmenter: Segmenter) -> None:
        """The chunks outside the table that are present; those learned before are forgotten when they are many."""
        new = [c for c in present if c not in self.ids]
        if new and len(self.learned) + len(new) > HELD:
            for c in self.learned:
                del self.ids[c]
                self.other.pop(c, None)
            self.learned, new = [], [c for c in present if c not in self.ids]
        ids, texts = segmenter(new)
        for c, i, t in zip(new, ids, texts):
            self.ids[c] = np.array(i, "<i4").tobytes()
            if t != c:
                self.other[c] = t
        self.learned += new


def _known(key: str, sent) -> _Known:
    """The sent table as dictionaries, built once per worker process; only those of the latest table are kept."""
    kept = sys.modules.setdefault("fathomdoc_worker_chunks", types.ModuleType("fathomdoc_worker_chunks"))
    if kept.__dict__.get("key") != key:
        kept.key, kept.known = key, _Known(sent.value)
    return kept.known


def _encode(path: str, key: str, sent):
    """Ids and decoded text of each text."""

    def encode(batches):
        known = _known(key, sent)
        for part, texts in _texts(batches):
            rows = [chunks_of(t) for t in texts]
            present = set(chain.from_iterable(rows))
            known.learn(present, _segmenter(path))
            found = [b"".join(map(known.ids.__getitem__, r)) for r in rows]
            strange = known.other.keys() & present
            decoded = [t.replace(MARK, " ") for t in texts]
            for i in [i for i, r in enumerate(rows) if strange and not strange.isdisjoint(r)]:
                parts = [known.other.get(c, c) for c in rows[i]]
                decoded[i] = "".join([t if c[:1] == "\n" else " " + t for c, t in zip(rows[i], parts)])[1:]
            edges = np.r_[0, np.cumsum([len(f) // 4 for f in found])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encode


def encode(documents: DataFrame, model_path: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, text): the ids that the library's ``encode`` gives the whole
    text, and the text that its ``decode`` gives these.

    Null and empty texts have no ids and decode to the empty text. Repeated rows come out as often as they went in,
    null ids stay null, an empty table gives an empty one, columns besides these two are ignored. A text is worked on
    whole; one without blanks and line feeds is one chunk. There are no ties. ``sent_bytes`` changes no result. A
    vocabulary whose pieces cross chunks, or that alters the characters of a text, is refused.
    """
    documents = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table, sink = chunk_table(documents, model_path, sent_bytes), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = documents.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return documents.mapInArrow(_encode(model_path, uuid.uuid4().hex, sent), "doc_id long, ids array<int>, decoded string")
