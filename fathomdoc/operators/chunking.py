"""Splitting documents into overlapping passages; every passage keeps its document's columns."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.session import once

# Paragraph, line, word, character.
SEPARATORS = ("\n\n", "\n", " ", "")
# Texts whose passages a worker holds and sends together, out of the many of a batch.
TEXTS_AT_ONCE = 256


def fixed_windows(df: DataFrame, text: str, size: int = DEFAULTS.chunk_size,
                  overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Windows of ``size`` characters, one every ``size - overlap``; adds chunk_no and chunk_text.

    This is what the recursive splitter gives for text without separators. No shuffle, no Python.
    """
    step = size - overlap
    # Cut once into blocks of one step, of which neighbours make a window: linear in the length of the text.
    cut = once(df, _blocks=F.regexp_extract_all(text, F.lit(f"((?s).{{1,{step}}})"), F.lit(1)))
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    windows = once(cut, _windows=F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(
        F.concat(*[F.coalesce(F.get("_blocks", i + n), F.lit("")) for n in range(-(-size // step))]), 1, size))))
    return windows.drop("_blocks").select("*", F.posexplode("_windows").alias("chunk_no", "chunk_text")).drop("_windows")


def _pieces(text: str, separator: str) -> list[str]:
    """Text cut before every separator, so that each later piece starts with it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Consecutive pieces packed up to ``size``; the next pack starts with the tail of the last one.

    ``lo:hi`` is the open pack. Its start moves on until it is within the overlap and leaves room.
    """
    lo = total = 0
    for hi, piece in enumerate(pieces):
        if total + len(piece) > size and hi > lo:
            yield "".join(pieces[lo:hi])
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(pieces[lo])
                lo += 1
        total += len(piece)
    if lo < len(pieces):
        yield "".join(pieces[lo:])


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Passages of at most ``size`` characters, cut at the coarsest separator that works."""
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[level + 1:]
    found: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        found += _pack(small, size, overlap)
        small = []
        found += split_text(piece, size, overlap, finer) if finer else [piece]
    found += _pack(small, size, overlap)
    return [s for s in (c.strip() for c in found) if s]


def recursive_chunks(df: DataFrame, text: str, size: int = DEFAULTS.chunk_size,
                     overlap: int = DEFAULTS.chunk_overlap,
                     separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Adds chunk_no and chunk_text, one row per passage; texts without passages give no row."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), TEXTS_AT_ONCE):
                texts = batch.slice(start, TEXTS_AT_ONCE).to_pylist()
                yield pa.array([split_text(t, size, overlap, separators) if t else [] for t in texts], pa.list_(pa.string()))

    return df.select("*", F.posexplode(split(text)).alias("chunk_no", "chunk_text"))


class _Passages:
    """Table function: the passages of one text."""

    def eval(self, text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap):
        if size is None or overlap is None or not 0 <= overlap < size:
            raise ValueError("an overlap from 0 to less than the size is needed")
        yield from enumerate(split_text(text, size, overlap) if text else [])


def register_splitter(spark: SparkSession, name: str = "split_passages") -> str:
    """Makes the splitter of ``recursive_chunks`` a table function for statements, and gives its name.

    ``SELECT d.id, p.* FROM docs d, LATERAL split_passages(d.text, 1000, 200) p`` gives chunk_no and chunk_text of each
    passage; size and overlap may be left out. Null and empty texts have no passages. Rows travel as Arrow batches.
    """
    spark.udtf.register(name, F.udtf(_Passages, returnType="chunk_no int, chunk_text string", useArrow=True))
    return name
