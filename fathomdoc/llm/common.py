"""Shared by the operators: words and shingles of Arrow text columns as numpy arrays, and a bounded fetch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomdoc.session import work_folder

#: A word is a run of other characters than these (space, tab, line feed, vertical tab, form feed, return).
SPACE_BYTES = (32, 9, 10, 11, 12, 13)
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The same where a word or a byte of the text becomes many numbers for a time, and slices need no size.
SMALL_SLICE_BYTES = 1 << 19
#: Bytes of words that are hashed at a time.
HASHED_BYTES = 1 << 15

_random = np.random.default_rng(20240229)
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _CODE.copy()
_FOLDED[65:91] = _CODE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: For callers that take punctuation as blank too: all ASCII characters but letters and digits.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that no other column of the input can clash with one of ours."""
    return df.select(*[df[n] for n in names])


def slices(batch: pa.RecordBatch, column: str = "text", lower: bool = False,
           size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of its text column; null is the empty text. Of a batch with long texts
    only one slice is copied or put in lower case at a time."""
    whole = batch.column(column)
    stops = np.cumsum(pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(whole):
        before = int(stops[first - 1]) if first else 0
        last = min(len(whole), max(first + 1, int(np.searchsorted(stops, before + size, "right"))))
        texts = pc.fill_null(whole.slice(first, last - first), "").cast(pa.large_string())
        texts = pc.utf8_lower(texts) if lower else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        yield batch.slice(first, last - first), data[offsets[0] : offsets[-1]], offsets - offsets[0]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word; a word never crosses from one text to the next."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return np.searchsorted(offsets, start, "right") - 1, start, np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of every word, with A-Z as a-z if ``fold``: a polynomial in random byte codes, then mixed.

    Words are in the order of their places and do not overlap. A word's polynomial is the difference of two running sums
    over the bytes of a stretch, divided by the power at its start; the base is odd, so it has an inverse modulo 2^64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    out, table, first = np.empty(len(start), np.uint64), _FOLDED if fold else _CODE, 0
    most = min(HASHED_BYTES, int(end[-1] - start[0]))
    power = np.cumprod(np.full(most, _BASE))
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(most, _INVERSE)])
    while first < len(start):
        low = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, low + most, "right")))
        length = int(end[last - 1]) - low
        # Only a word that is longer than a stretch has more bytes; it is one by itself.
        codes = table[data[low : low + length]] * (power[:length] if length <= most else np.cumprod(np.full(length, _BASE)))
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        begins = start[first:last] - low
        out[first:last] = (sums[end[first:last] - low] - sums[begins]) * inverse[begins]
        first = last
    return mix(out)


def shingles(row: np.ndarray, words: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted; a text of fewer words is one shingle, a text of none has none."""
    count = np.bincount(row, minlength=n_rows)
    if len(words) >= width:
        whole = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            whole = whole * _BASE + words[i : len(words) - width + 1 + i]
        same = row[: len(whole)] == row[width - 1 :]
        rows, hashes = row[: len(whole)][same], mix(whole[same])
    else:
        rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = (count > 0) & (count < width)
    if short.any():
        part = np.flatnonzero(short[row])
        first = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.r_[first, len(part)]))
        value = np.add.reduceat(words[part] * mix(place.astype(np.uint64) + np.uint64(77)), first)
        rows = np.concatenate([rows, row[part][first]])
        hashes = np.concatenate([hashes, mix(value + count[row[part][first]].astype(np.uint64))])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])] if len(rows) else np.zeros(0, bool)
    return rows[new], hashes[new]


def share_below(key: Column, share: float, seed: int) -> Column:
    """True for about this share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the number as text, modulo."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


class Sent:
    """An object of bounded size on all executors. It travels with its class, so executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value: object):
        self._pickled = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        """The object; to be asked for once in a task."""
        return cloudpickle.loads(self._pickled.value)


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: computed once, kept when executors go."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
