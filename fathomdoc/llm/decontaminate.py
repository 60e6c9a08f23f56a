"""Benchmark passages in documents, found in a latent space and checked word by word.

Words are runs of letters and digits in lower case. Their document frequencies are counted over all documents. The
terms of the benchmark span a TF-IDF space; a randomised singular value decomposition, its products computed by Spark
tasks, keeps the strongest directions. Every window of every document is projected there, by its benchmark terms, and
compared with all items of about its length; windows that hold too few of the rarer words of any such item are left out,
as none can reach the least subsequence, and other words around a passage count for nothing. A pair that is near enough is checked by the longest common subsequence of words, and, if that alone does not
decide, by the item's answer. Verbatim items need no space: the heaviest five words of an item lead to them.
"""

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomdoc.llm.common import NOT_ALPHANUMERIC, SMALL_SLICE_BYTES, Sent, columns_of, mix, slices, word_hashes, word_spans, written

#: Items that are compared at a time; more are taken in blocks.
BLOCK_ITEMS = 2048
BUCKETS = 1 << 15
#: Directions kept of the decomposition, and spare ones; its rounds, and the tasks of a product, each of which returns one
#: array of the size of the directions.
RANK, SPARE, ROUNDS, PARTS = 96, 16, 2, 32
FIT_WINDOW = 32
#: Up to this many terms their products are summed pair by pair in one pass, in an array of 2 * terms^2 bytes; and the sums
#: that leave a task at a time.
PAIRED_TERMS, PAIRS_AT_ONCE = 4096, 1 << 16
LEAST_COSINE, LEAST_WORDS = 0.5, 5
#: Leading bits of a hash by which terms and seeds are looked up; windows that are projected at a time.
FIRST_BITS, WINDOWS_AT_ONCE = 16, 2048
#: A window's projection on the direction of an item is at least this share of the item's own length there.
LEAST_HELD = 0.5
#: Share of an item's words found in order: enough alone, or enough with this share of its answer.
SURE_LCS, LEAST_LCS, LEAST_ANSWER, ANSWER_WORDS = 0.8, 0.6, 0.6, 5
#: An item of which at least c words are found has at least k of its 1 - c + k rarest words found; these are the k looked
#: at, as shares of c.
RAREST = (0.2, 0.1, 0.3, 1.0)
PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer double, start long"


def _words(data, offsets):
    row, start, end = word_spans(data, offsets, NOT_ALPHANUMERIC)
    return row, word_hashes(data, start, end)


def _of_text(text: str) -> np.ndarray:
    _, data, offsets = next(slices(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), lower=True))
    return _words(data, offsets)[1]


def lcs_length(pattern: np.ndarray, text: np.ndarray) -> int:
    """Longest common subsequence, one step of bit arithmetic for each word of the text."""
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full, state = (1 << len(pattern)) - 1, (1 << len(pattern)) - 1
    for word in text.tolist():
        if mask := masks.get(word):
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return len(pattern) - state.bit_count()


def answer_of(text: str) -> np.ndarray:
    """Words after the last question mark, or else the last few words."""
    after = _of_text(text.rpartition("?")[2]) if "?" in text else np.zeros(0, np.uint64)
    return after if len(after) else _of_text(text)[-ANSWER_WORDS:]


def window_of(length: int) -> int:
    """The window for items of this many words: the next of 8, 12, 16, 24, 32, 48, ..."""
    power = 1 << max(3, math.ceil(math.log2(max(length, 1))))
    return power * 3 // 4 if power > 8 and length <= power * 3 // 4 else power


def _first_bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FIRST_BITS)).astype(np.int64)


def runs_of(h: np.ndarray, width: int = LEAST_WORDS) -> np.ndarray:
    """A hash of the ``width`` words from each word on, where there are as many."""
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        whole = mix(whole + h[i : len(whole) + i])
    return whole


@dataclass(frozen=True)
class Space:
    """Term hashes in order, their directions, and the weight of every hashed word."""

    terms: np.ndarray
    basis: np.ndarray
    idf: np.ndarray

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """Number of the term of each hash, -1 without one: compared with the terms that begin with the same bits."""
        count = np.bincount(_first_bits(self.terms), minlength=1 << FIRST_BITS)
        bits, begin = _first_bits(h), np.cumsum(count) - count
        at = np.minimum(begin[bits], len(self.terms) - 1)
        out = np.where(self.terms[at] == h, at, -1)
        for more in range(1, int(count.max())):
            rest = np.flatnonzero(count[bits] > more)
            at = begin[bits[rest]] + more
            met = self.terms[at] == h[rest]
            out[rest[met]] = at[met]
        return out


def document_frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and in how many of them a word of each hash bucket occurs."""

    def count(batches):
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part, data, offsets in slices(batch, lower=True, size=SMALL_SLICE_BYTES):
                row, h = _words(data, offsets)
                # 32 bits hold the pairs of a slice, unless it has very many short texts.
                kind = np.uint32 if part.num_rows * BUCKETS <= 1 << 32 else np.int64
                pairs = np.sort(row.astype(kind) * kind(BUCKETS) + (h % np.uint64(BUCKETS)).astype(kind))
                pairs = np.r_[pairs[:1], pairs[1:][pairs[1:] != pairs[:-1]]]
                seen += np.bincount(pairs % kind(BUCKETS), minlength=BUCKETS)
                total += part.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[total, seen[used]])], ["bucket", "n"])

    table = (columns_of(documents, "text").mapInArrow(count, "bucket long, n long").groupBy("bucket")
             .agg(F.sum("n").alias("n")).toArrow())
    frequency = np.zeros(BUCKETS + 1)
    frequency[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return int(frequency[-1]), frequency[:-1]


def _fit_windows(terms: np.ndarray, idf: np.ndarray):
    """Sparse unit rows of the texts' windows: (window sizes, terms, values) for each batch slice."""

    def cut(batches):
        space = Space(terms, np.zeros((0, 0)), idf)
        for batch in batches:
            for _, data, offsets in slices(batch, lower=True, size=SMALL_SLICE_BYTES):
                row, h = _words(data, offsets)
                if not len(h):
                    continue
                first = np.searchsorted(row, row)
                window = row * (len(h) + 1) + (np.arange(len(h)) - first) // FIT_WINDOW
                weight, term = idf[(h % np.uint64(BUCKETS)).astype(np.int64)], space.term_of(h)
                begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
                length = np.diff(np.r_[begin, len(h)])
                norm = np.repeat(np.sqrt(np.maximum(np.add.reduceat(weight**2, begin), 1e-12)), length)
                known = term >= 0
                number = np.repeat(np.arange(len(begin)), length)[known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()]) for a in (number.astype("<i4"), term[known].astype("<i4"),
                                                       (weight / norm)[known].astype("<f4"))], ["window", "term", "value"])

    return cut


def _gram(window: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """X' (X basis) for sparse rows in order of their window."""
    out = np.zeros_like(basis)
    if not len(window):
        return out
    marks = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    for first in range(0, len(marks), 2048):
        begin = marks[first : first + 2048]
        stop = marks[first + 2048] if first + 2048 < len(marks) else len(window)
        t, v = term[begin[0] : stop], value[begin[0] : stop, None]
        rows = np.add.reduceat(basis[t] * v, begin - begin[0], axis=0)
        back = np.repeat(rows, np.diff(np.r_[begin, stop]), axis=0) * v
        order = np.argsort(t, kind="stable")
        place = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
        out[t[order][place]] += np.add.reduceat(back[order], place, axis=0)
    return out


def _distributed_gram(windows: DataFrame, basis: np.ndarray) -> np.ndarray:
    def multiply(batches):
        total = np.zeros_like(basis)
        for batch in batches:
            for i in range(batch.num_rows):
                window, term, value = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in enumerate(("<i4", "<i4", "<f4")))
                total += _gram(window, term, value, basis)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    parts = windows.coalesce(PARTS).mapInArrow(multiply, "part binary").toArrow().column("part").to_pylist()
    return sum((np.frombuffer(p, np.float32).reshape(basis.shape) for p in parts), np.zeros_like(basis))


def _paired_gram(documents: DataFrame, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """X'X of the windows of all documents, and the number of entries of X; only sums of pairs of terms leave the tasks."""
    n, fit = len(terms), _fit_windows(terms, idf)
    # Where the row of each term begins among the pairs (low, high) with low <= high, less its own number.
    begin = np.arange(n, dtype=np.int64) * (2 * n - 1 - np.arange(n, dtype=np.int64)) // 2

    def pairs(batches):
        total, entries = np.zeros(n * (n + 1) // 2, np.float32), 0
        for batch in fit(batches):
            window, term, value = (np.frombuffer(batch.column(c)[0].as_py(), k) for c, k in enumerate(("<i4", "<i4", "<f4")))
            term, entries = term.astype(np.int64), entries + len(term)
            np.add.at(total, begin[term] + term, value * value / 2)
            for apart in range(1, FIT_WINDOW):
                first = np.flatnonzero(window[apart:] == window[:-apart])
                low, high = term[first], term[first + apart]
                np.add.at(total, begin[np.minimum(low, high)] + np.maximum(low, high), value[first] * value[first + apart])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(entries)])], ["pair", "n"])
        for at in range(0, len(total), PAIRS_AT_ONCE):
            part = total[at : at + PAIRS_AT_ONCE]
            used = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(used + at), pa.array(part[used].astype(np.float64))], ["pair", "n"])

    table = (documents.select("text").mapInArrow(pairs, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow())
    pair, summed = table.column("pair").to_numpy(), table.column("n").to_numpy()
    known = pair >= 0
    low = np.searchsorted(begin + np.arange(n), pair[known], "right") - 1
    half = np.zeros((n, n), np.float32)
    half[low, pair[known] - begin[low]] = summed[known]
    return half + half.T, int(summed[~known].sum())


def fit_space(documents: DataFrame, items: list[np.ndarray], n_docs: int, frequency: np.ndarray) -> Space:
    """The strongest directions of TF-IDF passages: the windows of all documents, and the items, which weigh as much as
    all of these windows together."""
    terms = np.unique(np.concatenate(items))
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1e-3
    weight = idf[(terms % np.uint64(BUCKETS)).astype(np.int64)]
    space = Space(terms, np.zeros((0, 0)), idf)
    own = [space.term_of(i) for i in items]
    item_rows = (np.repeat(np.arange(len(own)), [len(t) for t in own]), np.concatenate(own),
                 np.concatenate([weight[t] / np.sqrt((weight[t] ** 2).sum()) for t in own]).astype(np.float32))
    if len(terms) <= PAIRED_TERMS:
        gram, entries = _paired_gram(documents, terms, idf)
    else:
        sparse = written(documents.select("text").mapInArrow(_fit_windows(terms, idf), "window binary, term binary, value binary"), "windows")
        entries = (sparse.agg(F.sum(F.octet_length("window"))).first()[0] or 0) // 4
    boost = np.float32(max(1.0, entries / FIT_WINDOW / max(1, len(items))))
    rank = min(RANK + SPARE, len(terms))
    basis = np.random.default_rng(3).normal(size=(len(terms), rank)).astype(np.float32)

    def product(b: np.ndarray) -> np.ndarray:
        return (gram @ b if len(terms) <= PAIRED_TERMS else _distributed_gram(sparse, b)) + boost * _gram(*item_rows, b)

    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    _, turn = np.linalg.eigh(basis.T @ product(basis))
    return Space(terms, (basis @ turn[:, ::-1][:, :RANK]).astype(np.float32), idf)


class Searcher:
    """The items of one block in the latent space, and the search of a slice of documents for them."""

    def __init__(self, space: Space, ids: list[int], words: list[np.ndarray], answers: list[np.ndarray]):
        self.space, self.ids, self.words, self.answers = space, ids, words, answers
        vectors = np.array([self._vector(w) for w in words], np.float32)
        norms = np.maximum(np.sqrt((vectors**2).sum(1)), 1e-9)
        vectors /= norms[:, None]
        sizes = np.array([window_of(len(w)) for w in words])
        self.by_size = [(int(s), np.flatnonzero(sizes == s), vectors[sizes == s], norms[sizes == s]) for s in np.unique(sizes)]
        self.rare = [[self._rarest(items, share) for share in RAREST] for _, items, *_ in self.by_size]
        self._seed()
        # Tasks need the directions with the weights of the terms only, and a row of zeros for other words.
        self.weighted = np.r_[space.basis * self._weight(space.terms)[:, None], np.zeros((1, space.basis.shape[1]))].astype(np.float32)
        self.space = replace(space, basis=space.basis[:0])

    def _rarest(self, items: np.ndarray, share: float) -> tuple[np.ndarray, int]:
        """Marks of terms (the last one for other words), of which a window must hold the returned number, else it holds
        ``LEAST_LCS`` of none of these items."""
        marks, least = np.zeros(len(self.space.terms) + 1, bool), len(self.space.terms)
        for words in (self.words[i] for i in items):
            found = math.ceil(LEAST_LCS * len(words) - 1e-9)
            wanted = max(1, int(share * found))
            rarest = np.argsort(-self._weight(words), kind="stable")[: len(words) - found + wanted]
            marks[self.space.term_of(words[rarest])] = True
            least = min(least, wanted)
        return marks, least

    def _seed(self) -> None:
        """The heaviest run of each item, in order of its hash, with its item and place there."""
        place = np.array([np.convolve(self._weight(w), np.ones(LEAST_WORDS), "valid").argmax() for w in self.words])
        seeds = np.array([runs_of(w[p : p + LEAST_WORDS])[0] for w, p in zip(self.words, place)], np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.seeded, self.seed_place = seeds[order], order, place[order]
        self.ends = np.array([(w[0], w[-1]) for w in self.words], np.uint64)
        self.lengths = np.array([len(w) for w in self.words])

    def _weight(self, h: np.ndarray) -> np.ndarray:
        return self.space.idf[(h % np.uint64(BUCKETS)).astype(np.int64)]

    def _verbatim(self, h: np.ndarray, first: np.ndarray, stop: np.ndarray):
        """(first word, item) of every place where the words are those of an item."""
        runs = runs_of(h)
        begun = np.zeros(1 << FIRST_BITS, bool)
        begun[_first_bits(self.seeds)] = True
        met = np.flatnonzero(begun[_first_bits(runs)])
        low, high = (np.searchsorted(self.seeds, runs[met], side) for side in ("left", "right"))
        count = high - low
        at = np.repeat(met, count)
        seed = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        item, start = self.seeded[seed], at - self.seed_place[seed]
        end = start + self.lengths[item]
        inside = (start >= first[at]) & (end <= stop[at])
        start, end, item = start[inside], end[inside], item[inside]
        same = (h[start] == self.ends[item, 0]) & (h[end - 1] == self.ends[item, 1])
        for a, b, i in zip(start[same].tolist(), end[same].tolist(), item[same].tolist()):
            if np.array_equal(h[a:b], self.words[i]):
                yield a, i

    def _vector(self, h: np.ndarray) -> np.ndarray:
        weight = self._weight(h)
        return (self.space.basis[self.space.term_of(h)] * weight[:, None]).sum(0)

    def _windows(self, block, begin, end, step, term) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and lengths of windows that are runs of blocks; each block is projected once."""
        used = np.zeros(len(block), np.int64)
        np.add.at(used, begin, 1)
        np.add.at(used, end, -1)
        used = np.flatnonzero(np.cumsum(used) > 0)
        # One row more than there are blocks: of zeros, for windows with fewer blocks. So is the last row of the terms.
        vectors = np.zeros((len(used) + 1, self.weighted.shape[1]), np.float32)
        first, length = block[used], block[used + 1] - block[used]
        for k in range(step):
            word = np.where(length > k, term[np.minimum(first + k, len(term) - 1)], -1)
            vectors[:-1] += self.weighted[word]
        place, length = np.searchsorted(used, begin), end - begin
        out = vectors[place]
        for k in range(1, int(length.max())):
            out += vectors[np.where(length > k, place + k, -1)]
        norm = np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)
        return out / norm, norm

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, item, cosine, lcs, answer, first word) of every pair that counts as a copy, the best window of each."""
        row, h = _words(data, offsets)
        if not len(h):
            return []
        term = self.space.term_of(h)
        n_words = np.bincount(row, minlength=len(offsets) - 1)
        begins = np.cumsum(n_words) - n_words
        first = begins[row]
        stop = first + n_words[row]
        best: dict[tuple[int, int], tuple] = {}
        for start, item in self._verbatim(h, first, stop):
            pair = (1.0, 1.0, 1.0, -int(start - first[start]))
            best[int(row[start]), item] = max(best.get((int(row[start]), item), pair), pair)
        held = np.zeros(len(h) + 1, np.int32)
        for (size, items, vectors, norms), rare in zip(self.by_size, self.rare):
            step = max(1, size // 8)
            # Blocks of `step` words; a window is a run of blocks of one document, and starts at each of them.
            blocks = -(-n_words // step)
            after, text = np.cumsum(blocks), np.repeat(np.arange(len(blocks)), blocks)
            place = (np.arange(len(text)) - (after - blocks)[text]) * step
            block = np.append(begins[text] + place, len(h))
            begin = np.flatnonzero(place < np.maximum(n_words - size + step, 1)[text])
            end = np.minimum(begin + -(-size // step), after[text[begin]])
            for marks, least in rare:
                np.cumsum(marks.astype(np.int32)[term], out=held[1:])
                start = block[begin]
                low, high = np.maximum(first[start], start - step), np.minimum(stop[start], block[end] + step)
                kept = held[high] - held[low] >= least
                begin, end = begin[kept], end[kept]
            for at in range(0, len(begin), WINDOWS_AT_ONCE):
                b, e = begin[at : at + WINDOWS_AT_ONCE], end[at : at + WINDOWS_AT_ONCE]
                units, long = self._windows(block, b, e, step, term)
                near = units @ vectors.T
                for i, j in zip(*np.nonzero((near >= LEAST_COSINE) & (near * long >= LEAST_HELD * norms))):
                    start, item = int(block[b[i]]), int(items[j])
                    r = int(row[start])
                    if best.get((r, item), (0,))[0] == 1:
                        continue
                    low, high = max(int(first[start]), start - step), min(int(stop[start]), int(block[e[i]]) + step)
                    words, pattern, answer = h[low:high], self.words[item], self.answers[item]
                    lcs = lcs_length(pattern, words) / len(pattern)
                    if lcs < LEAST_LCS:
                        continue
                    found = lcs_length(answer, words) / len(answer)
                    if lcs >= SURE_LCS or found >= LEAST_ANSWER:
                        pair = (lcs, round(float(near[i, j]), 4), found, -int(start - first[start]))
                        best[r, item] = max(best.get((r, item), pair), pair)
        return [(r, self.ids[i], cosine, lcs, found, -start) for (r, i), (lcs, cosine, found, start) in sorted(best.items())]


def _searchers(documents: DataFrame, benchmark: DataFrame):
    """A searcher for each block of items; items with fewer than ``LEAST_WORDS`` words are not searched for."""
    items = columns_of(benchmark, "item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = math.ceil(items.count() / BLOCK_ITEMS)
    n_docs, frequency = document_frequencies(documents) if blocks else (0, None)
    for block in range(blocks):
        table = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        texts = table.column("text").to_pylist()
        words = [_of_text(t) for t in texts]
        some = [i for i, w in enumerate(words) if len(w) >= LEAST_WORDS]
        if some:
            ids, own = [table.column("item_id")[i].as_py() for i in some], [words[i] for i in some]
            space = fit_space(documents, own, n_docs, frequency)
            yield Searcher(space, ids, own, [answer_of(texts[i]) for i in some])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start): each row of ``documents`` with each benchmark item it holds.

    ``lcs`` and ``answer`` are the shares of the item's and its answer's words found in order, ``start`` the window's
    first word. A pair counts if lcs is at least ``SURE_LCS``, or at least ``LEAST_LCS`` with ``LEAST_ANSWER`` of the
    answer. Null and empty texts hold nothing; repeated rows are reported each; null ids stay null; other columns are
    ignored. Documents and items are used whole, also very long ones. Of several windows the one with the greatest lcs
    counts, then cosine, then answer, then the first; equal items are reported each. Empty tables give no rows. A verbatim
    item is always found, with a cosine of 1 and the place of its first word; items under ``LEAST_WORDS`` words are not
    looked for.
    """
    spark: SparkSession = documents.sparkSession
    docs = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = spark.createDataFrame([], PAIRS)
    for searcher in _searchers(docs, benchmark):
        sent = Sent(spark, searcher)

        def search(batches, sent=sent):
            searcher = sent.get()
            for batch in batches:
                for part, data, offsets in slices(batch, lower=True, size=SMALL_SLICE_BYTES):
                    if found := searcher.find(data, offsets):
                        rows, *rest = zip(*found)
                        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(rest, kinds)]],
                            ["doc_id", "item_id", "cosine", "lcs", "answer", "start"])

        result = result.union(docs.mapInArrow(search, PAIRS))
    return result


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no benchmark item; see ``contaminated``."""
    clean = documents
    for searcher in _searchers(columns_of(documents, "doc_id", "text"), benchmark):
        sent = Sent(documents.sparkSession, searcher)

        def keep(batches, sent=sent):
            searcher = sent.get()
            for batch in batches:
                for part, data, offsets in slices(batch, lower=True, size=SMALL_SLICE_BYTES):
                    clean_rows = np.ones(part.num_rows, bool)
                    clean_rows[[f[0] for f in searcher.find(data, offsets)]] = False
                    yield part.filter(pa.array(clean_rows))

        clean = clean.mapInArrow(keep, documents.schema)
    return clean
