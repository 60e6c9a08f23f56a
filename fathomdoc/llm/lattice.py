"""Likelihood of a text under a subword lattice: every segmentation into pieces of a given vocabulary counts.

The vocabulary and its scores come from an existing tokenizer file. Its scores are merge ranks; read by Zipf's law they
are the first piece probabilities, and one round of expectation over the training words makes them probabilities of
this corpus. No piece spans a blank, so the probability of a text is the product over its words: each distinct word is
scored once, by a forward recursion in log space over the pieces that end at each character.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.llm.common import slices, word_hashes, word_spans, written

#: A word of at least this share of all words is sent to the executors, so at most 1,000,000 words are.
FREQUENT_SHARE = 1e-6
MOST_PIECE = 16
LONG_WORD = 48
LOG10 = math.log(10)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lattice:
    """Pieces with log probabilities; ``pieces`` maps text to place, the 256 bytes stand at the end."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.place = {p: i for i, p in enumerate(pieces)}
        self.log_p = log_p
        self.longest = max(map(len, pieces))
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        keys = np.array([self._hash(c) for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.n = len(pieces)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in codes:
            h = h * _BASE + c + np.uint64(1)
        return h[0]

    def _single(self, character: str) -> tuple[int, float, bytes]:
        """Place and log probability of one character; without a piece of its own it is written in bytes."""
        if (i := self.place.get(character)) is not None:
            return i, self.log_p[i], b""
        raw = character.encode("utf-8", "surrogatepass")
        return -1, float(sum(self.log_p[self.n + b] for b in raw)), raw

    def slow(self, word: str, weight: float = 0.0, counts: np.ndarray | None = None) -> float:
        """Natural log of the word's probability, character by character; used for very long words.

        With a weight, the expected count of every piece and byte is added to ``counts``. Edges are looked up again on
        the way back, so memory is two numbers a character.
        """
        word, best = "▁" + word, [0.0]
        for end in range(1, len(word) + 1):
            found = [best[end - 1] + self._single(word[end - 1])[1]]
            for start in range(max(0, end - self.longest), end - 1):
                if (i := self.place.get(word[start:end])) is not None:
                    found.append(best[start] + self.log_p[i])
            most = max(found)
            best.append(most + math.log(sum(math.exp(x - most) for x in found)))
        if counts is not None and weight:
            self._expect_slow(word, best, weight, counts)
        return best[-1]

    def _expect_slow(self, word: str, forward: list[float], weight: float, counts: np.ndarray) -> None:
        backward = [0.0] * len(forward)
        for start in range(len(word) - 1, -1, -1):
            place, log_p, raw = self._single(word[start])
            edges = [([place] if place >= 0 else [self.n + b for b in raw], log_p + backward[start + 1])]
            for end in range(start + 2, min(len(word), start + self.longest) + 1):
                if (i := self.place.get(word[start:end])) is not None:
                    edges.append(([i], self.log_p[i] + backward[end]))
            most = max(x for _, x in edges)
            backward[start] = most + math.log(sum(math.exp(x - most) for _, x in edges))
            for places, x in edges:
                share = weight * math.exp(forward[start] + x - forward[-1])
                for i in places:
                    counts[i] += share

    def _edges(self, codes: np.ndarray):
        """For words of one length as rows of code points: (start, end, rows or all, piece, log probability)."""
        n, length = codes.shape
        known, back = np.unique(codes, return_inverse=True)
        back = back.reshape(n, length)
        singles = [self._single(chr(c)) for c in known]
        place, single = np.array([s[0] for s in singles]), np.array([s[1] for s in singles])
        prefix = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE)])
        edges = []
        for end in range(1, length + 1):
            edges.append((end - 1, end, None, place[back[:, end - 1]], single[back[:, end - 1]], back[:, end - 1]))
            for start in range(max(0, end - self.longest), end - 1):
                key = prefix[:, end] - prefix[:, start] * power[end - start]
                at = np.minimum(np.searchsorted(self.keys, key), self.n - 1)
                rows = np.flatnonzero(self.keys[at] == key)
                if len(rows):
                    ids = self.ids[at[rows]]
                    edges.append((start, end, rows, ids, self.log_p[ids], None))
        return edges, singles

    def _forward(self, n: int, length: int, edges) -> np.ndarray:
        """Log probability of each prefix, by log-space sums over the pieces that end there."""
        forward = np.full((n, length + 1), -np.inf)
        forward[:, 0] = 0
        for start, end, rows, _, log_p, _ in edges:
            at = slice(None) if rows is None else rows
            forward[at, end] = np.logaddexp(forward[at, end], forward[at, start] + log_p)
        return forward

    def words(self, words: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word; with weights also the expected count of every piece and byte."""
        result, counts = np.zeros(len(words)), np.zeros(len(self.log_p))
        texts = words.to_pylist()
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            if length > LONG_WORD:
                for i in chosen:
                    result[i] = self.slow(texts[i]) if weights is None else self.slow(texts[i], weights[i], counts)
                continue
            for first in range(0, len(chosen), 4096):
                some = chosen[first : first + 4096]
                codes = np.frombuffer("".join("▁" + texts[i] for i in some).encode("utf-32-le", "surrogatepass"),
                                      "<u4").reshape(len(some), length)
                edges, singles = self._edges(codes)
                forward = self._forward(len(some), length, edges)
                result[some] = forward[:, -1]
                if weights is not None:
                    self._expect(edges, singles, forward, weights[some], counts)
        return result, counts

    def _expect(self, edges, singles, forward, weights, counts) -> None:
        backward = np.full_like(forward, -np.inf)
        backward[:, -1] = 0
        for start, end, rows, _, log_p, _ in reversed(edges):
            at = slice(None) if rows is None else rows
            backward[at, start] = np.logaddexp(backward[at, start], log_p + backward[at, end])
        for start, end, rows, ids, log_p, character in edges:
            at = slice(None) if rows is None else rows
            share = weights[at] * np.exp(forward[at, start] + log_p + backward[at, end] - forward[at, -1])
            own = ids >= 0
            counts[: self.n] += np.bincount(ids[own], share[own], minlength=self.n)[: self.n]
            if character is not None and not own.all():
                total = np.bincount(character[~own], share[~own], minlength=len(singles))
                for i in np.flatnonzero(total):
                    for b in singles[i][2]:
                        counts[self.n + b] += total[i]


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file, short enough and no control pieces, and first log probabilities.

    A merge rank r gives a weight of 1/(r + 2.7); a byte weighs as the last piece.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or len(text) > MOST_PIECE:
            continue
        pieces.append(text)
        weights.append(1 / (min(-model.get_score(i), 1e6) + 2.7))
    p = np.array(weights + [min(weights)] * 256)
    return pieces, np.log(p / p.sum())


def _word_counts(batches):
    """(word, h, c_all, c_train): the distinct words of each batch, with A-Z as a-z."""
    for batch in batches:
        for part, data, offsets in slices(batch):
            train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            row, start, end = word_spans(data, offsets)
            if not len(row):
                continue
            h, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
            length = (end - start)[first]
            marks = np.r_[0, np.cumsum(length)]
            inside = np.arange(marks[-1]) - np.repeat(marks[:-1], length)
            text = _LOWER[data[np.repeat(start[first], length) + inside]]
            words = pa.LargeStringArray.from_buffers(len(h), pa.py_buffer(marks.astype(np.int64)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays(
                [words.cast(pa.string()), pa.array(h.view(np.int64)), pa.array(np.bincount(back)),
                 pa.array(np.bincount(back, weights=train[row]).astype(np.int64))], ["word", "h", "c_all", "c_train"])


def _expected(pieces: list[str], log_p: np.ndarray):
    def count(batches):
        lattice, total = Lattice(pieces, log_p), np.zeros(len(log_p))
        for batch in batches:
            total += lattice.words(batch.column(0), batch.column(1).to_numpy().astype(float))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "expected"])

    return count


def _scored(pieces: list[str], log_p: np.ndarray):
    def score(batches):
        lattice = Lattice(pieces, log_p)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(lattice.words(batch.column(0))[0] / LOG10)],
                ["h", "c_all", "c_train", "log_p"])

    return score


def _documents(frequent):
    """Rows of a document: sums over its frequent words on the first, then one row for each other word.

    Columns: rid (number of the document), doc_id, held_out, n_tokens, n_known, base, score (on its first row), h.
    A document without other words has one row, whose h is no word's.
    """

    def rows(batches):
        from pyspark import TaskContext

        keys, base, log_p, known = frequent.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, data, offsets in slices(batch):
                n = part.num_rows
                row, start, end = word_spans(data, offsets)
                h = word_hashes(data, start, end).view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                sums = [np.bincount(row[hit], values[at[hit]], minlength=n) for values in (known, base, log_p)]
                rest_row, rest = row[~hit], h[~hit]
                first = np.flatnonzero(np.bincount(rest_row, minlength=n) == 0)
                docs = np.concatenate([rest_row, first])
                key = np.concatenate([rest, np.zeros(len(first), np.int64)])
                key[len(rest):] = number + first  # spreads them; is_word keeps them from meeting a word
                lead = np.r_[True, rest_row[1:] != rest_row[:-1], np.ones(len(first), bool)][: len(docs)] if len(rest) \
                    else np.ones(len(docs), bool)
                empty = ~lead
                column = lambda values, kind: pa.array(values[docs], kind, mask=empty)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + docs), part.column(0).take(pa.array(docs)), part.column(2).take(pa.array(docs)),
                     column(np.bincount(row, minlength=n) + 1, pa.int64()), column(sums[0].astype(np.int64), pa.int64()),
                     column(sums[1], pa.float64()), column(sums[2], pa.float64()), pa.array(key),
                     pa.array(np.arange(len(docs)) < len(rest))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "is_word"])
                number += n

    return rows


def score_documents(documents: DataFrame, train: Column, vocabulary_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text).

    Tokens are the words of the text with A-Z as a-z and one end. ``base_score`` is the add-one unigram score of the
    tokens, ``score`` the log10 probability of the text under the lattice; both learn from the rows where ``train``
    holds. Null texts are empty: their one token is the end. Repeated rows are scored each. Other columns are ignored.
    Without training rows every base probability is 1 and the pieces keep their first probabilities.

    Words are counted over all documents; words of a share of at least ``FREQUENT_SHARE`` are known to every task, the
    others meet their documents by a join on a 64-bit hash.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = written(docs.mapInArrow(_word_counts, "word string, h long, c_all long, c_train long")
                      .groupBy("word", "h").agg(F.sum("c_all").alias("c_all"), F.sum("c_train").alias("c_train")), "words")
    n_docs = docs.agg(F.count_if("train")).first()[0]
    n_all, n_train, distinct = counted.agg(F.coalesce(F.sum("c_all"), F.lit(0)), F.coalesce(F.sum("c_train"), F.lit(0)),
                                           F.count_if(F.col("c_train") > 0)).first()
    tokens, types = n_train + n_docs, distinct + (n_docs > 0)

    pieces, log_p = read_vocabulary(vocabulary_path)
    expected = (counted.filter("c_train > 0").select("word", "c_train")
                .mapInArrow(_expected(pieces, log_p), "piece long, expected double")
                .groupBy("piece").agg(F.sum("expected").alias("n")).toArrow())
    if expected.num_rows:
        p = np.ones(len(log_p))
        p[expected.column("piece").to_numpy()] += expected.column("n").to_numpy()
        log_p = np.log(p / (p.sum() + n_docs + 1))
        log_end = math.log10((n_docs + 1) / (p.sum() + n_docs + 1))
    else:
        log_end = -math.log10(len(log_p) + 1)
    scored = written(counted.mapInArrow(_scored(pieces, log_p), "h long, c_all long, c_train long, log_p double"), "scored")

    floor = math.log10(tokens + types + 1)
    base = lambda c: F.log10(c + F.lit(1.0)) - F.lit(floor)
    common = scored.filter(F.col("c_all") >= F.lit(n_all * FREQUENT_SHARE)).toArrow()
    order = np.argsort(common.column("h").to_numpy())
    c = common.column("c_train").to_numpy()[order]
    frequent = spark.sparkContext.broadcast((common.column("h").to_numpy()[order], np.log10(c + 1.0) - floor,
                                             common.column("log_p").to_numpy()[order], (c > 0).astype(float)))
    rows = docs.select("doc_id", "text", (~F.col("train")).alias("held_out")).mapInArrow(
        _documents(frequent), f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, "
        "n_known long, base double, score double, h long, is_word boolean")
    rare = scored.filter(F.col("c_all") < F.lit(n_all * FREQUENT_SHARE)).select(
        F.col("h").alias("rare_h"), "c_train", F.col("log_p").alias("rare_p"))
    met = rows.join(rare, F.col("is_word") & (F.col("h") == F.col("rare_h")), "left")
    zero = F.lit(0.0)
    sums = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.count_if(F.col("c_train") > 0)).alias("n_known"),
        (F.sum(F.coalesce("base", zero)) + F.sum(F.when(F.col("rare_h").isNotNull(), base(F.col("c_train"))).otherwise(zero))).alias("base"),
        (F.sum(F.coalesce("score", zero)) + F.sum(F.coalesce("rare_p", zero))).alias("score"))
    return sums.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.round(F.col("base") + base(F.lit(n_docs)), 6).alias("base_score"),
        F.round(F.col("score") + F.lit(log_end), 6).alias("score"))
