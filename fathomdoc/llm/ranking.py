"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time, over an index of document blocks.

The index has a row for each block of a few megabytes of texts: its documents and their lengths, its terms as sorted
hashes, and for each term the documents that hold it with their counts. Every block is searched alone, so the work is
dealt out by documents: no term and no item is a group of one task.

In a block the short lists of an item are summed into accumulators, term at a time. These, in order of documents and
with their largest sum as bound, are then one list among the long ones. Document at a time, the lists whose bounds add
up to less than the score that a document must reach are not essential: only documents of the others are candidates,
and the rest is added from the largest bound on for as long as a candidate can still reach that score.

The score to reach starts at an item's k-th best among a sample of blocks, so few documents leave a task. All scores
are whole numbers, and documents that reach it exactly are kept, so the answer does not depend on any of this.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathomdoc.llm.common import NOT_ALPHANUMERIC, columns_of, share_below, slices, word_hashes, word_spans, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Items are searched for in groups of about so many bytes of text.
ITEM_BYTES = 8 << 20
#: A list is short below this share of a block's documents; documents are gone through by so many at a time.
SHORT, WINDOW = 1 / 16, 512
#: At least so many blocks are the sample.
SAMPLE = 16
#: Stands for a null id inside the search: such a document is the last of equals.
NO_ID = np.iinfo(np.int64).max

INDEX = "ids binary, lengths binary, terms binary, edges binary, docs binary, counts binary"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term: a run of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z."""
    row, start, end = word_spans(data, offsets, NOT_ALPHANUMERIC)
    return row, word_hashes(data, start, end)


def _block(ids: list, parts: list) -> pa.RecordBatch:
    """One block from (text, hash) of its slices."""
    sizes = [len(i) for i in ids]
    row = np.concatenate([r + at for (r, _), at in zip(parts, np.cumsum(sizes) - sizes)])
    term = np.concatenate([t for _, t in parts])
    lengths = np.bincount(row, minlength=sum(sizes))
    order = np.lexsort((row, term))
    row, term = row[order], term[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
    counts, row, term = np.diff(np.r_[new, len(row)]), row[new], term[new]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else new
    columns = (np.concatenate(ids).astype("<i8"), lengths.astype("<i8"), term[first].astype("<u8"), np.r_[first, len(term)].astype("<u4"),
               row.astype("<u4"), counts.astype("<u4"))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], INDEX.replace(" binary", "").split(", "))


def _index(batches):
    ids, parts, size = [], [], 0
    for batch in batches:
        for part, data, offsets in slices(batch):
            if size and size + len(data) > BLOCK_BYTES:
                yield _block(ids, parts)
                ids, parts, size = [], [], 0
            ids.append(part.column(0).fill_null(NO_ID).to_numpy())
            parts.append(_terms(data, offsets))
            size += len(data)
    if ids:
        yield _block(ids, parts)


def build_index(documents: DataFrame) -> DataFrame:
    """The index of the rows of (doc_id, text), one row for each block; write it to search it more than once.

    Null and empty texts are documents without terms. Other columns are ignored.
    """
    docs = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_index, INDEX)


@dataclass(frozen=True)
class Items:
    """Items as arrays: item i has ``terms[edges[i]:edges[i + 1]]``, places in ``hashes``, each ``repeats`` times."""

    hashes: np.ndarray
    edges: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, texts: list) -> "Items":
        """From the items' texts; null is empty."""
        batch = pa.record_batch({"text": pa.array(texts, pa.large_string())})
        rows, hashes, at = [], [], 0
        for part, data, offsets in slices(batch):
            row, term = _terms(data, offsets)
            rows.append(row + at)
            hashes.append(term)
            at += part.num_rows
        row = np.concatenate([np.zeros(0, np.int64), *rows])
        known, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
        pairs, repeats = np.unique(np.stack([row, term]), axis=1, return_counts=True)
        return cls(known, np.searchsorted(pairs[0], np.arange(len(texts) + 1)), pairs[1], repeats)


def _column(batch: pa.RecordBatch, name: str, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_buffer(), kind)


def _statistics(hashes: np.ndarray):
    """(what, n): documents holding each term of the items, by its place, -1 for documents, -2 for terms, -3 for blocks."""

    def count(batches):
        held, totals = np.zeros(len(hashes), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, terms, edges = (_column(batch, c, i, k) for c, k in (("lengths", "<i8"), ("terms", "<u8"), ("edges", "<u4")))
                totals += (np.count_nonzero(lengths), lengths.sum(), 1)
                at = np.searchsorted(terms, hashes)
                there = np.flatnonzero(at < len(terms))
                there = there[terms[at[there]] == hashes[there]]
                held[there] += edges[at[there] + 1].astype(np.int64) - edges[at[there]]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2, -3], pa.int64()), pa.array(np.r_[held[some], totals], pa.int64())], ["what", "n"])

    return count


class Best:
    """The k best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in least]
        self.ids = [np.zeros(0, np.int64) for _ in least]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], self.scores[item][-1])


def search_block(lists: list, ids: np.ndarray, item: int, best: Best) -> None:
    """Adds one item's best documents of a block. ``lists`` has (documents, contributions, bound) of each of its terms."""
    n = len(ids)
    short = [x for x in lists if len(x[0]) < SHORT * n]
    bounded = [x for x in lists if len(x[0]) >= SHORT * n]
    if short:
        # Term at a time; sums of such numbers are exact in doubles.
        sums = np.bincount(np.concatenate([x[0] for x in short]), np.concatenate([x[1] for x in short]), n).astype(np.int64)
        docs = np.flatnonzero(sums)
        if len(docs):
            bounded.append((docs, sums[docs], int(sums[docs].max())))
    bounded.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in bounded])
    at = 0
    while at < n and len(bounded):
        least = best.least[item]
        # Lists before this one cannot bring a document to the score to reach by themselves.
        essential = int(np.searchsorted(reach, least))
        if essential == len(bounded):
            return
        places = [int(np.searchsorted(x[0], at)) for x in bounded[essential:]]
        at = min((int(x[0][p]) for x, p in zip(bounded[essential:], places) if p < len(x[0])), default=n)
        if at >= n:
            return
        sums = np.zeros(WINDOW, np.int64)
        for docs, values, _ in bounded[essential:]:
            a, b = np.searchsorted(docs, (at, at + WINDOW))
            sums[docs[a:b] - at] += values[a:b]
        candidates = np.flatnonzero(sums)
        for k in reversed(range(essential)):
            candidates = candidates[sums[candidates] + reach[k] >= least]
            if not len(candidates):
                break
            docs, values, _ = bounded[k]
            place = np.searchsorted(docs, candidates + at)
            inside = np.flatnonzero(place < len(docs))
            inside = inside[docs[place[inside]] == candidates[inside] + at]
            sums[candidates[inside]] += values[place[inside]]
        candidates = candidates[sums[candidates] >= least]
        if len(candidates):
            best.add(item, sums[candidates], ids[candidates + at])
        at += WINDOW


def _search(items: Items, weights: np.ndarray, totals: tuple[int, int], least: np.ndarray, k: int):
    """(item, doc_id, score) of each item's k best documents among the blocks of a task."""

    def search(batches):
        best = Best(k, least)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, edges, docs, counts = (
                    _column(batch, c, i, t) for c, t in zip(INDEX.replace(" binary", "").split(", "), ("<i8", "<i8", "<u8", "<u4", "<u4", "<u4")))
                place = np.searchsorted(terms, items.hashes)
                place[place == len(terms)] = 0
                held = np.flatnonzero(terms[place] == items.hashes) if len(terms) else place[:0]
                if not len(held):
                    continue
                first, last = edges[place[held]].astype(np.int64), edges[place[held] + 1].astype(np.int64)
                size = last - first
                begin = np.cumsum(size) - size
                which = np.repeat(first - begin, size) + np.arange(int(size.sum()))
                doc, tf = docs[which].astype(np.int64), counts[which].astype(np.int64)
                m = 100 - 75 + (75 * lengths * totals[0]) // totals[1]
                value = np.repeat(weights[held], size) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                top = np.maximum.reduceat(value, begin)
                slot = np.full(len(items.hashes), -1)
                slot[held] = np.arange(len(held))
                for item in range(len(items.edges) - 1):
                    of = slice(items.edges[item], items.edges[item + 1])
                    at, times = slot[items.terms[of]], items.repeats[of]
                    at, times = at[at >= 0], times[at >= 0]
                    if int((top[at] * times).sum()) < best.least[item]:
                        continue
                    lists = [(doc[begin[s] : begin[s] + size[s]], value[begin[s] : begin[s] + size[s]] * t, int(top[s] * t))
                             for s, t in zip(at.tolist(), times.tolist())]
                    search_block(lists, ids, item, best)
        sizes = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *best.ids]), pa.int64()),
             pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]), pa.int64())], ["item", "doc_id", "score"])

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, numbered from 1."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_items(index: DataFrame, rows: list, k: int) -> DataFrame:
    """The answer for a group of items of bounded size."""
    spark, items = index.sparkSession, Items.of([r.text for r in rows])
    counted = dict(index.select("lengths", "terms", "edges").mapInArrow(_statistics(items.hashes), "what long, n long")
                   .groupBy("what").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False, name=None))
    n_docs, n_terms, n_blocks = (counted.get(c, 0) for c in (-1, -2, -3))
    held = np.array([counted.get(i, 0) for i in range(len(items.hashes))], np.int64)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    least, totals, schema = np.ones(len(rows), np.int64), (int(n_docs), max(1, int(n_terms))), "item long, doc_id long, score long"
    sample = max(SAMPLE, int(n_blocks**0.5))
    if n_blocks > 2 * sample:
        some = index.filter(share_below(F.xxhash64("ids", "docs"), sample / n_blocks, 12))
        first = _ranked(some.mapInArrow(_search(items, weights, totals, least, k), schema), k).filter(F.col("rank") == k).select("item", "score")
        for item, score in first.toArrow().to_pandas().itertuples(index=False, name=None):
            least[item] = score
    best = _ranked(index.mapInArrow(_search(items, weights, totals, least, k), schema), k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
    return best.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def search_index(index: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each distinct row of (item_id, text).

    Items come to the driver and go to the executors in groups of about ``item_bytes`` of text, with the statistics of
    their terms; each group reads the index once for these, a sample of it for the scores to reach, and once to rank.
    Null and empty texts, and items none of whose terms a document scores for, have no rows. Equal scores rank by
    doc_id, null ids last. Repeated documents are documents of their own; items that share an id are ranked each by
    itself. Terms are compared by 64-bit hashes.
    """
    asked = columns_of(items, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text <> ''").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // item_bytes)
    answers = None
    for group in range(groups):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).orderBy("item_id", "text").collect()
        if rows:
            found = _search_items(index, rows, k)
            answers = answers.unionByName(found) if answers else found
    if answers is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return answers


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of (doc_id, text) for each row of (item_id, text); see ``search_index``.

    Very long texts are read whole and are blocks of their own. An empty table on either side gives no rows.
    """
    return search_index(written(build_index(documents), "blocks"), items, k)
