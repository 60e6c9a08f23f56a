"""Similarity join of documents on word shingles, exact, in the metric space of sets under the Jaccard distance.

The distance d(x, y) = 1 - |x and y| / |x or y| is a metric, and documents link when it is at most r. Nearly all
documents are at distance 1 from any other, so pivots that are documents cannot part them at first; the first pivots
are the sets of one shingle each. A document lies in the regions of its first pivots in a fixed order of all shingles,
as many as a linked document could lack and one more, so linked documents always share a region.

Each region with several documents then takes a document as pivot. By the triangle inequality a document within r of
the pivot can only link with documents within 2r, and other links run among documents farther than r: the region falls
into a near and a far part, those between r and 2r are in both, and the parts are joined in the same way. A part whose
documents are all in one component already is done. Parts that are small, or left after some rounds, are compared
in bounded blocks.

Two bounds save exact distances: counts of a document's shingles in 256 cells of the hash space differ by no more than
the sets do, and sizes bound the distance. Only pairs within these bounds are compared set by set.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomdoc.llm.common import SMALL_SLICE_BYTES, Sent, columns_of, mix, share_below, shingles, slices, word_hashes, word_spans, written
from fathomdoc.llm.components import components
from fathomdoc.operators.late import late_join

CELLS = 256
#: Documents from which the order of the shingles is taken, and words and frequent shingles that it knows. The order
#: decides only how much work there is, never which documents link.
ORDER_SAMPLE, KNOWN_WORDS, KNOWN_SHINGLES, FREQUENT = 5000, 1 << 16, 1 << 16, 3
#: Rounds of pivots at most; they end when no region is larger than this.
ROUNDS, SMALL = 3, 4096
#: Documents of a region that are compared with each other in one task at most.
BLOCK = 1024
#: Smallest regions of a document that its rows carry, so that a pair is compared in one of its regions only.
LISTED, _NONE = 8, np.iinfo(np.int64).max
#: A set of ids is sent to all executors only if it was counted and is not larger.
SENT_IDS = 500_000
SETS = ("doc_id long, n long, f1 long, f2 long, anchors array<long>, cells binary, text_id long")


def _order_counts(width: int):
    """(kind, hash, n): how often words (0) and in how many documents shingles (1) occur in the sample."""

    def count(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                row, start, end = word_spans(data, offsets)
                words = word_hashes(data, start, end)
                for kind, hashes in ((0, words), (1, shingles(row, words, width, part.num_rows)[1])):
                    h, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)],
                                                     ["kind", "h", "n"])

    return count


class ShingleOrder:
    """A fixed order of all shingles: rare words first, frequent words last, frequent shingles after all others."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, frequent: np.ndarray, width: int):
        order = np.argsort(words)
        self.words, self.level = words[order], np.round(4 * np.log2(counts[order] + 1.0)).astype(np.int64)
        self.frequent, self.width = np.sort(frequent), width

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return at, table[at] == values

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the distinct shingles of each text, in the order of the keys; keys stand for shingles."""
        n_rows = len(offsets) - 1
        row, start, end = word_spans(data, offsets)
        words = word_hashes(data, start, end)
        at, known = self._find(self.words, words)
        level = np.where(known, self.level[at] if len(self.level) else 0, 0)
        sums = np.cumsum(np.r_[0, level])
        # A shingle's level follows from its words alone: look its hash up among those of all places.
        rows, hashes = shingles(row, words, self.width, n_rows)
        if len(words) >= self.width:
            whole = np.zeros(len(words) - self.width + 1, np.uint64)
            for i in range(self.width):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - self.width + 1 + i]
            every, first = np.unique(mix(whole), return_index=True)
            place, found = self._find(every, hashes)
            bucket = np.where(found, (sums[self.width:] - sums[: -self.width])[first[place]], 0)
        else:
            bucket = np.zeros(len(hashes), np.int64)
        bucket = np.where(self._find(self.frequent, hashes)[1], 255, np.minimum(bucket, 254)).astype(np.uint64)
        keys = (bucket << np.uint64(55)) | (hashes >> np.uint64(9))
        order = np.lexsort((keys, rows))
        return rows[order], keys[order]


def fit_order(documents: DataFrame, width: int) -> ShingleOrder:
    n_docs = documents.count()
    counts = (documents.filter(F.col("doc_id").isNotNull() & share_below(F.col("doc_id"), ORDER_SAMPLE / max(1, n_docs), 9))
              .select("text").mapInArrow(_order_counts(width), "kind int, h long, n long")
              .groupBy("kind", "h").agg(F.sum("n").alias("n")).filter((F.col("kind") == 0) | (F.col("n") >= FREQUENT)))
    known = [counts.filter(F.col("kind") == kind).orderBy(F.desc("n"), "h").limit(most).toArrow()
             for kind, most in ((0, KNOWN_WORDS), (1, KNOWN_SHINGLES))]
    h = [t.column("h").to_numpy().view(np.uint64) for t in known]
    return ShingleOrder(h[0], known[0].column("n").to_numpy(), h[1], width)


def least_common(n: np.ndarray | int, percent: int):
    """Fewest shingles that a document of n must share with one it links with."""
    return (percent * n + 99) // 100


def fingerprints(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.r_[np.uint64(0), np.cumsum(mix(keys ^ np.uint64(salt)))]
        edge = np.searchsorted(rows, np.arange(n_rows + 1))
        out.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(order, percent: int):
    def describe(batches):
        known = order.get()
        for batch in batches:
            for part, data, offsets in slices(batch, size=SMALL_SLICE_BYTES):
                n_rows = part.num_rows
                rows, keys = known.sets(data, offsets)
                n = np.bincount(rows, minlength=n_rows)
                f1, f2 = fingerprints(rows, keys, n_rows)
                first = np.cumsum(n) - n
                taken = np.where(n > 0, n - least_common(n, percent) + 1, 0)
                within = np.arange(len(keys)) - first[rows]
                marks = np.r_[0, np.cumsum(taken)].astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(marks), pa.array(keys[within < taken[rows]].view(np.int64)))
                cells = np.bincount(rows * CELLS + (keys % np.uint64(CELLS)).astype(np.int64), minlength=n_rows * CELLS)
                cells = np.minimum(cells, 255).astype(np.uint8).reshape(n_rows, CELLS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(f1), pa.array(f2), anchors, pa.array([c.tobytes() for c in cells]), part.column(2)],
                    ["doc_id", "n", "f1", "f2", "anchors", "cells", "text_id"])

    return describe


def _bounds(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether cell counts and sizes leave a link possible, and a distance of at most twice the bound."""
    apart = np.maximum(np.abs(a.astype(np.int32) - b).sum(-1), np.abs(n_a - n_b))
    total = n_a + n_b
    # Sets that differ in `apart` shingles share at most (total - apart) / 2 of (total + apart) / 2.
    return (100 * (total - apart) >= percent * (total + apart),
            100 * (total - apart) >= (2 * percent - 100) * (total + apart))


def _cells(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _possible(percent: int):
    def bound(batches):
        for batch in batches:
            if batch.num_rows:
                link, twice = _bounds(_cells(batch.column(4)), _cells(batch.column(5)), *[batch.column(c).to_numpy() for c in (2, 3)], percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link), pa.array(twice)],
                                                 ["a", "b", "link", "twice"])

    return bound


def _keys(order):
    """(node, keys): the set of each text; rows whose text is not the one of the class go."""

    def make(batches):
        known = order.get()
        for batch in batches:
            for part, data, offsets in slices(batch, size=SMALL_SLICE_BYTES):
                rows, keys = known.sets(data, offsets)
                edge = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys.view(np.int64)))
                right = pa.array(fingerprints(rows, keys, part.num_rows)[0] == part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "keys"]).filter(right)

    return make


def _compared(percent: int):
    """(a, b, link, twice): exact, from the two sets."""

    def compare(batches):
        for batch in batches:
            sides = []
            for c in (2, 3):
                lists = batch.column(c)
                marks = lists.offsets.to_numpy()
                sides.append((lists.values.to_numpy(), marks))
            out = []
            for i in range(batch.num_rows):
                x, y = (values[marks[i] : marks[i + 1]] for values, marks in sides)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                out.append((100 * common >= percent * union, 100 * common >= (2 * percent - 100) * union))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in zip(*out)]], ["a", "b", "link", "twice"])

    return compare


def _elsewhere(first: np.ndarray, second: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Pairs whose smallest common region is known to be another: it is the smallest one that both lists have, as each
    list holds the smallest regions of its document. Without one in common, the pair is taken wherever it meets."""
    common = np.where((first[:, :, None] == second[:, None, :]).any(2), first, _NONE).min(1)
    return (common != _NONE) & (common != region)


def _in_blocks(percent: int):
    """Pairs (a, b) that may link among rows sorted by (region, i, j, n): each row meets the next ones of its cell, as
    long as their sizes allow a link. A batch ends with a whole cell; the rows of its last cell wait for the next."""

    def pairs(table: pa.Table):
        cell = np.stack([table.column(c).to_numpy() for c in ("region", "i", "j")])
        node, n, label, side = (table.column(c).to_numpy() for c in ("node", "n", "label", "side"))
        number = np.cumsum(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(0)])
        counts = _cells(table.column("cells"))
        lists = np.full((len(node), LISTED), _NONE)
        for row, regions in enumerate(table.column("regions").to_pylist()):
            lists[row, : len(regions)] = regions
        first = np.arange(len(node))
        for k in range(1, len(node)):
            first = first[first < len(node) - k]
            second = first + k
            met = (number[first] == number[second]) & (percent * n[second] <= 100 * n[first])
            first, second = first[met], second[met]
            if not len(first):
                break
            asked = (label[first] != label[second]) & ((cell[1][first] == cell[2][first]) | (side[first] != side[second]))
            a, b = first[asked], second[asked]
            link, _ = _bounds(counts[a], counts[b], n[a], n[b], percent)
            a, b = a[link], b[link]
            own = ~_elsewhere(lists[a], lists[b], cell[0][a])
            if own.any():
                a, b = node[a[own]], node[b[own]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def compare(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            last = np.ones(rows.num_rows, bool)
            for c in ("region", "i", "j"):
                values = rows.column(c).to_numpy()
                last &= values == values[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from pairs(rows.slice(0, cut))
            waiting = rows.slice(cut)
        if waiting is not None:
            yield from pairs(waiting)

    return compare


class _Join:
    """One run of the join; tables are written between steps, so none is computed twice."""

    def __init__(self, documents: DataFrame, width: int, percent: int):
        self.percent = percent
        self.docs = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.spark = documents.sparkSession
        self.order = Sent(self.spark, fit_order(self.docs, width))
        self.sets = written(self.docs.withColumn("text_id", F.xxhash64("text")).mapInArrow(_sets(self.order, percent), SETS), "sets")
        # Equal sets are one node; grouping keeps one row for each set and task before the shuffle.
        self.nodes = written(self.sets.filter("n > 0").groupBy("f1", "f2", "n").agg(
            F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors"), F.first("cells").alias("cells"))
            .filter("doc_id IS NOT NULL").withColumnRenamed("f1", "node"), "nodes")
        self.links = None

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = written(self.nodes.select("node", "doc_id").join(wanted, "node"), "wanted")
        small = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
        return written(self.docs.join(small, "doc_id").select("node", "text").mapInArrow(
            _keys(self.order), "node long, keys array<long>"), "keys")

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(a, b, link, twice) of each pair: whether it links, and whether the distance may be within twice the bound."""
        facts = self.nodes.select("node", "n", "cells")
        met = pairs
        for side in "ab":
            met = met.join(facts.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("cells").alias(f"cells_{side}")), side)
        bounded = written(met.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(
            _possible(self.percent), "a long, b long, link boolean, twice boolean"), "bounded")
        near = bounded.filter("link").select("a", "b")
        keys = self._sets_of(near)
        exact = (near.join(keys.select(F.col("node").alias("b"), F.col("keys").alias("keys_b")), "b")
                 .join(keys.select(F.col("node").alias("a"), F.col("keys").alias("keys_a")), "a")
                 .select("a", "b", "keys_a", "keys_b")
                 .mapInArrow(_compared(self.percent), "a long, b long, link boolean, twice boolean"))
        return written(bounded.filter("NOT link").union(exact).distinct(), "distances")

    def _add_links(self, found: DataFrame) -> None:
        new = found.filter("link").select("a", "b")
        self.links = new if self.links is None else self.links.union(new)

    def _labelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of those regions that still hold several components."""
        marked = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = (marked.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
                 .filter("low <> high").select("region", "size"))
        return marked.join(open_, "region")

    @staticmethod
    def _pivots(member: DataFrame) -> DataFrame:
        """The first document of each region with several."""
        return (member.groupBy("region").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("size"))
                .filter("size > 1").select("region", F.col("first.node").alias("pivot")))

    def run(self) -> DataFrame:
        member = self.nodes.select("node", "doc_id", "n", F.explode("anchors").alias("region"))
        # Nearly all regions have one document and end here: of these, eight bytes are shuffled to count them.
        several = member.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1").select("region")
        member = written(late_join(member, several, "region"), "members")
        rows = written(member.join(self._pivots(member), "region"), "regions")
        for round_ in range(ROUNDS):
            pairs = rows.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
            found = self.distances(pairs)
            self._add_links(found)
            # Documents with the same label are in one component; that is enough to see that a region is done.
            labels = self.links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
            far = (rows.filter("node <> pivot").join(found.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "link", "twice"),
                                                     ["pivot", "node"]))
            parts = far.select("node", "doc_id", "n", F.explode(F.when(F.col("link"), F.array(F.lit(0))).when(F.col("twice"), F.array(
                F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("part"), "region")
            parts = parts.select("node", "doc_id", "n", F.xxhash64("region", "part", F.lit(round_)).alias("region"))
            left = written(self._labelled(parts, labels), "parts")
            largest = left.agg(F.max("size")).first()[0]
            if not largest:
                return components(self.links)
            if largest <= SMALL or round_ == ROUNDS - 1:
                break
            member = left.select("region", "node", "doc_id", "n")
            rows = written(member.join(self._pivots(member), "region"), "regions")
        self._add_links(self.distances(self._blocks(left)))
        return components(self.links)

    def _blocks(self, left: DataFrame) -> DataFrame:
        """Pairs that may link in the regions that are left, compared cell by cell: two blocks of bounded size each."""
        dealt = left.join(self.nodes.select("node", "cells"), "node").withColumn(
            "blocks", F.ceil(F.col("size") / BLOCK)).withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
        listed = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("region")), 1, LISTED).alias("regions"))
        dealt = dealt.join(listed, "node")
        cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cells = cells.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        cells = cells.select("region", "i", "j", "node", "n", "label", "side", "cells", "regions")
        dealt = cells.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "n", "node")
        return dealt.mapInArrow(_in_blocks(self.percent), "a long, b long").distinct()


def similar_documents(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text); other columns are ignored.

    A document's set is its distinct shingles of ``width`` words, A-Z as a-z; fewer words are one shingle, no words are
    none. Documents link when 100 * common >= percent * union; component_id is the smallest doc_id that links lead to.
    Texts that are null or have no words link with nothing and are their own component. Repeated rows and ids are rows
    of their own; rows with a null id join the component of an equal set that has an id, and else have none.
    ``percent`` lies above 50. Sets are told apart by 64-bit hashes; equal hashes of different sets are not expected.
    """
    return _similar(documents, width, percent).drop("text_id")


def _similar(documents: DataFrame, width: int, percent: int) -> DataFrame:
    join = _Join(documents, width, percent)
    labels = join.run()
    named = join.nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "label").select(F.col("node").alias("f1"), "component_id")
    own = join.sets.select("doc_id", "n", "f1", "text_id")
    with_words = own.filter("n > 0").join(of_node, "f1", "left")
    without = own.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return with_words.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_id").union(
        without.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_id"))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents``, with all their columns, with one document of each group of linked ones: the smallest doc_id.

    Rows that repeat both id and text are one document; of different texts under one id each goes or stays by itself. A
    row without an id goes if its text is that of a document with one, and else stays. Documents without words stay.
    """
    labels = written(_similar(documents, width, percent), "components")
    removed = labels.filter("component_id IS NOT NULL AND doc_id <> component_id").select(
        F.col("doc_id").alias("removed_id"), F.col("text_id").alias("removed_text")).distinct()
    removed = F.broadcast(removed) if removed.count() <= SENT_IDS else removed
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    kept = rows.join(removed, (F.col("row.doc_id") == F.col("removed_id"))
                     & (F.xxhash64(F.col("row.text").cast("string")) == F.col("removed_text")), "left_anti")
    if not labels.filter("doc_id IS NULL AND component_id IS NOT NULL").isEmpty():
        # Of the rows without an id, those equal to a document with one: few, and found by their text.
        named = kept.filter("row.doc_id IS NOT NULL").select(F.xxhash64("row.text").alias("named_text")).distinct()
        kept = kept.filter("row.doc_id IS NOT NULL").union(
            kept.filter("row.doc_id IS NULL").join(named, F.xxhash64("row.text") == F.col("named_text"), "left_anti"))
    repeated = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("repeated_id"))
    if not repeated.isEmpty():
        again = F.col("row.doc_id") == F.col("repeated_id")
        once_ = kept.join(repeated, again, "left_semi").groupBy("row.doc_id", "row.text").agg(F.first("row").alias("row")).select("row")
        kept = kept.join(repeated, again, "left_anti").union(once_)
    return kept.select("row.*")
