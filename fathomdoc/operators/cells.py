"""Approximate nearest neighbours by cells: a coarse quantiser, vectors stored by cell, queries sent to near cells.

Centroids are trained on a bounded sample; every vector is stored under its nearest one. A query meets only the vectors
of its nearest cells, by an equi-join on the cell, and takes further cells until these hold k vectors, so it always
gets k if there are as many. How many cells a query meets is measured when the index is built: as few as give the
asked recall on the sample. Vectors in clusters need few; vectors without any structure need most of them.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomdoc.operators.search import (
    CELL_ROWS, PIVOTS, _Nearest, far_apart, hit_schema, ids_of, matrix, rows_of_cells, sum_of_squares)
from fathomdoc.operators.skew import top_per_group
from fathomdoc.session import cut_lineage, work_folder

# Vectors that centroids are trained on: so many for each cell, and bytes of them in all.
PER_CELL, SAMPLE_BYTES = 32, 64 * 1024 * 1024
# Cells at most; their centroids go to all executors.
MOST_CELLS = 8192
ROUNDS, ASKED = 12, 400
# Distances from queries to cells that are held at once.
PROBED = 1 << 19


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` nearest centroids of each vector, nearest first; the lower number of equals."""
    out = np.empty((len(vectors), count), np.int64)
    own = sum_of_squares(centroids)
    for at in range(0, len(vectors), 4096):
        far = own - 2.0 * (vectors[at:at + 4096] @ centroids.T)
        out[at:at + 4096] = far.argmin(1)[:, None] if count == 1 else np.argsort(far, axis=1, kind="stable")[:, :count]
    return out


def train_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds over a sample in an order of its own; a cell that empties starts anew at a far vector."""
    sample = sample[np.lexsort(sample.T[::-1])]
    centroids = sample[np.random.default_rng(17).permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        cell = nearest_cells(sample, centroids)[:, 0]
        size = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        held = size > 0
        centroids[held] = sums[held] / size[held, None]
        if not held.all():
            far = np.argsort(-sum_of_squares(sample - centroids[cell]), kind="stable")
            centroids[~held] = sample[far[:np.count_nonzero(~held)]]
    return centroids


def least_probes(sample: np.ndarray, asked: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest near cells that hold at least ``recall`` of the k nearest of the ``asked`` rows among the sample, by
    two standard errors. Centroids that were not trained on these rows are not nearer to them than to others.

    The neighbours of a vector are nearer in the whole corpus than in a sample, so this errs on the side of recall.
    """
    cell, found = nearest_cells(sample, centroids)[:, 0], np.zeros((len(asked), len(centroids)))
    place = np.empty(len(centroids), np.int64)
    for row, q in enumerate(asked):
        far = sum_of_squares(sample - sample[q])
        far[q] = np.inf
        near = np.argpartition(far, min(k, len(far) - 1) - 1)[:k] if len(far) > 1 else np.array([q])
        place[nearest_cells(sample[q:q + 1], centroids, len(centroids))[0]] = np.arange(len(centroids))
        np.add.at(found[row], place[cell[near]], 1 / len(near))
    share = np.cumsum(found, axis=1)
    sure = share.mean(axis=0) - 2 * share.std(axis=0) / np.sqrt(len(asked))
    return min(len(centroids), int(np.argmax(np.append(sure >= recall, True))) + 1)


@dataclass(frozen=True)
class CellIndex:
    """Rows with their ``_cell``, as stored, and what a search needs to know about the cells."""

    rows: DataFrame
    corpus_id: str
    vector: str
    centroids: np.ndarray
    probes: int


def _assign(centroids, field: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(batch.schema.get_field_index(field))))
            if batch.num_rows:
                vectors = matrix(batch.column(batch.schema.get_field_index(field)))
                yield batch.append_column("_cell", pa.array(nearest_cells(vectors, centroids.value)[:, 0], pa.int64()))

    return assign


def build_cell_index(corpus: DataFrame, path: str | None = None, *, corpus_id: str = "chunk_id", vector: str = "embedding",
                     cells: int | None = None, recall: float = 0.95, k: int = 10) -> CellIndex:
    """Stores all rows of the corpus that have a vector by cell, below ``path`` or a work folder.

    ``cells`` is the root of the number of rows unless given, at most ``MOST_CELLS``. Centroids are trained on about
    ``PER_CELL`` rows for each cell, at most ``SAMPLE_BYTES``, drawn by a hash of the id; on these it is also measured
    how many cells give ``recall`` of the ``k`` nearest. All columns are kept, so that a search can filter on them.
    """
    spark = corpus.sparkSession
    n, width = corpus.filter(F.col(vector).isNotNull()).agg(F.count("*"), F.max(F.size(vector))).first()
    if not n:
        empty = corpus.withColumn("_cell", F.lit(0).cast("long")).limit(0)
        return CellIndex(empty, corpus_id, vector, np.zeros((1, 1)), 1)
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    most = int(max(1, min(cells * PER_CELL, SAMPLE_BYTES // (8 * max(1, width)))))
    drawn = corpus.filter(F.col(vector).isNotNull())
    if n > most:
        drawn = drawn.filter(F.pmod(F.xxhash64(corpus_id, F.lit(41)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    sample = matrix(drawn.select(vector).limit(2 * most).toArrow().column(0).combine_chunks())
    if not len(sample):
        sample = matrix(corpus.filter(F.col(vector).isNotNull()).select(vector).limit(1).toArrow().column(0).combine_chunks())
    order = np.random.default_rng(23).permutation(len(sample))
    asked, learned = np.split(order, [min(ASKED, len(sample) // 5)])
    centroids = train_centroids(sample[learned], min(cells, len(learned)))
    path = path or work_folder(spark, "cells")
    schema = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.LongType())])
    placed = corpus.mapInArrow(_assign(spark.sparkContext.broadcast(centroids), vector), schema)
    # By ranges of (cell, hash), so that a large cell falls into several files and a reader skips other cells.
    ordered = placed.withColumn("_order", F.xxhash64(corpus_id)).repartitionByRange("_cell", "_order").sortWithinPartitions("_cell").drop("_order")
    ordered.write.mode("overwrite").parquet(path)
    return CellIndex(spark.read.schema(schema).parquet(path), corpus_id, vector, centroids,
                     least_probes(sample, asked, centroids, k, recall) if len(asked) else len(centroids))


def _parts_of_cells(centroids: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit of each cell, and of each unit the number of parts it is cut into, of about ``rows`` rows: small cells that
    lie near the same pivot share a unit, a larger cell is one by itself."""
    pivots = far_apart(centroids, PIVOTS)
    far = sum_of_squares(centroids)[:, None] + sum_of_squares(pivots) - 2.0 * (centroids @ pivots.T)
    unit, parts, held = np.zeros(len(sizes), np.int64), [], 0
    for cell in np.lexsort((far.min(axis=1), far.argmin(axis=1))):
        if not parts or held + sizes[cell] > rows:
            parts.append(-(-int(sizes[cell]) // rows))
            held = 0
        unit[cell] = len(parts) - 1
        held += sizes[cell]
    return unit, np.array(parts, np.int64)


def _probe(cells, probes: int, k: int, names: list[str]):
    """Queries with the parts they meet and how far their farthest cell is: a query meets the nearest cells that hold
    rows, ``probes`` of them and as many as give k rows, and all parts of the units of these."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes, unit, parts = cells.value
        if not len(sizes):
            return
        own, by_unit = sum_of_squares(centroids), np.argsort(unit, kind="stable")
        marks, first = np.searchsorted(unit[by_unit], np.arange(len(parts))), np.cumsum(parts) - parts
        step = max(1, PROBED // len(sizes))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                far = own - 2.0 * (matrix(some.column(1)) @ centroids.T)
                order = np.argsort(far, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                last = ((np.arange(len(sizes)) < probes) | (before < k)).sum(axis=1) - 1
                row = np.arange(len(far))
                reach = far[row, order[row, last]]
                # A distance may come out a little different where the cell is met.
                reach += 1e-9 * (1.0 + np.abs(reach))
                met = np.maximum.reduceat((far <= reach[:, None])[:, by_unit], marks, axis=1)
                row, which = np.nonzero(met)
                count = parts[which]
                part = np.repeat(first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, count, len(far)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(reach), pa.ListArray.from_arrays(pa.array(ends), pa.array(part))], names)

    return probe


def _join_parts(left: DataFrame, right: DataFrame, cells, numbers: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
    """The k nearest per query in each part, among the rows of the cells that the query meets."""
    arrow_schema = to_arrow_schema(schema)

    def nearest_in(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return arrow_schema.empty_table()
        centroids = cells.value[0]
        nearest = _Nearest(ids_of(queries["_q_id"]), matrix(queries["_q_vector"].combine_chunks()), k, None)
        reach, cell = queries["_reach"].to_numpy(), np.searchsorted(numbers, corpus["_cell"].to_numpy())
        ids, vectors = ids_of(corpus["_c_id"]), matrix(corpus["_c_vector"].combine_chunks())
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            centroid = centroids[cell[rows[0]]]
            among = np.flatnonzero(centroid @ centroid - 2.0 * (nearest.vectors @ centroid) <= reach)
            if len(among):
                nearest.add(ids[rows], vectors[rows], among)
        return pa.Table.from_batches([nearest.rows(arrow_schema.names, arrow_schema)])

    keys = ["_part", "_col"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest_in, schema)


def search_cells(queries: DataFrame, index: CellIndex, k: int, *, query_id: str = "query_id", vector: str = "embedding",
                 where: Column | None = None, probes: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """About the k nearest rows of an index for every query by squared L2: query_id, the index's id, distance, rank.

    Distances are exact and ties go to the smaller id; only rows of cells that a query does not meet can be missing.
    ``where`` filters rows before the search, and the cells that a query meets are counted among what is left, so
    every query gets k rows if so many are left. ``probes`` replaces the measured number of cells; with all of them
    the result is exact.

    Rows are sent by parts: several small cells, or a slice of a large one, of as many rows as ``rows_of_cells`` says for
    ``cell_rows``. A query is sent once to each part that has a cell it meets, not to each cell, and gets k rows there; the
    queries of a part are cut into slices of as many rows.
    """
    spark = queries.sparkSession
    rows = index.rows.filter(where) if where is not None else index.rows
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("n")).orderBy("_cell").toArrow()
    numbers, counts = sizes.column("_cell").to_numpy(), sizes.column("n").to_numpy()
    centroids, probes = index.centroids[numbers], probes or index.probes
    met = int(queries.count() * counts.sum() * min(1.0, probes / max(1, len(numbers))))
    cell_rows = rows_of_cells(spark, met, centroids.shape[1], cell_rows)
    unit, parts = _parts_of_cells(centroids, counts, cell_rows) if len(numbers) else (numbers, counts)
    known = spark.sparkContext.broadcast((centroids, counts, unit, parts))
    asked = queries.select(F.col(query_id).alias("_q_id"), F.col(vector).alias("_q_vector"))
    schema = T.StructType([*asked.schema.fields, T.StructField("_reach", T.DoubleType()), T.StructField("_parts", T.ArrayType(T.LongType()))])
    # Fixed once: the queries of each part are counted and joined.
    probed = cut_lineage(asked.mapInArrow(_probe(known, probes, k, schema.names), schema))
    left = probed.select("_q_id", "_q_vector", "_reach", F.explode("_parts").alias("_part"))
    across = F.broadcast(left.groupBy("_part").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_across")))
    first = np.cumsum(parts) - parts
    places = F.broadcast(spark.createDataFrame(
        [(int(c), int(first[u]), int(parts[u])) for c, u in zip(numbers, unit)], "_cell long, _first long, _n long"))
    right = (
        rows.select("_cell", F.col(index.corpus_id).alias("_c_id"), F.col(index.vector).alias("_c_vector"))
        .join(places, "_cell").withColumn("_part", F.col("_first") + F.pmod(F.xxhash64("_c_id"), F.col("_n"))).drop("_first", "_n")
        .join(across, "_part").withColumn("_col", F.explode(F.sequence(F.lit(0), F.col("_across") - 1))).drop("_across"))
    left = left.join(across, "_part").withColumn("_col", F.pmod(F.xxhash64("_q_id"), F.col("_across")).cast("int")).drop("_across")
    out = hit_schema(queries, query_id, index.rows, index.corpus_id)
    found = _join_parts(left, right, known, numbers, k, out)
    return top_per_group(found, [out.names[0]], [F.col("distance"), F.col(out.names[1])], k, "rank", F.col(out.names[1]))
