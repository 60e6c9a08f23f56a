"""Nearest-neighbour joins: exact and approximate, for a small or a large query side."""

from collections.abc import Iterator
from functools import reduce
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomdoc.functions.scoring import similarity_percent
from fathomdoc.operators.skew import top_per_group
from fathomdoc.session import cut_lineage

# Distances are rounded so that equal vectors tie, whatever the batch they were computed in.
DECIMALS = 9
# Query side up to this many bytes of vectors is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of either side in one cell of the grid join, unless larger cells already keep all cores busy.
CELL_ROWS = 16384
# Bytes of vectors, as doubles, of either side in one cell at most, and cells for each core where cells grow.
CELL_BYTES, CELLS_PER_CORE = 32 * 1024 * 1024, 4
TILE = 1024
# Rows of the corpus that a scan turns into doubles at once.
SCAN_ROWS = 4 * TILE
# Queries whose distances bound those of others.
PIVOTS = 16
# With more partitions than these, a sample of so many rows in a thousand first bounds what each of them sends.
FEW_PARTITIONS, SAMPLED = 200, 10
# Bytes of vectors of pairs whose distance is computed at once.
EXACT_BYTES = 16 * 1024 * 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-length float lists as a 2-d array of doubles."""
    lengths = pc.unique(pc.list_value_length(column).drop_null())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different length: {sorted(lengths.to_pylist())[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else 0)


def sign_codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One code per row and table; bit b of table t says which of two coordinates is larger.

    The pairs follow from t and b alone, so every task and every run makes the same codes.
    """
    dimensions = vectors.shape[1]
    codes = np.zeros((len(vectors), tables), dtype=np.int64)
    for t in range(tables):
        for b in range(bits):
            i, j = code_pair(t, b, bits, dimensions)
            codes[:, t] |= (vectors[:, i] > vectors[:, j]).astype(np.int64) << b
    return codes


def code_pair(table: int, bit: int, bits: int, dimensions):
    """The two coordinates to compare; ``dimensions`` may be a column."""
    i = 2 * (table * bits + bit)
    lap = F.floor(F.lit(i) / dimensions) if isinstance(dimensions, Column) else i // dimensions
    i = F.lit(i) if isinstance(dimensions, Column) else i
    return i % dimensions, (i + 1 + lap) % dimensions


def sum_of_squares(vectors: np.ndarray) -> np.ndarray:
    return (vectors * vectors).sum(axis=1)


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Some of the vectors, each as far as can be from those before."""
    chosen = vectors[:1]
    nearest = np.full(len(vectors), np.inf)
    while len(chosen) < min(count, len(vectors)):
        nearest = np.minimum(nearest, sum_of_squares(vectors - chosen[-1]))
        chosen = np.concatenate([chosen, vectors[nearest.argmax()][None]])
    return chosen


class _Nearest:
    """Running k nearest of a block of queries; feed it corpus batches, then read ``rows``.

    ``bounds`` are distances that the k nearest of each query are known not to exceed. A tile of rows is compared only
    with the queries that it may hold a near row for: by the triangle inequality a row is no nearer to a query than
    their distances to any pivot differ.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, lsh: tuple[int, int] | None,
                 bounds: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.lsh = ids, vectors, k, lsh
        self.norms = sum_of_squares(vectors)
        self.codes = sign_codes(vectors, *lsh) if lsh else None
        self.distance = np.full((len(ids), k), np.inf)
        self.bounds = np.full(len(ids), np.inf) if bounds is None else bounds
        self.found, self.compared = None, 0
        self.pivots = far_apart(vectors, PIVOTS)
        self.to_pivots = self._pivot_distances(vectors)

    def _pivot_distances(self, vectors: np.ndarray) -> np.ndarray:
        rough = sum_of_squares(vectors)[:, None] + sum_of_squares(self.pivots) - 2.0 * (vectors @ self.pivots.T)
        return np.sqrt(np.maximum(rough, 0.0))

    def _limit(self, asked: np.ndarray) -> np.ndarray:
        return np.minimum(self.distance[asked, -1], self.bounds[asked]) + 1e-7 * (1.0 + self.norms[asked])

    def _candidates(self, asked: np.ndarray, corpus: np.ndarray, norms: np.ndarray, codes) -> tuple:
        """Positions (query, corpus row) that can still be among the k nearest."""
        rough = self.vectors[asked] @ corpus.T
        rough *= -2.0
        rough += self.norms[asked, None]
        rough += norms
        self.compared += rough.size
        if codes is not None:
            shared = np.zeros(rough.shape, dtype=bool)
            for t in range(codes.shape[1]):
                shared |= self.codes[asked, t, None] == codes[None, :, t]
            rough[~shared] = np.inf
        limit = self._limit(asked)
        near = rough <= limit[:, None]
        # Only where many rows are within the limit are the k nearest of them sought.
        many = np.flatnonzero(near.sum(axis=1) > 4 * self.k)
        if len(many):
            kth = np.partition(rough[many], self.k - 1, axis=1)[:, self.k - 1] + 1e-7 * (1.0 + self.norms[asked[many]])
            near[many] = rough[many] <= np.minimum(limit[many], kth)[:, None]
        q, c = np.nonzero(near)
        known = np.isfinite(rough[q, c])
        return asked[q[known]], c[known]

    def _merge(self, q: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(q)
        known = np.isfinite(self.distance[hit])
        q = np.concatenate([q, np.repeat(hit, known.sum(axis=1))])
        distance = np.concatenate([distance, self.distance[hit][known]])
        ids = np.concatenate([ids, self.found[hit][known]])
        order = np.lexsort((ids.astype("U") if ids.dtype == object else ids, distance, q))
        q, distance, ids = q[order], distance[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.distance[q[top], rank[top]] = distance[top]
        self.found[q[top], rank[top]] = ids[top]

    def add(self, ids: np.ndarray, corpus: np.ndarray, among: np.ndarray | None = None) -> None:
        """Compares rows of the corpus with all queries, or with those at the positions ``among``."""
        if self.found is None:
            self.found = np.zeros((len(self.ids), self.k), dtype=ids.dtype)
        if corpus.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"vectors of different length: {self.vectors.shape[1]} and {corpus.shape[1]}")
        # Rows near the same pivot lie together, so that a tile's distances to the pivots span little.
        to_pivots = self._pivot_distances(corpus)
        order = np.lexsort((to_pivots.min(axis=1), to_pivots.argmin(axis=1)))
        ids, corpus, to_pivots = ids[order], corpus[order], to_pivots[order]
        norms = sum_of_squares(corpus)
        codes = sign_codes(corpus, *self.lsh) if self.lsh else None
        among = np.arange(len(self.ids)) if among is None else among
        at_once = max(1, EXACT_BYTES // (8 * max(1, corpus.shape[1])))
        for start in range(0, len(ids), TILE):
            part = slice(start, start + TILE)
            low, high = to_pivots[part].min(axis=0), to_pivots[part].max(axis=0)
            for lo in range(0, len(among), TILE):
                some = among[lo:lo + TILE]
                own = self.to_pivots[some]
                apart = np.maximum(np.maximum(own - high, low - own).max(axis=1) - 1e-6, 0.0)
                asked = some[apart * apart <= self._limit(some)]
                if not len(asked):
                    continue
                q, c = self._candidates(asked, corpus[part], norms[part], codes[part] if codes is not None else None)
                for at in range(0, len(q), at_once):
                    pairs = slice(at, at + at_once)
                    exact = np.round(sum_of_squares(self.vectors[q[pairs]] - corpus[part][c[pairs]]), DECIMALS)
                    near = exact <= self.bounds[q[pairs]]
                    self._merge(q[pairs][near], exact[near], ids[part][c[pairs]][near])

    def rows(self, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        if self.found is None:
            return pa.RecordBatch.from_pylist([], schema)
        known = np.isfinite(self.distance)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.ids, known.sum(axis=1)), schema.field(0).type),
            pa.array(self.found[known], schema.field(1).type),
            pa.array(self.distance[known], schema.field(2).type)], schema=schema)


def _with_vector(rows):
    return rows.filter(pc.is_valid(rows.column(1)))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _scan_join(queries: pa.Table, corpus: DataFrame, k: int, schema: T.StructType, lsh,
               bounds: np.ndarray | None = None) -> DataFrame:
    """Query vectors travel with the task; every corpus partition gives those of its k nearest per query that lie
    within the query's bound."""
    queries = _with_vector(queries)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (ids_of(queries.column(0)), matrix(queries.column(1).combine_chunks()), bounds))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, limits = shared.value
        nearest = _Nearest(ids, vectors, k, lsh, limits)
        for whole in batches:
            for first in range(0, whole.num_rows, SCAN_ROWS):
                batch = _with_vector(whole.slice(first, SCAN_ROWS))
                if batch.num_rows and len(nearest.ids):
                    nearest.add(ids_of(batch.column(0)), matrix(batch.column(1)))
        yield nearest.rows(arrow_schema.names, arrow_schema)

    return corpus.mapInArrow(scan, schema)


def upper_bounds(queries: pa.Table, corpus: DataFrame, k: int, schema: T.StructType, level: int = 0) -> np.ndarray | None:
    """For each query with a vector, the distance of its k-th nearest in a sample of the corpus: no nearer row of the
    whole corpus is farther. With them partitions send about k * 1000 / SAMPLED rows per query between them, however
    many they are. A sample that has many partitions itself is bounded by a sample of its own, until it is small.
    """
    sample = cut_lineage(corpus.filter(F.pmod(F.xxhash64(corpus.columns[0], F.lit(level)), F.lit(1000)) < SAMPLED))
    n = sample.count()
    if n < k:
        return None
    within = upper_bounds(queries, sample, k, schema, level + 1) if n > 1000 * FEW_PARTITIONS else None
    name, other = schema.names[:2]
    hits = top_per_group(_scan_join(queries, sample, k, schema, None, within), [name], [F.col("distance"), F.col(other)], k, "rank", F.col(other))
    found = hits.filter(F.col("rank") == k).select(name, "distance").toArrow()
    known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    return np.array([known.get(i, np.inf) for i in _with_vector(queries).column(0).to_pylist()])


def _sides(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.toDF("_q_id", "_q_vector"), corpus.toDF("_c_id", "_c_vector")


def rows_of_cells(spark: SparkSession, pairs: int, width: int | None, cell_rows: int) -> int:
    """Rows of either side in one cell: ``cell_rows``, or as many more as leave ``CELLS_PER_CORE`` cells for each core,
    and at most ``CELL_BYTES`` of vectors of ``width`` numbers.

    Every row is sent once for each slice of the other side, so cells of a fixed size would send rows that grow with
    the square of the tables. With a number of cells that depends on the cores alone, what is sent grows with the
    tables, until vectors of more than ``CELL_BYTES`` would have to be in one cell.
    """
    share = math.isqrt(pairs // (CELLS_PER_CORE * spark.sparkContext.defaultParallelism)) + 1
    return max(1, min(max(cell_rows, share), CELL_BYTES // (8 * max(1, width or 1))))


def sliced(df: DataFrame, row_id: str, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
    """Rows of one side dealt to ``own_n`` slices by a hash of the id, repeated for every slice of the other side."""
    return (
        df.withColumn(own, F.pmod(F.xxhash64(row_id), own_n).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), (other_n - 1).cast("int"))))
    )


def join_cells(left: DataFrame, right: DataFrame, cell: list[str], k: int, schema: T.StructType, lsh) -> DataFrame:
    """The k nearest per query of every cell; a cell holds one slice of each side."""
    arrow_schema = to_arrow_schema(schema)

    def nearest_in(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        queries, corpus = (
            side.filter(pc.is_valid(side[name])) for side, name in ((queries, "_q_vector"), (corpus, "_c_vector")))
        if not queries.num_rows or not corpus.num_rows:
            return arrow_schema.empty_table()
        nearest = _Nearest(ids_of(queries["_q_id"]), matrix(queries["_q_vector"].combine_chunks()), k, lsh)
        nearest.add(ids_of(corpus["_c_id"]), matrix(corpus["_c_vector"].combine_chunks()))
        return pa.Table.from_batches([nearest.rows(arrow_schema.names, arrow_schema)])

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(nearest_in, schema)


def _grid_join(queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType, cell_rows: int, width: int | None) -> DataFrame:
    """Exact: every slice of the queries meets every slice of the corpus, of as many rows as ``rows_of_cells`` says."""
    asked, held = queries.count(), corpus.count()
    cell_rows = rows_of_cells(queries.sparkSession, asked * held, width, cell_rows)
    across, down = F.lit(max(1, -(-asked // cell_rows))), F.lit(max(1, -(-held // cell_rows)))
    left, right = _sides(queries, corpus)
    return join_cells(sliced(left, "_q_id", "_col", across, "_row", down),
                       sliced(right, "_c_id", "_row", down, "_col", across), ["_col", "_row"], k, schema, None)


def _code(vector: str, table: int, bits: int) -> Column:
    """``sign_codes`` as a column expression."""
    def larger(bit):
        i, j = code_pair(table, bit, bits, F.size(vector))
        greater = F.get(vector, i.cast("int")) > F.get(vector, j.cast("int"))
        return F.when(greater, 1 << bit).otherwise(0)

    return reduce(lambda a, b: a + b, [larger(b) for b in range(bits)], F.lit(0))


def _bucket_join(queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType, lsh: tuple[int, int],
                 cell_rows: int, width: int | None) -> DataFrame:
    """Approximate: only rows with the same code in a table meet. Large buckets are cut into cells by their size, of as
    many rows as ``rows_of_cells`` says for all buckets.

    There are at most tables * 2^bits buckets, so their sizes are broadcast.
    """
    tables, bits = lsh
    bucket = ["_table", "_code"]

    def coded(side: DataFrame, vector: str) -> DataFrame:
        codes = F.array(*[
            F.struct(F.lit(t).alias("_table"), _code(vector, t, bits).alias("_code")) for t in range(tables)])
        return side.select("*", F.inline(codes))

    left, right = (coded(side, v) for side, v in zip(_sides(queries, corpus), ("_q_vector", "_c_vector")))

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*bucket).agg(F.count("*").alias(name))

    counts = cut_lineage(counted(left, "_asked").join(counted(right, "_held"), bucket))
    pairs = counts.agg(F.sum(F.col("_asked").cast("decimal(38)") * F.col("_held"))).first()[0]
    cell_rows = rows_of_cells(queries.sparkSession, int(pairs or 0), width, cell_rows)
    sizes = F.broadcast(counts.select(
        *bucket, F.ceil(F.col("_asked") / cell_rows).cast("int").alias("_across"), F.ceil(F.col("_held") / cell_rows).cast("int").alias("_down")))
    across, down = F.col("_across"), F.col("_down")
    cells = join_cells(
        sliced(left.join(sizes, bucket), "_q_id", "_col", across, "_row", down).drop("_across", "_down"),
        sliced(right.join(sizes, bucket), "_c_id", "_row", down, "_col", across).drop("_across", "_down"),
        [*bucket, "_col", "_row"], k, schema, None)
    # A pair may meet in several tables.
    return cells.groupBy(*schema.names[:2]).agg(F.min("distance").alias("distance"))


def hit_schema(queries: DataFrame, query_id: str, corpus: DataFrame, corpus_id: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(corpus_id if corpus_id != query_id else f"neighbour_{corpus_id}", corpus.schema[corpus_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
             corpus_id: str = "chunk_id", vector: str = "embedding", where: Column | None = None,
             lsh: tuple[int, int] | None = None, broadcast_bytes: int = BROADCAST_BYTES,
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest corpus rows of every query by squared L2: query_id, chunk_id, distance, rank (1-based).

    ``where`` filters the corpus before the search. ``lsh=(tables, bits)`` only compares vectors that share a
    code in some table (approximate). Ties go to the smaller corpus id. Vectors are finite and of one length.

    Query vectors that, with k results each, are counted to be within ``broadcast_bytes`` are sent to the scan of the corpus, which is then not shuffled;
    of many partitions each sends only rows within a bound that a sample gave first;
    more queries are joined in bounded cells (``rows_of_cells``): all slices with all slices, or with ``lsh`` bucket by bucket. Both
    ways give the same rows; they are exact without ``lsh``. Rows without a vector
    are skipped in the tasks: a filter on a vector made by a UDF would be pushed down and make it twice.
    """
    corpus = corpus.filter(where) if where is not None else corpus
    queries = queries.select(query_id, vector)
    corpus = corpus.select(corpus_id, vector)
    schema = hit_schema(queries, query_id, corpus, corpus_id)
    names = schema.names
    # Fixed once, so that an embedding function runs once, and measured before anything is fetched.
    queries = cut_lineage(queries)
    n, numbers, width = queries.agg(F.count("*"), F.coalesce(F.sum(F.size(vector)), F.lit(0)), F.max(F.size(vector))).first()
    small = queries.toArrow() if 8 * numbers + n * (16 + 16 * k) <= broadcast_bytes else None
    if small is None:
        partial = (_bucket_join(queries, corpus, k, schema, lsh, cell_rows, width) if lsh
                   else _grid_join(queries, corpus, k, schema, cell_rows, width))
    else:
        many = lsh is None and corpus.rdd.getNumPartitions() > FEW_PARTITIONS
        partial = _scan_join(small, corpus, k, schema, lsh, upper_bounds(small, corpus, k, schema) if many else None)
    return top_per_group(partial, [names[0]], [F.col("distance"), F.col(names[1])], k, "rank",
                         F.col(names[1]))


def similarity_search(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """``knn_join`` with the similarity percentage of each hit."""
    hits = knn_join(queries, corpus, k, **options)
    return hits.withColumn("similarity", similarity_percent(F.col("distance"), F.col("rank") - 1))
