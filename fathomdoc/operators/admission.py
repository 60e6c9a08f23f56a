"""Sliding-window admission over a whole table: at most N admitted requests per key in any window.

Only admitted requests count, so a decision depends on earlier decisions. The work that truly is a chain is kept
small:

1. Requests are range-sorted by (key, time, id), so a hot key spreads over many tasks, and packed into blocks.
2. A request with fewer than N requests of any kind in its window is admitted for certain. Where all requests of
   the last window are certain, the limiter's memory is known: a block is cut there and starts a new chain.
3. Chains run in parallel. Inside a chain only packed times pass from block to block, with N times of memory;
   runs of certain requests and of refused requests are skipped whole. A key that never falls below its limit is
   one chain: that order is what the rule means.
4. Decisions come back per block and are spread over the rows in parallel.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomdoc.functions.scoring import retry_after
from fathomdoc.functions.time import epoch_micros
from fathomdoc.session import cut_lineage

MIN_BLOCK = 1024
MAX_BLOCK = 8192
# Requests of one key that are packed at once.
PART = 1 << 20
# Requests, in blocks of any number of keys, that leave a task at once.
SENT = 1 << 17


class Rule:
    """N per window; ``inclusive`` still counts a request exactly one window old."""

    def __init__(self, limit: int, window_us: int, inclusive: bool):
        self.limit, self.window, self.inclusive = limit, window_us, inclusive

    def expired(self, then, now):
        return now - then > self.window if self.inclusive else now - then >= self.window

    def certain(self, times: np.ndarray) -> np.ndarray:
        """Requests with fewer than N before them in their window, whatever was decided. The first N are open."""
        known = np.zeros(len(times), dtype=bool)
        if len(times) > self.limit:
            known[self.limit:] = self.expired(times[:-self.limit], times[self.limit:])
        return known

    def first_free(self, times: np.ndarray, oldest: int) -> int:
        """Position of the first time at which ``oldest`` has expired."""
        return int(np.searchsorted(times, oldest + self.window, side="right" if self.inclusive else "left"))


def cuts(times: np.ndarray, rule: Rule, starts_key: bool) -> list[tuple[int, int, bool]]:
    """Blocks (start, stop, fresh) of one key's sorted times; fresh blocks need no memory from the block before.

    What a fresh block has to remember is among the N requests before it. Unless the times start the key, the
    first N are open, so no block is fresh while earlier requests, not seen here, may still count.
    """
    known = rule.certain(times)
    if starts_key:
        known[:rule.limit] = True
    n = len(times)
    last_open = np.maximum.accumulate(np.where(known, -1, np.arange(n)))
    before = np.where(last_open < 0, np.iinfo(np.int64).min // 2, times[np.maximum(last_open, 0)])
    free = np.zeros(n, dtype=bool)
    free[1:] = rule.expired(before[:-1], times[1:])
    blocks, start, fresh = [], 0, starts_key
    spots = np.flatnonzero(free)
    while start < n:
        at = np.searchsorted(spots, start + MIN_BLOCK)
        free_cut = int(spots[at]) if at < len(spots) else n
        stop = min(free_cut, start + MAX_BLOCK, n)
        blocks.append((start, stop, fresh))
        start, fresh = stop, stop == free_cut
    return blocks


def decide(times: np.ndarray, rule: Rule, memory: list[int]) -> tuple[list, list, list, list[int]]:
    """Refused runs of a block as starts, stops and the oldest admitted time then; and the memory after it."""
    known = rule.certain(times)
    open_spots = np.flatnonzero(~known)
    starts, stops, oldest = [], [], []
    i, n = 0, len(times)
    while i < n:
        if known[i]:
            at = np.searchsorted(open_spots, i)
            j = int(open_spots[at]) if at < len(open_spots) else n
            memory = (memory + times[max(i, j - rule.limit):j].tolist())[-rule.limit:]
            i = j
            continue
        now = int(times[i])
        memory = [m for m in memory if not rule.expired(m, now)]
        if len(memory) < rule.limit:
            memory.append(now)
            i += 1
            continue
        j = rule.first_free(times, memory[0])
        starts.append(i)
        stops.append(j)
        oldest.append(memory[0])
        i = j
    return starts, stops, oldest, memory


def _pack(rule: Rule, schema: pa.Schema):
    """Sorted rows (key, t, id) to blocks. Chains are numbered from 1 in each partition; the blocks before the first
    have 0 and go on with a chain of a partition before."""

    def blocks_of(key, times: list, ids: list, starts_key: bool, part: int, chain: int) -> list[dict]:
        t, i = np.concatenate(times), np.concatenate(ids)
        blocks = []
        for start, stop, fresh in cuts(t, rule, starts_key):
            chain += fresh
            blocks.append({
                "client": key, "first_t": int(t[start]), "first_id": i[start], "part": part, "chain": chain,
                "warm": t[max(0, start - rule.limit):start] if fresh else t[:0], "t": t[start:stop], "id": i[start:stop]})
        return blocks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chain = TaskContext.get().partitionId(), 0
        key, times, ids, size = None, [], [], 0
        ready, held = [], 0
        # The first key of a partition may have begun in the partition before.
        starts_key = part == 0
        for batch in batches:
            keys = batch.column(0)
            if not len(keys):
                continue
            t, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            changed = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(keys)]
            for start, stop in zip(edges, edges[1:]):
                here = keys[start].as_py()
                if times and (here != key or size >= PART):
                    ready += blocks_of(key, times, ids, starts_key, part, chain)
                    chain = ready[-1]["chain"]
                    held += size
                    starts_key = here != key
                    times, ids, size = [], [], 0
                key = here
                times.append(t[start:stop])
                ids.append(i[start:stop])
                size += stop - start
                if held >= SENT:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, held = [], 0
        if times:
            ready += blocks_of(key, times, ids, starts_key, part, chain)
        yield pa.RecordBatch.from_pylist(ready, schema)

    return pack


def _walk(rule: Rule, schema: pa.Schema):
    """Blocks in chain order to refused runs; the memory passes from block to block."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, memory = None, []
        for batch in batches:
            done = []
            heads = batch.select(["client", "chain", "first_id", "warm"]).to_pylist()
            for n, head in enumerate(heads):
                if (head["client"], head["chain"]) != chain:
                    chain, memory = (head["client"], head["chain"]), head["warm"]
                times = batch.column("t")[n].values.to_numpy(zero_copy_only=False)
                starts, stops, oldest, memory = decide(times, rule, memory)
                done.append({"first_id": head["first_id"], "starts": starts, "stops": stops, "oldest": oldest})
            yield pa.RecordBatch.from_pylist(done, schema)

    return walk


def _spread(schema: pa.Schema):
    """Blocks with their refused runs to one row per request."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                t, i, starts, stops, oldest = (
                    batch.column(c)[n].values for c in ("t", "id", "starts", "stops", "oldest"))
                run = np.zeros(len(t) + 1, dtype=np.int64)
                run[starts.to_numpy()] += 1
                run[stops.to_numpy()] -= 1
                refused = np.cumsum(run[:-1]) > 0
                lengths = stops.to_numpy() - starts.to_numpy()
                held = np.zeros(len(t), dtype=np.int64)
                held[refused] = np.repeat(oldest.to_numpy(), lengths)
                client = pa.repeat(batch.column("client")[n], len(t))
                yield pa.RecordBatch.from_arrays(
                    [client, i, t, pa.array(~refused), pa.array(held, mask=~refused)], schema=schema)

    return spread


def sliding_admission(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: int,
                      inclusive: bool = False) -> DataFrame:
    """client, event_id, at_us, admitted, retry_after (seconds, refused requests only).

    ``inclusive`` is the whole-service rule: it still counts a request exactly one window old, and cuts the
    fraction of retry_after off. Without it, the per-client rule: such a request is gone, and retry_after is one
    more. Requests at one instant are taken in order of ``event_id``, which is unique.
    """
    rule = Rule(limit, window_seconds * 1_000_000, inclusive)
    rows = events.select(F.col(key).alias("client"), epoch_micros(events, ts).alias("t"),
                         F.col(event_id).alias("id"))
    client_type, id_type = (rows.schema[c].dataType for c in ("client", "id"))

    def schema(*fields) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields])

    long_list, int_list = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    packed_schema = schema(
        ("client", client_type), ("first_t", T.LongType()), ("first_id", id_type), ("part", T.IntegerType()),
        ("chain", T.LongType()), ("warm", long_list), ("t", long_list), ("id", T.ArrayType(id_type)))
    done_schema = schema(("first_id", id_type), ("starts", int_list), ("stops", int_list), ("oldest", long_list))
    out_schema = schema(("client", client_type), (event_id, id_type), ("t", T.LongType()),
                        ("admitted", T.BooleanType()), ("oldest", T.LongType()))

    # Block edges follow from the range boundaries, and three plans read the blocks: fix them once.
    packed = cut_lineage(
        rows.orderBy("client", "t", "id").mapInArrow(_pack(rule, to_arrow_schema(packed_schema)), packed_schema))
    # A prefix sum in two steps: each partition numbered its own chains, and one row of each says which chain the next
    # partitions go on with. Only these rows, as many as partitions, pass through one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("chains") > 0, F.struct("part", F.col("chains").alias("chain")))
    carried = (
        packed.groupBy("part").agg(F.max("chain").alias("chains"))
        .select("part", F.last(last, ignorenulls=True).over(before).alias("carried"))
    )
    own = F.when(F.col("chain") > 0, F.struct("part", "chain")).otherwise(F.col("carried"))
    decided = (
        packed.select("client", "first_t", "first_id", "warm", "t", "part", "chain").join(F.broadcast(carried), "part")
        .select("client", F.to_json(own).alias("chain"), "first_t", "first_id", "warm", "t")
        .repartition("client", "chain")
        .sortWithinPartitions("client", "chain", "first_t", "first_id")
        .mapInArrow(_walk(rule, to_arrow_schema(done_schema)), done_schema)
    )
    spread = packed.join(decided, "first_id").mapInArrow(_spread(to_arrow_schema(out_schema)), out_schema)
    return spread.select(
        "client", event_id, F.col("t").alias("at_us"), "admitted",
        retry_after(F.col("oldest"), F.col("t"), window_seconds, not inclusive).alias("retry_after"))
