"""Streams: ingest of new files, per-client admission, recent history.

Each takes a checkpoint folder on shared storage. Late rows: with a watermark, rows older than it are dropped.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import text as X
from fathomdoc.functions.time import epoch_micros
from fathomdoc.operators.admission import Rule, decide
from fathomdoc.operators.chunking import recursive_chunks
from fathomdoc.operators.embedding import EmbedFn, embed, hashing_embedder
from fathomdoc.operators.skew import union_all
from fathomdoc.session import cut_lineage
from fathomdoc.sources.collection import append_collection, assign_ids
from fathomdoc.sources.files import Extractor, Opener, docx_text, plain_path, read_files
from fathomdoc.sources.json_docs import documents_by_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXTRACTORS = {".docx": docx_text}
FILES = "path string, modificationTime timestamp, length long, content binary"


def passages_of(files: DataFrame, fn: EmbedFn, batch_ms: int,
                extractors: dict[str, Extractor] = EXTRACTORS, opened: Opener | None = None) -> tuple[DataFrame, DataFrame]:
    """Binary files to passages with ids and embeddings, and the files that gave none or not all: (path, reason). With
    ``opened``, as ``list_files`` gives it, the files have no content yet.

    Files are read and extracted once, into a checkpoint that passages and rejects are both made of, so a file cannot
    end as both or as neither if an extractor answers differently when asked again.
    """
    read = cut_lineage(read_files(files, extractors, DEFAULTS.max_json_bytes, opened))
    path = F.col("path")
    known = {"source": path, "file_type": F.ltrim(F.col("ending"), F.lit(".")), "file_name": X.base_name(path)}
    texts = read.filter("ending = '.txt' AND body IS NOT NULL").select("path", F.col("body").alias("text"), *[c.alias(n) for n, c in known.items()])
    extracted = read.filter("text IS NOT NULL").select("path", "text", *[c.alias(n) for n, c in known.items()], "page", "extra")
    jsons, bad_json = documents_by_path(read.filter("ending = '.json' AND body IS NOT NULL").select("path", "length", "body"))
    documents = union_all([jsons, texts, extracted])
    rejects = read.filter("reason IS NOT NULL").select("path", "reason").unionByName(bad_json)
    # A file without any text, such as an empty one or a list of numbers, gives no passage.
    told = documents.filter(~X.is_blank(F.col("text"))).select("path").union(rejects.select("path"))
    silent = read.select("path").distinct().join(told, "path", "left_anti").withColumn("reason", F.lit("no text"))
    # Position of a passage: file, place in the file, number in the document.
    place = F.coalesce("chunk_index", "item_index", "page", F.lit(0)).cast("string")
    chunks = recursive_chunks(documents.drop("path"), "text").withColumn("doc_key", F.concat_ws("_", F.sha2("source", 256), place))
    return embed(assign_ids(chunks.drop("text"), batch_ms, ["doc_key", "chunk_no"]), "chunk_text", fn), rejects.unionByName(silent)


def read_rejects(spark: SparkSession, collection: str) -> DataFrame:
    """(path, reason) of the files that the ingest could not use."""
    return spark.read.parquet(f"{collection}-rejects").drop("load")


def ingest_stream(spark: SparkSession, folder: str, collection: str, checkpoint: str,
                  fn: EmbedFn = hashing_embedder, files_per_batch: int = 1000) -> StreamingQuery:
    """Adds new files below ``folder`` to the collection and stops when there are no more.

    Every file ends as passages of the collection or as a row of ``read_rejects``, or as both if only a part of it could
    be used. A batch that is run again replaces its
    own load of both.
    """
    found = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
        .withColumn("path", plain_path(F.col("path")))
        .filter(X.has_known_suffix(F.col("path")))
    )

    def add(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(F.unix_millis("modificationTime"))).head()[0]
        if newest is not None:
            passages, rejects = passages_of(batch, fn, newest)
            append_collection(passages, collection, load=f"batch-{number}")
            rejects.write.mode("overwrite").parquet(f"{collection}-rejects/load=batch-{number}")

    return (
        found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# Rows that leave a stateful task at once.
PIECE = 1 << 16


class _Admit(StatefulProcessor):
    """Per client: the times of admitted requests, at most N. With event time they go once they no longer count."""

    def __init__(self, rule: Rule, timed: bool):
        self.rule, self.timed = rule, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("admitted", T.StructType([T.StructField("times", T.ArrayType(T.LongType()))]))

    def _keep(self, memory: list[int]) -> None:
        """Remembers the times, until the last of them has expired."""
        self.memory.update((memory,))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((memory[-1] + self.rule.window) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Only times and ids are held while a client's rows of a batch are put in order.
        pieces = [(r["t"].to_numpy(), r["id"].to_numpy()) for r in rows]
        t, ids = (np.concatenate(c) for c in zip(*pieces))
        order = np.lexsort((ids.astype("U") if ids.dtype == object else ids, t))
        t, ids = t[order], ids[order]
        memory = [int(x) for x in self.memory.get()[0]] if self.memory.exists() else []
        starts, stops, oldest, memory = decide(t, self.rule, memory)
        self._keep(memory)
        held = pd.array([None] * len(t), dtype="Int64")
        for start, stop, then in zip(starts, stops, oldest):
            held[start:stop] = then
        for at in range(0, len(t), PIECE):
            part = slice(at, at + PIECE)
            yield pd.DataFrame({"client": [key[0]] * len(t[part]), "id": ids[part], "t": t[part],
                                "admitted": held[part].isna(), "oldest": held[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.memory.exists():
            now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
            memory = [int(x) for x in self.memory.get()[0] if not self.rule.expired(int(x), now)]
            self.memory.update((memory,)) if memory else self.memory.clear()
        yield from ()

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: int,
                     inclusive: bool = False, lateness: str | None = None) -> DataFrame:
    """Streaming form of ``sliding_admission``: client, event_id, t (microseconds), admitted, oldest.

    Requests are decided batch by batch, in time order within a batch; what one task holds is the times and ids of one
    client's share of one batch, so bound the batch at the source (maxFilesPerTrigger, maxOffsetsPerTrigger). Needs
    the RocksDB state store provider. With ``lateness`` ("10 minutes") requests older than the watermark are dropped,
    and the state of a client goes when the watermark passes the end of its window; without it every client ever seen
    keeps at most ``limit`` times. For the whole-service rule ``key`` is a constant: one counter, one task, by
    definition.
    """
    rows = events.select(F.col(key).alias("client"), epoch_micros(events, ts).alias("t"), F.col(event_id).alias("id"),
                         F.col(ts).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", lateness) if lateness else rows.drop("at")
    out = T.StructType([
        T.StructField("client", rows.schema["client"].dataType), T.StructField("id", rows.schema["id"].dataType),
        T.StructField("t", T.LongType()), T.StructField("admitted", T.BooleanType()),
        T.StructField("oldest", T.LongType())])
    admit = _Admit(Rule(limit, window_seconds * 1_000_000, inclusive), lateness is not None)
    return (
        rows.groupBy("client").transformWithStateInPandas(admit, out, "Append", "EventTime" if lateness else "none")
        .withColumnRenamed("id", event_id)
    )


class _Recent(StatefulProcessor):
    """Per conversation: the lines of the last n messages; a message without text has a place but no line."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        line = T.StructType([T.StructField("line", T.StringType())])
        self.lines = handle.getListState("lines", line, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows, ignore_index=True).sort_values("turn", ignore_index=True)
        lines = [r[0] for r in self.lines.get()] if self.lines.exists() else []
        for at in range(0, len(frame), PIECE):
            part, contexts = frame.iloc[at:at + PIECE], []
            for line in part["line"]:
                lines = [*lines, None if pd.isna(line) else line][-self.n:]
                contexts.append("\n".join(x for x in lines if x is not None))
            yield part.assign(conv_id=key[0], context=contexts)[["conv_id", "turn", "context"]]
        self.lines.put([(line,) for line in lines])

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, n: int = DEFAULTS.history_messages, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of ``recent_context``: conv_id, turn, context for messages that arrive in turn order.

    ``idle_ms`` lets go of the lines of a conversation that had no message for so long by the clock; its next message
    then starts anew. It is for streams that run on: Spark does not end a stream with such a clock by itself, also not
    with the trigger ``availableNow``.
    """
    line = X.chat_line(F.col("role"), F.col("text"))
    return (
        messages.select("conv_id", "turn", line.alias("line")).groupBy("conv_id")
        .transformWithStateInPandas(_Recent(n, idle_ms), "conv_id bigint, turn bigint, context string", "Append",
                                    "ProcessingTime" if idle_ms else "none")
    )


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there into a parquet folder and stops."""
    return (
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
