"""Attaching embeddings through a batch function."""

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]

HASH_DIMENSIONS = 256
# Words whose dimension a worker remembers: some 10 MB. Words of their own kind (numbers, names) come with every new text,
# so what is remembered of a long stretch would be mostly words that do not come again.
REMEMBERED = 1 << 16
# Calls of the function whose vectors leave a worker together.
CALLS_AT_ONCE = 8


class HashingEmbedder:
    """Unit vector of word counts, words hashed to dimensions; needs no model and no network."""

    def __init__(self, dimensions: int = HASH_DIMENSIONS, remembered: int = REMEMBERED):
        self.dimensions, self.remembered = dimensions, remembered
        self.known: dict[bytes, int] = {}

    def __reduce__(self):
        return HashingEmbedder, (self.dimensions, self.remembered)

    def _dimension(self, word: bytes) -> int:
        found = self.known[word] = int(sha256(word).hexdigest()[:8], 16) % self.dimensions
        return found

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known.clear()
        known, vectors = self.known, np.zeros((len(texts), self.dimensions))
        for n, text in enumerate(texts):
            # Bytes split at ASCII white space only, as the JVM's \s does.
            where = [known[w] if w in known else self._dimension(w) for w in text.lower().encode("utf-8").split()]
            if where:
                vectors[n] = np.bincount(where, minlength=self.dimensions)
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return (vectors / np.where(norms, norms, 1)).astype(np.float32)


hashing_embedder = HashingEmbedder()


def embed(df: DataFrame, text: str, fn: EmbedFn = hashing_embedder, batch_size: int = 256,
          name: str = "embedding") -> DataFrame:
    """Adds an ARRAY<FLOAT> column; ``fn`` gets up to ``batch_size`` texts and answers in the same order.

    Empty texts are sent like any other; null stays null.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for first in range(0, len(whole), CALLS_AT_ONCE * batch_size):
                batch = whole.slice(first, CALLS_AT_ONCE * batch_size)
                present = batch.drop_null()
                parts = []
                for start in range(0, len(present), batch_size):
                    texts = present[start:start + batch_size].to_pylist()
                    vectors = np.asarray(fn(texts), dtype=np.float32)
                    if len(vectors) != len(texts):
                        raise ValueError(f"embedder gave {len(vectors)} vectors for {len(texts)} texts")
                    parts.append(vectors)
                flat = np.concatenate(parts).ravel() if parts else np.empty(0, np.float32)
                width = parts[0].shape[1] if parts else 0
                lengths = np.where(batch.is_valid().to_numpy(zero_copy_only=False), width, 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=batch.is_null())

    # Not deterministic for the optimizer: otherwise a filter on the vector, even an inferred one, would be pushed
    # below a shuffle or a generator and make the vectors twice.
    return df.withColumn(name, run.asNondeterministic()(text))
