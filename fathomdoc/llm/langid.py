"""Language of a text: averaged hashed subword embeddings and a linear softmax, trained by gradient descent in numpy.

Subwords are the runs of three and four bytes inside a word, its two ends included as marks. Their embeddings are
averaged over the whole text and one linear layer gives a weight for each language. A temperature, fitted on texts
that training left out, turns the weights into probabilities; the lowest probability at which answers on those texts
are wrong little more often than on the likeliest half of them is the bound below which a text is rejected. Labels that
are wrong anywhere count in both, so they do not move the bound.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomdoc.llm.common import SMALL_SLICE_BYTES, remainder, share_below, slices

#: Hashed subwords, numbers in an embedding, texts learned from for each language and for all, languages at most.
BUCKETS, WIDTH, PER_LANGUAGE, MOST_TEXTS, MOST_LANGUAGES = 1 << 13, 16, 1000, 16_000, 256
EPOCHS, BATCH, RATE, MOST_ERRORS = 8, 64, 0.3, 0.01
#: At most this share of the texts left out of training lies below the bound.
MOST_REJECTED = 0.5
UNKNOWN = "und"

_random = np.random.default_rng(7)
_TABLES = _random.integers(0, BUCKETS, (7, 256), dtype=np.uint16)
#: Bytes as the subwords see them: letters without case, bytes of other scripts, and 0 for all else.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: each bucket's embedding times the linear layer
    bias: np.ndarray
    temperature: float
    least_score: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        return _softmax((mean @ self.weights + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def subword_counts(data: np.ndarray, offsets: np.ndarray, block: int = 64) -> Iterator[np.ndarray]:
    """Counts of hashed subwords, for blocks of the texts in order."""
    for first in range(0, len(offsets) - 1, block):
        marks = offsets[first : first + block + 1] - offsets[first]
        body = _FOLD[data[offsets[first] : offsets[first] + marks[-1]]]
        text = np.concatenate([np.insert(body, marks[:-1], 0), np.zeros(2, np.uint8)])
        row = np.repeat(np.arange(len(marks) - 1), np.diff(marks) + 1)
        n = len(row)
        a, b, c, d = (text[i : i + n] if i < 3 else np.append(text[3:], 0)[:n] for i in range(4))
        three = _TABLES[0][a] ^ _TABLES[1][b] ^ _TABLES[2][c]
        four = _TABLES[3][a] ^ _TABLES[4][b] ^ _TABLES[5][c] ^ _TABLES[6][d]
        # A text begins with a mark, so a subword whose inner bytes are no marks lies in one text.
        inside = (b != 0) & (np.arange(n) < n - 1)
        far = inside & (c != 0)
        place = row.astype(np.int64) * BUCKETS
        index = np.concatenate([place[inside] + three[inside], place[far] + four[far]])
        yield np.bincount(index, minlength=(len(marks) - 1) * BUCKETS).reshape(-1, BUCKETS)


def _sampled(batches):
    """(lang, buckets, counts, key) of each text, sparse."""
    for batch in batches:
        for part, data, offsets in slices(batch):
            rows = [r for block in subword_counts(data, offsets) for r in block]
            used = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("lang")).cast(pa.string()),
                 pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                 pa.array([r[u].astype("<u4").tobytes() for r, u in zip(rows, used)], pa.binary()),
                 part.column(part.schema.get_field_index("key"))], ["lang", "buckets", "counts", "key"])


def _thinned(rows: list, random: np.random.Generator, kept: np.ndarray) -> np.ndarray:
    """Dense counts of each sparse text after keeping about this many of its subwords, as a short text would have."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, ((used, counts), keep) in enumerate(zip(rows, kept)):
        out[i, used] = random.binomial(counts.astype(np.int64), min(1.0, keep / max(1, int(counts.sum()))))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str]) -> LanguageModel:
    """Trains on four fifths of the texts and calibrates on the rest."""
    random, n = np.random.default_rng(11), len(languages)
    order = random.permutation(len(rows))
    checked, learned = order[: len(rows) // 5], order[len(rows) // 5 :]
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = random.normal(0, 0.1, (WIDTH, n)).astype(np.float32), np.zeros(n, np.float32)
    square = [np.full_like(p, 1e-6) for p in (embedding, linear, bias)]
    for epoch in range(EPOCHS):
        for first in range(0, len(learned), BATCH):
            some = random.permutation(learned)[:BATCH]
            kept = np.where(random.random(len(some)) < 0.5, np.inf, np.exp(random.uniform(2, 6, len(some))))
            x = _thinned([rows[i] for i in some], random, kept)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            hidden = x @ embedding
            error = _softmax(hidden @ linear + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            for parameter, slope, past in zip((embedding, linear, bias), (
                    x.T @ (error @ linear.T), hidden.T @ error, error.sum(0)), square):
                past += slope**2
                parameter -= RATE / (1 + epoch) * slope / np.sqrt(past)
    model = LanguageModel(languages, embedding @ linear, bias, 1.0, 0.0)
    if not len(checked):
        return model
    kept = np.where(np.arange(len(checked)) % 2, np.inf, np.exp(random.uniform(3, 6, len(checked))))
    truth, parts = labels[checked], []
    for first in range(0, len(checked), 256):
        counts = _thinned([rows[i] for i in checked[first : first + 256]], random, kept[first : first + 256])
        parts.append(counts / np.maximum(counts.sum(1, keepdims=True), 1) @ model.weights + bias)
    weight = np.concatenate(parts)

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(weight / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = float(min(np.exp(np.linspace(-3, 2, 51)), key=loss))
    p = _softmax(weight / temperature)
    return LanguageModel(languages, model.weights, bias, temperature, least_score(p.max(1), p.argmax(1) != truth))


def least_score(score: np.ndarray, wrong: np.ndarray) -> float:
    """The bound below which answers are rejected, from scores and whether each answer differs from its label.

    Down to the bound at most ``MOST_ERRORS`` more answers are wrong than among the likeliest, give or take two
    standard errors of that share. If that holds for all, half of the mass is asked for.
    """
    rank = np.argsort(-score, kind="stable")
    share = np.cumsum(wrong[rank]) / np.arange(1, len(rank) + 1)
    sure = max(1, int(np.ceil(len(rank) * (1 - MOST_REJECTED))))
    base = share[sure - 1]
    good = np.flatnonzero(share <= base + MOST_ERRORS + 2 * np.sqrt(base * (1 - base) / sure))
    # The last of the sure answers is always within the bound.
    least = float(score[rank][good[-1]])
    return min(least, 0.5) if good[-1] == len(rank) - 1 else least


def _fitted(languages: list[str]):
    """One row, the pickled numbers of the model, from the rows of ``_sampled``."""

    def learn(batches):
        place = {lang: i for i, lang in enumerate(languages)}
        texts, labels = [], []
        for batch in batches:
            kept = [batch.column(c) for c in (1, 2)]
            texts += [tuple(np.frombuffer(c[i].as_buffer(), k) for c, k in zip(kept, ("<u2", "<u4"))) for i in range(batch.num_rows)]
            labels += [place[x] for x in batch.column(0).to_pylist()]
        # Training sees the texts in an order that does not depend on the tasks they come from.
        order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i][0].tobytes(), texts[i][1].tobytes()))
        model = fit([texts[i] for i in order], np.array(labels, np.int64)[order], languages)
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.ascontiguousarray(model.weights, "<f4").tobytes()]), pa.array([np.asarray(model.bias, "<f4").tobytes()]),
             pa.array([model.temperature]), pa.array([model.least_score])], ["weights", "bias", "temperature", "least_score"])

    return learn


def train(documents: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from a bounded sample of the rows of (doc_id, text, lang) where ``learn_from`` holds and neither is null.

    At most ``per_language`` texts, and ``MOST_TEXTS`` of all, are drawn by a hash of the row from each of the
    ``MOST_LANGUAGES`` commonest languages. These whole texts become at most BUCKETS counts each on the executors. One
    task trains on these counts, at most ``MOST_TEXTS * BUCKETS * 6`` bytes, and only the model reaches the driver.
    Without such rows the model knows no language and every answer is ``und``.
    """
    rows = documents.filter(learn_from & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    nothing = LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    if not sizes:
        return nothing
    languages = sorted(sizes)
    most = max(1, min(per_language, MOST_TEXTS // len(sizes)))
    drawn = F.lit(False)
    for lang, size in sizes.items():
        # Some more than are wanted, as a hash draws about a share.
        drawn = drawn | ((F.col("lang") == lang) & share_below(F.col("doc_id"), 1.25 * (most + 20) / size, 3))
    keyed = rows.filter(drawn & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    counts = keyed.mapInArrow(_sampled, "lang string, buckets binary, counts binary, key long")
    first = Window.partitionBy("lang").orderBy("key", "buckets")
    sample = counts.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select("lang", "buckets", "counts")
    fitted = sample.repartition(1).mapInArrow(_fitted(languages), "weights binary, bias binary, temperature double, least_score double").first()
    if fitted is None:
        return nothing
    return LanguageModel(languages, np.frombuffer(fitted.weights, "<f4").reshape(BUCKETS, -1), np.frombuffer(fitted.bias, "<f4"),
                         fitted.temperature, fitted.least_score)


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``documents`` and lang_pred, score, rejected, from the column ``text`` alone.

    Texts that are null or have no letter are ``und`` with score 0 and rejected; others have the likeliest language,
    the first of equals in alphabetical order, and are rejected below the model's least score. Input columns called
    like the new ones are replaced. Texts are read whole, one slice of a few megabytes (or one text) at a time.
    """
    source = documents.drop("lang_pred", "score", "rejected")

    def predict(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, size=SMALL_SLICE_BYTES):
                n = part.num_rows
                texts = part.column(part.schema.get_field_index("text"))
                ascii_letters = np.r_[0, np.cumsum((_FOLD[data] > 0) & (data < 128))]
                letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[i] = _has_letter(texts[int(i)].as_py())
                best, score = np.zeros(n, np.int64), np.zeros(n)
                if model.languages:
                    at = 0
                    for counts in subword_counts(data, offsets):
                        p = model.scores(counts.astype(np.float32))
                        best[at : at + len(p)], score[at : at + len(p)] = p.argmax(1), p.max(1)
                        at += len(p)
                else:
                    letters[:] = False
                names = np.array([*model.languages, UNKNOWN], object)
                answer = names[np.where(letters, best, -1)]
                score = np.where(letters, np.minimum(score, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(answer, pa.string()), pa.array(score, pa.float64()),
                     pa.array(~letters | (score < model.least_score), pa.bool_())],
                    [*part.schema.names, "lang_pred", "score", "rejected"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(predict, f"{kept}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1
