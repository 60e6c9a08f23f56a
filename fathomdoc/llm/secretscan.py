"""Secrets in documents: candidates by shape, false positives removed by a random forest.

A candidate is a run of 16 or more characters of the alphabets that keys are written in, or a shorter or freer value
right after the name of a secret (``password = "..."``), with a digit or mixed case. A run that holds ``name=`` is parted
there. Its features are its length, classes and transitions of characters, how likely its letter pairs are in the corpus, the
share that words of the corpus cover, whether it is part of a path or address, and the words around it. The dictionary
is counted over all documents. The forest is trained by Spark on labelled findings, of which a bounded sample is drawn.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.llm.common import columns_of, share_below, written

#: Whole runs of at least this many characters, their parts between equals signs (those at the end are padding), and
#: values of at least so many characters after a name, which may be quoted.
LEAST_RUN, LEAST_VALUE = 16, 6
RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{LEAST_RUN},}}+")
PART = re.compile(r"[^=]+(?:=+$)?")
ASSIGNED = re.compile(rf"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]*+)['\"]?[ \t]*+(?::=?|=>?)[ \t]*+['\"]?([^\s'\"]{{{LEAST_VALUE},}}+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSING = ".,;:!?)]}>"
#: A word of at least this share of all words is in the dictionary, so it has at most 50,000.
DICTIONARY_SHARE, LEAST_LETTERS = 2e-5, 4
#: Labelled findings of each class that the forest is trained on, and its shape.
MOST_LABELLED, TREES, DEPTH, SEED = 10_000, 24, 8, 13
#: Words are looked for in so many characters before and after a candidate, and hashed to so many features.
CONTEXT, NEIGHBOURS = 48, 16
#: Texts that a task holds as Python strings at a time.
TEXTS = 64
#: Words that name secrets, words that name other codes, and prefixes of issued keys.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access")
OTHER_WORDS = ("sha", "sha1", "sha256", "md5", "hash", "commit", "checksum", "digest", "uuid", "guid", "id", "isbn", "doi", "version",
               "example", "sample", "test", "etag", "revision", "http", "https", "www")
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ")
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "transitions", "entropy", "pairs", "covered", "hex", "slashes", "in_path",
            "quoted", "assigned", "issued", "secret_words", "other_words", *[f"near_{i}" for i in range(NEIGHBOURS)]]
FOUND = "doc_id {id}, start long, length int, fingerprint string, label int, " + ", ".join(f"{f} double" for f in FEATURES if f != "length")
_WORD = re.compile(r"[A-Za-z]+")


def dictionary(documents: DataFrame) -> dict[str, float]:
    """The corpus's common words of letters in lower case, with their shares of all words."""
    words = columns_of(documents, "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "dictionary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter((F.col("n") >= F.lit(DICTIONARY_SHARE * total)) & (F.length("word") >= LEAST_LETTERS))
    return {r.word: r.n / total for r in common.collect()}


class Features:
    """Features of a candidate in its text, from a dictionary."""

    def __init__(self, words: dict[str, float]):
        self.words = frozenset(words)
        self.longest = max(map(len, words), default=0)
        pairs = np.ones((27, 27))
        for word, share in words.items():
            for a, b in zip(word, word[1:]):
                pairs[ord(a) - 97, ord(b) - 97] += share * 1e6
        self.pairs = np.log2(pairs / pairs.sum(1, keepdims=True))

    def _pair_score(self, letters: str) -> float:
        runs = [p for run in _WORD.findall(letters) for p in zip(run, run[1:])]
        return float(np.mean([self.pairs[ord(a) - 97, ord(b) - 97] for a, b in runs])) if runs else -8.0

    def _covered(self, low: str) -> float:
        """Share of the characters inside dictionary words, taking the longest word at each place."""
        at = covered = 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), LEAST_LETTERS - 1, -1) if low[at : at + n] in self.words), 0)
            covered, at = covered + size, at + max(1, size)
        return covered / len(low)

    def of(self, text: str, start: int, end: int) -> list[float]:
        c = text[start:end]
        low, n = c.lower(), end - start
        kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "s" for x in c]
        counts = np.unique(list(c), return_counts=True)[1] / n
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        near = [w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]]
        hashed = [0.0] * NEIGHBOURS
        for w in near:
            hashed[sum(ord(x) * 31**i for i, x in enumerate(w[:12])) % NEIGHBOURS] += 1.0
        left = before.rstrip(" \t")
        bare = left.rstrip("'\"").rstrip(" \t")
        return [float(n), *[kinds.count(k) / n for k in "duls"], sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
                float(-(counts * np.log2(counts)).sum()), self._pair_score(low), self._covered(low),
                float(all(x in "0123456789abcdef" for x in low)), float(c.count("/")),
                float(before[-1:] in ("/", "\\", ".", "@") or after[:1] in (".", "/", "@", "\\") and after[1:2].isalnum()),
                float(before[-1:] in ("'", '"') and after[:1] == before[-1:]), float(bare[-1:] in ("=", ":")), float(c.startswith(ISSUED)),
                float(sum(w in SECRET_WORDS for w in near)), float(sum(w in OTHER_WORDS for w in near)), *hashed]


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of all candidates of a text in order, each once."""
    out = set()
    for run in RUN.finditer(text):
        out.update((run.start() + part.start(), run.start() + part.end()) for part in PART.finditer(run[0]) if len(part[0]) >= LEAST_RUN)
    for pair in ASSIGNED.finditer(text):
        value = pair[2].rstrip(CLOSING)
        if len(value) >= LEAST_VALUE and names_secret(pair[1]):
            out.add((pair.start(2), pair.start(2) + len(value)))
    return sorted(span for span in out if is_candidate(text[span[0] : span[1]]))


def names_secret(name: str) -> bool:
    """Whether a part of a name in any of the usual spellings is a word for secrets."""
    return any(p.lower() in SECRET_WORDS for p in NAME_PART.findall(name))


def is_candidate(c: str) -> bool:
    return any(x.isdigit() for x in c) or not (c.islower() or c.isupper() or c[1:].islower() and c.isalpha())


def rule_label(f: dict[str, float]) -> int | None:
    """A label for findings that plain rules decide: 1 for issued prefixes and quoted assignments to the name of a
    secret, 0 for numbers, parts of addresses, known codes and runs of words, None for all others."""
    if f["issued"] or f["quoted"] and f["assigned"] and f["secret_words"] and not f["other_words"] and f["covered"] < 0.5:
        return 1
    if f["digits"] == 1 or f["in_path"] or f["covered"] >= 0.5 or f["other_words"] and not f["secret_words"] or f["digits"] == 0 and f["signs"] == 0:
        return 0
    return None


def findings(documents: DataFrame, words: dict[str, float]) -> DataFrame:
    """(doc_id, start, length, fingerprint, label, features): every candidate of every whole text.

    ``start`` counts characters, ``fingerprint`` is a hash that does not give the value away, ``label`` is the one of
    the rules. Candidates have any length and may lie in one another; null and empty texts have none; repeated rows have theirs each; other columns are ignored.
    """
    import hashlib

    docs = columns_of(documents, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    sent = documents.sparkSession.sparkContext.broadcast(words)
    schema = FOUND.format(id=dict(docs.dtypes)["doc_id"])
    columns = [part.split()[0] for part in schema.split(", ")]

    def scan(batches):
        features = Features(sent.value)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part, rows = batch.slice(first, TEXTS), []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for start, end in spans(text or ""):
                        values = features.of(text, start, end)
                        rows.append((i, start, end - start, hashlib.sha256(text[start:end].encode()).hexdigest()[:16],
                                     rule_label(dict(zip(FEATURES, values))), *values[1:]))
                if rows:
                    i, start, length, fingerprint, label, *values = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(i)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(fingerprint),
                         pa.array(label, pa.int32()), *[pa.array(v, pa.float64()) for v in values]], columns)

    return docs.mapInArrow(scan, schema)


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)


def train(found: DataFrame, label: Column) -> RandomForestClassificationModel | None:
    """A forest from at most about ``MOST_LABELLED`` findings of each label, drawn by a hash; both labels must occur."""
    labelled = found.withColumn("label", label.cast("double")).filter("label IS NOT NULL")
    sizes = {int(r.label): r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    key = F.xxhash64("fingerprint", "doc_id", "start")
    drawn = F.lit(False)
    for value, size in sizes.items():
        drawn = drawn | ((F.col("label") == value) & share_below(key, MOST_LABELLED / size, SEED))
    sample = written(labelled.filter(drawn).orderBy("doc_id", "start"), "labelled-findings")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_assembled(sample))


def scan_secrets(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, fingerprint, probability, secret) of every candidate in ``documents``.

    ``labels`` (doc_id, start, label) are findings that someone judged; without them, or where they do not have both
    labels, the rules label what they can. ``secret`` is whether at least half of the forest's weight is for it; if
    nothing can be learned, the rules' label stands, and findings they leave open count as secrets.
    """
    found = written(findings(documents, dictionary(documents)), "findings")
    label, judged = F.col("label"), found
    if labels is not None:
        given = labels.select("doc_id", F.col("start").cast("long"), F.col("label").alias("given")).dropDuplicates(["doc_id", "start"])
        judged, label = found.join(given, ["doc_id", "start"], "left"), F.col("given")
    model = train(judged, label) or (train(found, F.col("label")) if labels is not None else None)
    if model is None:
        probability = F.coalesce(F.col("label"), F.lit(1)).cast("double")
    else:
        found = model.transform(_assembled(found))
        probability = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return found.select("doc_id", "start", "length", "fingerprint", probability.alias("probability")).withColumn(
        "secret", F.col("probability") >= 0.5)
