import itertools
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomdoc.llm import langid, lattice
from fathomdoc.llm.common import SLICE_BYTES, shingles, slices, word_hashes, word_spans

FOLDER = "/root/testdata/sf0.01"
WORDS = {"en": ["the", "and", "with", "thing", "water"], "de": ["der", "und", "mit", "ding", "wässer"]}


def labelled(n):
    rows = [(i, " ".join(WORDS[lang][(i * 7 + j * j) % 5] for j in range(3 + i % 40)), lang, "s")
            for i in range(n) for lang in [("en", "de")[i % 2]]]
    return rows


def test_language_edges(spark):
    rows = labelled(400) + [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "123 !? \n", None, ""), (1003, "Ж", "ru", ""),
                            (None, "the water", "en", ""), (1004, "und mit " * (SLICE_BYTES // 4), None, ""), (1005, "THE AND THING", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(found) == len(rows)
    for doc, text, lang, _ in rows[:400]:
        assert found[doc].lang_pred == lang and not found[doc].rejected
    for doc in (1000, 1001, 1002):
        assert (found[doc].lang_pred, found[doc].score, found[doc].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred in model.languages and found[1004].lang_pred == "de" and found[1005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert [(r.lang_pred, r.rejected) for r in langid.identify(docs, model).collect()] == [("und", True)]
    empty = docs.limit(0)
    assert langid.identify(empty, langid.train(empty, F.lit(True))).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    held = langid.identify(docs, model).filter(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, rejected, total = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")),
                                      F.avg(F.col("rejected").cast("double")), F.count("*")).first()
    assert total > 200 and right >= 0.98 and rejected <= 0.01


def test_low_scores_are_rejected():
    random = np.random.default_rng(1)
    rows = [(np.arange(8) + 8 * (i % 2), random.integers(1, 50, 8)) for i in range(100)]
    noise = [(np.arange(16), random.integers(1, 50, 16)) for _ in range(100)]
    labels = np.array([i % 2 for i in range(100)] + [int(x) for x in random.integers(0, 2, 100)])
    model = langid.fit(rows + noise, labels, ["a", "b"])
    mixed = np.zeros((1, langid.BUCKETS))
    mixed[0, :16] = 20
    clear = np.zeros((1, langid.BUCKETS))
    clear[0, :8] = 20
    assert model.scores(mixed).max() < model.least_score <= model.scores(clear).max()


@pytest.mark.parametrize("errors", [0.0, 0.005, 0.015, 0.03, 0.1])
def test_wrong_labels_do_not_reject_clean_texts(errors):
    random = np.random.default_rng(3)
    kept = []
    for _ in range(200):
        score, wrong = random.uniform(0.6, 1, 800), random.random(800) < errors
        kept.append((score >= langid.least_score(score, wrong)).mean())
    assert np.median(kept) == 1 and min(kept) >= 0.5
    # Answers that are wrong where the score is low are still rejected.
    score = np.r_[np.full(700, 0.9), np.full(100, 0.4)] + random.uniform(0, 0.05, 800)
    wrong = random.random(800) < np.where(score > 0.8, errors, 0.5)
    assert 0.4 < langid.least_score(score, wrong) < 0.96 and (score[score > 0.8] >= langid.least_score(score, wrong)).all()


def test_pipeline_keeps_documents_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, "more text", None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 2


def test_words_against_a_plain_loop():
    texts = ["a  b\tA\x0bcd", "", None, "ä x é", " ", "one", "a b c d a b c d", "x" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seen = {}
    for part, data, offsets in slices(batch):
        row, start, end = word_spans(data, offsets)
        found = [(int(r), bytes(data[s:e]).decode()) for r, s, e in zip(row, start, end)]
        import re
        assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        for (_, w), h in zip(found, word_hashes(data, start, end)):
            assert seen.setdefault(w.lower() if w.isascii() else w, h) == h
        assert len(set(seen.values())) == len(seen)
        rows, _ = shingles(row, word_hashes(data, start, end), 4, len(texts))
        assert np.bincount(rows, minlength=8).tolist() == [1, 0, 0, 1, 0, 1, 4, 1]


def brute(word, log_p):
    """Sum over every segmentation, by listing them."""
    total, n = 0.0, len(word)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        marks = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        parts = [word[a:b] for a, b in zip(marks, marks[1:])]
        if all(p in log_p for p in parts):
            total += math.exp(sum(log_p[p] for p in parts))
    return math.log(total)


def test_lattice_against_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "aba", "c"]
    random = np.random.default_rng(5)
    p = random.random(len(pieces) + 256)
    log_p = np.log(p / p.sum())
    net = lattice.Lattice(pieces, log_p)
    table = dict(zip(pieces, log_p))
    table["é"] = sum(log_p[len(pieces) + b] for b in "é".encode())
    words = ["a", "ab", "abab", "babab", "c", "aé", "ccccab", "bababababa"]
    weights = np.arange(1.0, len(words) + 1)
    found, counts = net.words(pa.array(words), weights)
    for word, value in zip(words, found):
        assert value == pytest.approx(brute("▁" + word, table)) == pytest.approx(net.slow(word))
    # One round of expectation never lowers the likelihood.
    again = lattice.Lattice(pieces, np.log(np.maximum(counts, 1e-12) / counts.sum()))
    assert (again.words(pa.array(words))[0] @ weights) >= found @ weights - 1e-9
    assert counts[len(pieces):].sum() == pytest.approx(2 * weights[5])
    long = "ab" * 40
    assert net.words(pa.array([long]))[0][0] == pytest.approx(net.slow(long))


def test_expected_counts_do_not_depend_on_the_length(monkeypatch):
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "aba", "c"]
    p = np.random.default_rng(6).random(len(pieces) + 256)
    net = lattice.Lattice(pieces, np.log(p / p.sum()))
    words, weights = ["ab" * 40, "abac" * 15 + "é", "x" * 50, "bab" * 16, "aé" * 200], np.array([1.0, 2.0, 3.0, 4.0, 0.5])
    by_loop = net.words(pa.array(words), weights)
    monkeypatch.setattr(lattice, "LONG_WORD", 1000)
    in_blocks = net.words(pa.array(words), weights)
    assert np.allclose(by_loop[0], in_blocks[0]) and np.allclose(by_loop[1], in_blocks[1])
    assert by_loop[1][pieces.index("ab")] > 0


def test_scores_against_a_plain_loop(spark):
    rows = [(1, "The the THE cat", 1), (2, None, 1), (3, "", 1), (4, "cat é dog dog", 1), (5, "unseen words", 0), (5, "unseen words", 0),
            (None, "the dog", 1), (7, "x" * 3000 + " the", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int")
    found = lattice.score_documents(docs, F.col("h") == 1, public_tokenizers.path("piece_bpe_32k.model")).collect()
    tokens = [[*(t or "").lower().split(), None] for _, t, _ in rows]
    counts = Counter(w for (_, _, learn), t in zip(rows, tokens) for w in t if learn)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((d or -1, not learn, len(t), sum(w in counts for w in t), n,
                       round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for (d, _, learn), t in zip(rows, tokens))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    by_doc = {r.doc_id: r.score for r in found}
    assert by_doc[2] == by_doc[3] < 0 and by_doc[4] < by_doc[2] and len(found) == len(rows)
    assert by_doc[None] > by_doc[5]


def test_scores_of_rare_words_meet_by_the_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(100)
    path = public_tokenizers.path("piece_bpe_32k.model")
    frame = spark.createDataFrame(docs.toArrow())
    columns = "doc_id", "n_tokens", "n_known", "base_score", "score"
    all_sent = sorted(tuple(r) for r in lattice.score_documents(frame, F.lit(True), path).select(*columns).collect())
    monkeypatch.setattr(lattice, "FREQUENT_SHARE", 1e-3)
    joined = sorted(tuple(r) for r in lattice.score_documents(frame, F.lit(True), path).select(*columns).collect())
    assert [r[:3] for r in all_sent] == [r[:3] for r in joined]
    assert np.allclose([r[3:] for r in all_sent], [r[3:] for r in joined], atol=1e-4)


def test_scores_of_nothing(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lattice.score_documents(docs.limit(0), F.lit(True), path).count() == 0
    untrained = lattice.score_documents(docs, F.lit(False), path).first()
    assert (untrained.train_tokens, untrained.n_known, untrained.base_score) == (0, 0, 0.0) and untrained.score < 0
