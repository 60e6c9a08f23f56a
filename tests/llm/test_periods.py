import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fathomdoc.llm import periods, queries

SCHEMA = "doc_id long, text string, runs string, length int"


def plain_runs(words, least=12):
    """Every run by a scan of every period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_collapsed(words, runs):
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def symbols(texts):
    return np.array([hash(w) & (2**63 - 1) for t in texts for w in t], np.uint64), np.array([len(t) for t in texts], np.int64)


def found_runs(texts):
    out = [[] for _ in texts]
    for t, *run in zip(*periods.find_runs(*symbols(texts))):
        out[t].append(tuple(map(int, run)))
    return [sorted(o) for o in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60) | st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=8), st.integers(1, 12))
                .map(lambda x: x[0] * x[1]), max_size=6))
def test_all_runs_of_small_alphabets(texts):
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_long_and_nested_runs():
    random = np.random.default_rng(3)
    inner = [1, 2] * 9 + [3]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [[7] * 700, inner * 6, [7] * 11, [7] * 12, fibonacci[-1], list(random.integers(0, 2, 900)), [], list(range(500)) * 2,
             list(range(300)) + [5, 6, 7] * 40 + list(range(300)), [1] * 12 + [2] * 12 + [1] * 12] * 2
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_extension_equals_scan():
    random = np.random.default_rng(5)
    base = np.concatenate([random.integers(0, 3, 500), np.tile(random.integers(0, 3, 17), 30), np.zeros(300, int), random.integers(0, 2, 400)])
    sequence = np.concatenate([[10], base, [11]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grammar = periods.Grammar(sequence)
    n = len(sequence)
    i, j = random.integers(1, n - 1, (2, 4000))
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    ahead, back = grammar.extension(i, j), grammar.mirrored().extension(n - 1 - i, n - 1 - j)
    for a, b, right, left in zip(i, j, ahead, back):
        k = 0
        while b + k < n and sequence[a + k] == sequence[b + k]:
            k += 1
        m = 0
        while a - m >= 0 and sequence[a - m] == sequence[b - m]:
            m += 1
        assert (right, left) == (k, m)
    # Levels shrink, and no symbol is lost on the way up.
    assert len(grammar.symbols) < 80 and len(grammar.symbols[-1]) == 1
    assert all(f[0] == 0 and f[-1] == len(s) for f, s in zip(grammar.first[1:], grammar.symbols))


def test_rows_of_all_kinds(spark):
    texts = [None, "", " \n ", "la " * 40, "a b c " * 10 + "x", "one two three", "é ü " * 8, "na\tna\nna\x0bna\x0cna\rna " * 3 + "  end",
             "w " * 60_000, " ".join(map(str, range(30_000))), "A a " * 7]
    rows = [(i if i % 4 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "", 0)] * 2
    found = periods.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    expected = []
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 10_000 else ([(0, 60_000, 1)] if words[0] == "w" else [])
        expected.append((doc, len(words), [tuple(r) for r in runs], plain_collapsed(words, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def digest(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest())


def test_query_equals_plain_loop(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    strange = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", " ", "x", "a b " * 30, "é " * 15])], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(strange).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = queries.QUERIES["op11_recompression_runs"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(digest(d.doc_id, d.text) for d in docs)
    assert sum(r.n_runs > 0 for r in found) > 5
