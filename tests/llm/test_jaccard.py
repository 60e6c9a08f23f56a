import re

import numpy as np
import pytest

from fathomdoc.llm import jaccard
from fathomdoc.llm.components import components
from fathomdoc.operators import late

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, width=4, percent=85):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def family(random, n, words, edits):
    base = [f"w{x}" for x in random.integers(0, 400, words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in random.integers(0, words, random.integers(0, edits + 1)):
            copy[at] = f"e{random.integers(0, 999)}"
        out.append(" ".join(copy))
    return out


def rows_of(seed):
    random = np.random.default_rng(seed)
    texts = [None, "", " \n", "One", "one", "one two", "ONE two\tthree", "a b c d", "a b c d", "É b c d", "é b c d", "x" * 5000]
    for words in (12, 40, 150, 600):
        texts += family(random, 14, words, max(2, words // 25))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + t for t in family(random, 10, 60, 40)] + [" ".join(f"q{i % 3}" for i in range(900))] * 3
    order = random.permutation(len(texts))
    return [(int(i), texts[j]) for i, j in enumerate(order)] + [(3, texts[order[3]])]


@pytest.mark.parametrize("seed, small, block", [(1, 128, 1024), (2, 0, 1024), (3, 128, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, anchors string").repartition(4)
    found = jaccard.similar_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)


def test_null_ids_and_nothing(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "lonely text without a number"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(
        [(None, 2, 5), (None, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None)], key=str)
    assert jaccard.similar_documents(docs.limit(0)).count() == 0


def test_other_widths_and_bounds(spark):
    rows = [r for r in rows_of(7) if r[0] % 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_documents(docs, width=5, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 5, 80)


def test_cells_never_exclude_a_link():
    random = np.random.default_rng(4)
    for n in (3, 50, 700):
        for _ in range(20):
            x = random.choice(10**6, n, replace=False)
            y = np.r_[x[random.integers(0, n // 4 + 1):], random.choice(10**6, random.integers(0, n // 4 + 1))]
            y = np.unique(y)
            common, union = len(set(x) & set(y)), len(set(x) | set(y))
            cells = [np.minimum(np.bincount(v % jaccard.CELLS, minlength=jaccard.CELLS), 255).astype(np.uint8)[None] for v in (x, y)]
            link, twice = jaccard._bounds(*cells, np.array([len(x)]), np.array([len(y)]), 85)
            assert link[0] or 100 * common < 85 * union
            assert twice[0] or 100 * common < 70 * union


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 131)} | {i: 500 for i in range(500, 560)} | {8: 8, 9: 8}


def test_one_of_each_of_repeated_ids_null_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text.replace("w59", "x"), "quite another text of seven words here"
    rows = [(1, text, "a", 1), (2, near, "b", 2), (2, other, "c", 3), (3, other + " too", "d", 4), (3, other + " too", "e", 5),
            (None, text, "f", 6), (None, "alone and without a number at all", "g", 7), (None, None, "h", 8), (4, "", "i", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_id string, component_id int")
    kept = jaccard.one_of_each(docs).collect()
    assert docs.columns == jaccard.one_of_each(docs).columns
    found = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert found == sorted([(1, text), (2, other), (3, other + " too"), (None, "alone and without a number at all"), (None, None), (4, "")], key=str)


@pytest.mark.parametrize("sent", [400_000, 0])
def test_regions_of_one_document_get_no_pivot(spark, monkeypatch, sent):
    """Only rows of regions with several documents are dealt out with their ids, whether the regions are sent or a bitmap."""
    monkeypatch.setattr(late, "SENT_ROWS", sent)
    seen, pivots = [], jaccard._Join._pivots
    monkeypatch.setattr(jaccard._Join, "_pivots", staticmethod(lambda member: seen.append(member) or pivots(member)))
    rows = rows_of(5) + [(1000 + i, " ".join(f"own{i}x{j}" for j in range(50))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard.similar_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)
    assert seen[0].groupBy("region").count().filter("count = 1").isEmpty() and not seen[0].isEmpty()
