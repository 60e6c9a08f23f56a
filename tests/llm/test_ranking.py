import math
import re
from collections import Counter

import numpy as np
import pytest

from fathomdoc.llm import queries, ranking

DOCS, ITEMS = "doc_id long, text string, score long", "item_id long, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, k=10):
    """Scores of all documents for all items, one by one."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({i for i in items}, key=str):
        scored = []
        for (doc, bag), n in zip(bags, sizes):
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(seed, n_docs, n_items, n_words=300):
    random = np.random.default_rng(seed)
    chance = 1 / np.arange(1, n_words + 1)
    chance /= chance.sum()
    words = lambda n: " ".join(f"W{w}" for w in random.choice(n_words, n, p=chance))
    docs = [(int(i) - 5, words(int(random.integers(0, 60)))) for i in random.permutation(n_docs)]
    return docs, [(int(i), words(int(random.integers(1, 25)))) for i in range(n_items)]


def answer(spark, docs, items, partitions, **options):
    left = spark.createDataFrame([(*d, 0) for d in docs], DOCS).repartition(partitions)
    index = ranking.written(ranking.build_index(left), "blocks")
    found = ranking.search_index(index, spark.createDataFrame([(*i, 0) for i in items], ITEMS), **options).collect()
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("block, window, sample", [(8 << 20, 512, 16), (3000, 7, 1), (200, 64, 2)])
def test_equals_plain_loop(spark, monkeypatch, block, window, sample):
    for name, value in (("BLOCK_BYTES", block), ("WINDOW", window), ("SAMPLE", sample)):
        monkeypatch.setattr(ranking, name, value)
    docs, items = made(block, 600, 25)
    assert answer(spark, docs, items, 3) == plain_ranking(docs, items)


def test_rows_of_all_kinds(spark):
    docs = [(1, None), (2, ""), (3, "?! -"), (4, "Red Fox"), (4, "red fox"), (None, "red fox"), (5, "ÉTÉ été, red"), (6, "fox " * 50_000),
            (7, "x1 2y"), (8, "common"), (9, "common red"), (10, "common"), (11, "common")]
    items = [(1, "red fox"), (2, "RED red RED!"), (3, None), (4, ""), (5, "nowhere"), (None, "été"), (6, "ÉTÉ x1"), (1, "fox"), (2, "RED red RED!"), (7, "common")]
    expected = plain_ranking(docs, [i for i in items if terms(i[1])])
    assert answer(spark, docs, items, 2) == expected
    assert answer(spark, docs, items, 2, item_bytes=6) == expected
    assert answer(spark, docs, items, 2, k=1) == plain_ranking(docs, [i for i in items if terms(i[1])], 1)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(i, "other") for i in range(400, 420)]
    assert answer(spark, docs, [(1, "words")], 5) == plain_ranking(docs, [(1, "words")])


def test_empty_tables(spark):
    docs, items = made(1, 5, 2)
    assert answer(spark, [], items, 1) == [] and answer(spark, docs, [], 1) == []


def test_skips_what_cannot_reach(monkeypatch):
    """Once ten documents are found, a block of lists with lower bounds is left without touching a document."""
    best = ranking.Best(2, np.ones(1, np.int64))
    long = (np.arange(100), np.full(100, 5), 5)
    ranking.search_block([long, (np.array([50]), np.array([90]), 90), (np.array([70]), np.array([80]), 80)], np.arange(100), 0, best)
    assert best.ids[0].tolist() == [50, 70] and best.scores[0].tolist() == [95, 85] and best.least[0] == 85
    monkeypatch.setattr(best, "add", None)
    ranking.search_block([long, (np.arange(90), np.full(90, 7), 7)], np.arange(100), 0, best)


def test_query_equals_plain_loop(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(i, "text").collect()]
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = queries.QUERIES["op12_hybrid_ranked_search"](spark, folder).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found), key=str) == plain_ranking(docs, items)
