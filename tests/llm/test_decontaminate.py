import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fathomdoc.llm import common, decontaminate as dec

FOLDER = "/root/testdata/sf0.01"
ITEM = "Which river flows past the old harbour town before it meets the northern sea? The silver Ambra"
FILLER = " ".join(f"word{i} and the other{i % 7} of line{i}." for i in range(60))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    random = np.random.default_rng(2)
    for n, m in itertools.product([1, 3, 20, 90], [0, 1, 15, 200]):
        a, b = random.integers(0, 6, n).astype(np.uint64), random.integers(0, 6, m).astype(np.uint64)
        assert dec.lcs_length(a, b) == plain_lcs(a.tolist(), b.tolist())


def test_windows_grow_with_items():
    assert [dec.window_of(n) for n in (1, 8, 9, 12, 13, 17, 24, 25, 100)] == [8, 8, 12, 12, 16, 24, 24, 32, 128]


def test_edges(spark):
    words = ITEM.split()
    rows = [(1, f"{FILLER} {ITEM} {FILLER}"), (2, f"{FILLER} {ITEM.upper()}"), (3, ITEM.replace(" ", "\n\n")),
            (4, f"{FILLER} {' '.join(w for i, w in enumerate(words) if i % 6 != 2)} {FILLER}"),  # words left out
            (5, f"{FILLER} {' '.join('x' + str(i) if i % 6 == 3 else w for i, w in enumerate(words))}"),  # words replaced
            (6, FILLER), (7, None), (8, ""), (9, " ".join(reversed(words))), (10, " ".join(words[:6])),
            (None, ITEM), (1, f"{FILLER} {ITEM} {FILLER}"), (11, f"{FILLER} " * 300 + ITEM)]
    rows += [(1000 + i, f"some other text{i} about thing{i}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, start int").repartition(3)
    bench = spark.createDataFrame([(70, ITEM, 1), (70, ITEM, 1), (71, None, 1), (72, "too short", 1), (None, FILLER, 1),
                                   (73, "une autre question sans rapport avec les textes donnés plus haut", 1)],
                                  "item_id long, text string, doc_id int")
    found = dec.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted((d, 70) for d in (1, 1, 2, 3, 4, 5, 0, 11))
    assert all(r.lcs == 1 for r in found if r.doc_id in (1, 2, 3, 11, None))
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect())[:5] == [6, 7, 8, 9, 10]
    assert dec.contaminated(docs.limit(0), bench).count() == 0 and dec.contaminated(docs, bench.limit(0)).count() == 0
    assert kept.count() == len(rows) - 8 and dec.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench).collect()}
    monkeypatch.setattr(dec, "BLOCK_ITEMS", 25)
    assert {(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench).collect()} == whole


def test_every_verbatim_passage_is_found_and_nothing_else(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    texts = {r.doc_id: dec._of_text(r.text).tobytes() for r in docs.collect()}
    items = {r.item_id: dec._of_text(r.text) for r in bench.collect()}
    truth = {(d, i) for d, t in texts.items() for i, w in items.items() if w.tobytes() in t}
    found = {(r.doc_id, r.item_id): r.lcs for r in dec.contaminated(docs, bench).collect()}
    assert truth and truth <= set(found)
    for doc, item in set(found) - truth:  # paraphrases and cut copies only
        assert found[doc, item] == pytest.approx(max(
            found[doc, item], plain_lcs(items[item].tolist(), np.frombuffer(texts[doc], np.uint64).tolist()) / len(items[item]) - 0.2))


def test_paraphrases_are_found(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    searcher = next(dec._searchers(docs.select("doc_id", "text"), bench))
    random, hosts = np.random.default_rng(0), [dec._of_text(r.text) for r in docs.limit(40).collect()]
    hit = 0
    rows = bench.collect()
    for k, item in enumerate(rows):
        words = [w if random.random() > 0.15 else f"zz{random.integers(1e6)}" for w in item.text.split()]
        text = " ".join(["start"] + [f"h{h % 1000}" for h in hosts[k % 40][:50]] + words + ["the end"])
        data = np.frombuffer(text.lower().encode(), np.uint8)
        hit += any(f[1] == item.item_id for f in searcher.find(data, np.array([0, len(data)])))
    assert hit >= 0.9 * len(rows)


def exhaustive(items, text):
    """Items that some window of their size, with its margins, holds by the longest common subsequence."""
    out = set()
    for i, (words, answer) in items.items():
        reach = dec.window_of(len(words)) * 5 // 4
        for start in range(max(1, len(text) - reach + 1)):
            part = text[start : start + reach]
            lcs = dec.lcs_length(words, part) / len(words)
            if lcs >= dec.SURE_LCS or lcs >= dec.LEAST_LCS and dec.lcs_length(answer, part) >= dec.LEAST_ANSWER * len(answer):
                out.add(i)
                break
    return out


def test_recall_of_common_words_among_rare_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    counts = {}
    for r in docs.limit(300).collect():
        for w in (r.text or "").lower().split():
            if w.isalpha():
                counts[w] = counts.get(w, 0) + 1
    random = np.random.default_rng(5)
    common = np.array(sorted(counts, key=lambda w: (-counts[w], w))[:200])
    texts = {i: " ".join(random.choice(common, random.integers(12, 60))) for i in range(100)}
    items = {i: (dec._of_text(t), dec.answer_of(t)) for i, t in texts.items()}
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    searcher = next(dec._searchers(docs, bench))

    def found(text):
        data = np.frombuffer(text.lower().encode(), np.uint8)
        return {f[1] for f in searcher.find(data, np.array([0, len(data)]))}

    truth = hit = 0
    for i, item in texts.items():
        host = " ".join(f"h{random.integers(1e6)}" for _ in range(70))
        assert i in found(f"{host} {item} {host}") and i in found(item)
        for share in (0.1, 0.2, 0.3):
            text = f"{host} " + " ".join(w if random.random() > share else f"zz{random.integers(1e6)}" for w in item.split()) + f" {host}"
            real, got = exhaustive({i: items[i]}, dec._of_text(text)), found(text)
            truth, hit = truth + len(real), hit + len(real & got)
    assert truth > 150 and hit >= 0.9 * truth


def test_places_of_verbatim_items(spark):
    docs = spark.createDataFrame([(1, f"{FILLER} {ITEM} {ITEM} {FILLER}"), (2, "a a a a a a a a"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(70, ITEM), (71, "a a a a a"), (72, ITEM)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start, r.lcs) for r in dec.contaminated(docs, bench).collect()}
    place = len(dec._of_text(FILLER))
    assert found == {(1, 70, place, 1.0), (1, 72, place, 1.0), (2, 71, 0, 1.0)}


def test_directions_come_from_every_document(spark, monkeypatch):
    """The sums of pairs, and the products for more terms, are those of the windows of all documents, without an id too."""
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in random.integers(0, 12, 70)) for _ in range(5000)]
    docs = spark.createDataFrame([(None if i == 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    n, frequency = dec.document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)) + 1e-3
    terms = np.unique(dec._of_text("w1 w2 w3 w4 w5"))
    plain, entries = np.zeros((5, 5)), 0
    for words in map(dec._of_text, texts):
        for at in range(0, len(words), dec.FIT_WINDOW):
            window = words[at : at + dec.FIT_WINDOW]
            weight = idf[(window % np.uint64(dec.BUCKETS)).astype(int)]
            row = np.array([(weight * (window == t)).sum() for t in terms]) / np.sqrt((weight**2).sum())
            plain, entries = plain + np.outer(row, row), entries + int(np.isin(window, terms).sum())
    gram, seen = dec._paired_gram(docs, terms, idf)
    assert seen == entries and np.allclose(gram, plain, rtol=1e-3)
    fitted = dec.fit_space(docs, [terms], n, frequency).basis
    monkeypatch.setattr(dec, "PAIRED_TERMS", 0)
    assert np.allclose(np.abs(dec.fit_space(docs, [terms], n, frequency).basis[:, 0]), np.abs(fitted[:, 0]), atol=1e-2)


def test_sums_of_pairs_leave_a_task_in_parts():
    """Of 600 terms there are 180,300 pairs; no batch has more than a part of them, and together they are X'X."""
    class Taken:
        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            self.fn = fn
            raise StopIteration

    words = [f"w{i}" for i in range(600)]
    terms, taken = np.unique(dec._of_text(" ".join(words))), Taken()
    with pytest.raises(StopIteration):
        dec._paired_gram(taken, terms, np.ones(dec.BUCKETS))
    random = np.random.default_rng(4)
    texts = [" ".join(random.choice(words, 32)) for _ in range(3000)]
    batches = list(taken.fn(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert max(b.num_rows for b in batches) <= 1 << 16
    space = dec.Space(terms, np.zeros((0, 0)), np.ones(dec.BUCKETS))
    x = np.zeros((len(texts), len(terms)))
    for row, text in enumerate(texts):
        np.add.at(x[row], space.term_of(dec._of_text(text)), 1 / np.sqrt(32))
    half = np.triu(x.T @ x, 1) + np.diag(np.diag(x.T @ x)) / 2
    same = np.concatenate([b.column(1).to_numpy() for b in batches])[1:].sum()
    assert abs(same - half.sum()) < 1e-3 * half.sum()


def test_words_are_hashed_in_stretches(monkeypatch):
    """Hashes are those of the plain polynomial wherever a stretch ends, and cost no arrays of many numbers for each byte."""
    random = np.random.default_rng(8)
    text = " ".join(random.choice(["A", "bc", "Déf", "x" * 100, "word"], 3000)).encode()
    data = np.frombuffer(text, np.uint8)
    _, start, end = common.word_spans(data, np.array([0, len(data)]))
    power = np.cumprod(np.full(100, common._BASE))
    plain = common.mix(np.array([(common._FOLDED[data[a:b]] * power[: b - a]).sum() for a, b in zip(start, end)], np.uint64))
    for stretch in (16, 100, 101, 1 << 15):
        monkeypatch.setattr(common, "HASHED_BYTES", stretch)
        assert (common.word_hashes(data, start, end) == plain).all()
    data = np.tile(data, 40)
    _, start, end = common.word_spans(data, np.array([0, len(data)]))
    tracemalloc.start()
    common.word_hashes(data, start, end)
    assert tracemalloc.get_traced_memory()[1] < 16 * len(data)
    tracemalloc.stop()


def test_windows_are_sums_of_weighted_directions():
    """A slice of many windows is projected without a copy of the directions for each word of each window."""
    random = np.random.default_rng(9)
    names = np.array([f"w{i}" for i in range(300)])
    items = [dec._of_text(" ".join(random.choice(names, 48))) for _ in range(20)]
    terms = np.unique(np.concatenate(items))
    space = dec.Space(terms, random.normal(size=(len(terms), 96)).astype(np.float32), random.random(dec.BUCKETS) + 0.5)
    searcher = dec.Searcher(space, list(range(20)), items, [w[-5:] for w in items])
    h = dec._of_text(" ".join(np.where(random.random(20_000) < 0.7, random.choice(names, 20_000), "unknown")))
    term = searcher.space.term_of(h)
    assert (np.where(term >= 0, terms[term], h) == h).all() and ((term >= 0) == np.isin(h, terms)).all()
    block = np.append(np.arange(0, len(h), 6), len(h))
    begin = np.arange(0, len(block) - 1, 3)
    end = np.minimum(begin + 8, len(block) - 1)
    tracemalloc.start()
    units, long = searcher._windows(block, begin, end, 6, term)
    assert tracemalloc.get_traced_memory()[1] < 4 * 96 * 4 * len(block)
    tracemalloc.stop()
    for i in (0, 7, 500, len(begin) - 1):
        words = h[block[begin[i]] : block[end[i]]]
        known = words[np.isin(words, terms)]
        plain = (space.basis[np.searchsorted(terms, known)] * space.idf[(known % np.uint64(dec.BUCKETS)).astype(int)][:, None]).sum(0)
        assert np.allclose(units[i] * long[i], plain, atol=1e-3)
