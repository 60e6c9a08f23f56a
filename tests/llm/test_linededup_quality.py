import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomdoc.llm import linededup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows):
    """All pairs of distinct lines, by the edit distance over words, or characters if both have under five words."""
    def one_edit(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return row[-1] <= 1

    lines = [((d if d is not None else linededup._LAST, i), tuple(WORD.findall(x.lower())))
             for d, text in rows if text is not None for i, x in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[1]]
    first = {}
    for place, words in lines:
        first[words] = min(place, first.get(words, place))

    def close(v, w):
        if (len(v) < 5) != (len(w) < 5):
            return False
        v, w = (" ".join(v), " ".join(w)) if len(v) < 5 else (v, w)
        return min(len(v), len(w)) >= 5 and one_edit(v, w)

    near = {w: min((p for v, p in first.items() if p < first[w] and close(w, v)), default=None) for w in first}
    out = []
    for place, words in lines:
        if place > first[words] or near[words]:
            named = min(first[words], near[words] or first[words])
            out.append((*place, *named, int(named != first[words])))
    return sorted(out)


def found_lines(frame):
    last = linededup._LAST
    return sorted((last if r[0] is None else r[0], r[1], last if r[2] is None else r[2], r[3], r[4])
                  for r in linededup.repeated_lines(frame).collect())


def line_rows(seed):
    random = np.random.default_rng(seed)
    base = [[f"v{x}" for x in random.integers(0, 9 if k % 3 == 0 else 60, n)] for k, n in enumerate([1, 3, 4, 5, 6, 9, 10, 11, 12, 14, 30, 60])]
    base.append(["".join(chr(0x4E00 + x) for x in random.integers(0, 40, 70))])
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(5):
            words = list(base[random.integers(len(base))])
            at, kind = random.integers(0, len(words)), random.integers(0, 6)
            if kind == 0:
                words[at] = f"n{random.integers(0, 4)}"
            elif kind == 1:
                del words[at]
            elif kind == 2:
                words.insert(at, f"n{random.integers(0, 4)}")
            elif kind == 3:
                words[at] = "zz"
                words[(at + 3) % len(words)] = "yy"
            lines.append((" " if kind else "\t").join(w.upper() if kind == 4 else w for w in words))
        rows.append((doc, "\n".join([*lines, "", "  "])))
    return rows + [(100, None), (101, ""), (102, "x"), (None, "x\n" + " ".join(base[7])), (5, rows[5][1]),
                   (103, "For " * 40), (104, "For " * 41), (105, "For " * 39), (106, "w " * 200_000 + "\n" + "w " * 200_001)]


def test_short_lines_and_lines_without_blanks(spark):
    nine = "the cat sat on a mat in the sun"
    han = "".join(chr(0x4E00 + i * 7 % 300) for i in range(63))
    emoji = "\U0001F600\U0001F601\U0001F602\U0001F603\U0001F604"
    texts = [nine, nine.replace("mat", "rug"), nine + " today", nine + " today now", "a b c d", "a b c e", "one two three four five", "one two three four",
             han, han[:20] + "x" + han[21:], han[:30] + han[31:], han + "yz", han + "y", emoji, emoji[:2] + "z" + emoji[3:], "abcd", "abce", "abcde",
             "a b c d e", "\U0001F605" * 300_000, "\U0001F605" * 299_999 + "q"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = found_lines(frame)
    assert [r for r in found if r[0] < 19] == brute_lines(rows[:19]) and [r for r in found if r[0] >= 19] == [(20, 0, 19, 0, 1)]
    assert {r[0] for r in found} == {1, 2, 3, 5, 9, 10, 12, 14, 20}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_all_pairs(spark, seed):
    rows = line_rows(seed)
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, line_no int, h string").repartition(3)
    small = [r for r in rows if r[0] != 106]
    expected = brute_lines(small)
    found = found_lines(frame)
    assert [r for r in found if r[0] != 106] == expected
    assert [r for r in found if r[0] == 106] == [(106, 1, 106, 0, 1)]


def test_texts_without_their_repeated_lines(spark):
    rows = [(1, "one\ntwo\n\none", "x", 12), (2, "two", "x", 3), (3, "three\nTWO \n--", "x", 12), (4, None, "x", None), (5, "", "x", 0),
            (None, "one\nfour", "x", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_chars long")
    out = linededup.without_repeated_lines(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id or 99, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [
        (1, "one\ntwo\n", 8), (3, "three\n--", 8), (5, "", 0), (99, "four", 4)]
    assert out.count() == 5 and linededup.without_repeated_lines(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [(1, "one\ntwo"), (None, "one\nfive"), (None, "six\nseven"), (None, "eight\nseven"), (None, "nine\nten"), (None, "nine\nten"),
            (4, "two\neleven"), (4, "twelve\nthirteen"), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((r.doc_id or 99, r.text) for r in linededup.without_repeated_lines(frame).collect() if r.text)
    seven = [(99, "eight"), (99, "six\nseven")], [(99, "eight\nseven"), (99, "six")]
    assert [x for x in out if "six" not in x[1] and "eight" not in x[1]] == [
        (1, "one\ntwo"), (4, "eleven"), (4, "twelve\nthirteen"), (99, "five"), (99, "nine\nten")]
    assert [x for x in out if "six" in x[1] or "eight" in x[1]] in seven
    assert linededup.without_repeated_lines(frame).count() == 9
    found = [tuple(r) for r in linededup.repeated_lines(frame).collect()]
    assert sorted(x[1:] for x in found if x[0] is None and x[2] is None) == [(0, None, 0, 0), (1, None, 1, 0), (1, None, 1, 0)]
    assert {x for x in found if x[2] is not None} == {(None, 0, 1, 0, 0), (4, 0, 1, 1, 0)}


def test_quality_against_plain_counts(spark):
    clean = [(i, " ".join(f"the word{(i * j) % 97} of a house{j % 13} and" for j in range(60)), "en", "k") for i in range(1, 40)]
    odd = [(100, None, "en", ""), (101, "", None, ""), (102, "a b c a b c a b c x", "en", ""), (103, "x\nx\n \n\ny\nx ", "rare", ""),
           (104, "#tag $$ <b> |", None, ""), (105, "é \x0b\x0c ü\tß", "en", ""), (106, "w" * 300_000, "en", ""), (107, "p q " * 50_000, "en", ""),
           (108, " ".join("x%$" * 3 for _ in range(100)), "en", ""), (None, clean[0][1], "en", ""), (1, clean[0][1], "en", "")]
    rows = clean + odd
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    found = quality.quality_rules(frame).collect()
    expected = Counter()
    for doc, text, _, _ in rows:
        words = WORD.findall(text or "")
        three = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected[doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                 len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        assert not (r.kept and r.base_failed)
        assert (r.char_distance is None) == (r.word_chars == 0 or len(next(t for d, t, _, _ in rows if d == r.doc_id)) < quality.LEAST_CHARS)
    assert all(r.kept for d, rs in by_doc.items() if d is not None and d < 40 and not rs[0].base_failed for r in rs)
    assert not by_doc[108][0].kept and by_doc[108][0].char_distance > quality.MOST_CHAR_DISTANCE
    assert quality.quality_rules(frame.limit(0)).count() == 0
    assert quality.quality_rules(frame.filter(F.col("doc_id").isin(100, 101))).filter("kept").count() == 0


def test_rare_languages_have_references_of_their_own(spark):
    def clean(words, i):
        return " ".join(words[(i * 7 + j * j) % len(words)] + chr(97 + j % 20) for j in range(120))

    english, hindi = ["the", "water", "house", "and"], ["पानी", "घरमें", "औरवह", "नदीके"]
    rows = [(i, clean(english, i), "en") for i in range(4000)]
    rows += [(10_000 + i, clean(hindi, i), "hi") for i in range(12)] + [(20_000 + i, clean(["вода", "домик", "река"], i), "ru") for i in range(8)]
    rows += [(30_000, clean(hindi, 1), None), (30_001, clean(hindi, 1), "xx"), (30_002, clean(english, 1), "hi")]
    found = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(found) == len(rows)
    for doc in [*range(10_000, 10_012), *range(20_000, 20_008)]:
        assert found[doc].char_distance is not None and found[doc].char_distance <= quality.MOST_CHAR_DISTANCE
    for doc in (30_000, 30_001):
        assert found[doc].char_distance is None and found[doc].word_distance is None and found[doc].kept != found[doc].base_failed
    assert found[30_002].char_distance > quality.MOST_CHAR_DISTANCE


def test_distance_is_jensen_shannons(spark):
    random = np.random.default_rng(1)
    p, q = random.dirichlet(np.ones(5), 2)
    p[2] = 0
    p /= p.sum()
    m = (p + q) / 2
    expected = np.sqrt(sum(0.5 * x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0))
    frame = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    twice = F.aggregate(F.zip_with("p", "q", quality._divergence), F.lit(0.0), lambda a, b: a + b)
    assert frame.select(quality._distance(twice)).first()[0] == pytest.approx(expected, abs=1e-6)


def test_quality_sql_with_rare_and_missing_languages(spark, tmp_path):
    import duckdb

    from fathomdoc.llm import queries

    random = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "oro", "ist")]
    hindi = ["\u0915\u0932", "\u0918\u0930", "\u092e\u0928", "\u091c\u0932", "\u0926\u093f\u0928"]
    text = lambda some, n: " ".join(random.choice(some, n))
    rows = [(i, text(words, int(random.integers(20, 200))), "en") for i in range(600)]
    rows += [(1000 + i, text(hindi, 400), "hi") for i in range(2)] + [(1010, text(hindi, 300), "xx"), (1011, text(hindi, 300), None),
             (1012, text(words, 150), ""), (1013, None, "en"), (1014, text(hindi, 1200), "yy")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op1_divergence_quality"](spark, str(tmp_path))
    names = found.columns
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = own.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op1_divergence_quality']})").fetchall()
    as_text = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(as_text, map(tuple, found.collect())), key=str) == sorted(map(as_text, expected), key=str)
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1010].char_distance is None and by_id[1011].word_distance is None and by_id[1014].word_distance is not None
