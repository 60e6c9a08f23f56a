"""Quality rules from divergence: a document's character classes and common words against those of its language.

The references are histograms over all documents of a language: seven classes of characters, and the words that make
up at least ``COMMON_SHARE`` of its words (with one bin for all others). The distance is Jensen-Shannon's, between 0
and 1. Short documents are too small a sample to be judged, so each histogram has a least size. Columns only: no
Python runs on the executors, and no row leaves its task except for counts.
"""

from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.llm.common import written
from fathomdoc.session import once

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A word of this share is common, so a language has at most 200.
COMMON_SHARE = 0.005
#: References are sent to all executors only if they were counted and are no more; else they are joined by shuffle.
SENT_REFERENCES = 1000
BUCKETS = 4096
#: Repeated windows of a text up to which each place is looked up among them; the result is the same either way.
FEW = 64
#: Sizes from which a histogram is judged, and distances up to which a document is kept.
LEAST_CHARS, LEAST_COMMON = 400, 100
#: Characters and words of all documents of a language from which it is a reference.
REFERENCE_CHARS, REFERENCE_WORDS = 10 * LEAST_CHARS, 10 * LEAST_COMMON
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.3
CLASSES = ["lower", "upper", "foreign", "digit", "blank", "symbol", "other"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _without(text: Column, pattern: str) -> Column:
    """Characters that are left when all runs of the pattern are gone."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that occur twice or more in the text.

    The windows' hashes are sorted; equal neighbours are repeated windows. If these are few, each place is looked up
    among them, else the hashes are sorted once more with their places. The steps between the places of repeated
    windows, at most three, are the words they cover. 64-bit hashes stand for windows.
    """
    hashed = once(docs, h=F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>")))
    ordered = once(hashed, o=F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).otherwise(F.array().cast("array<long>")))
    twice = once(ordered, d=F.array_distinct(F.filter("o", lambda x, i: x == F.get("o", i - 1)))).drop("o")
    few = F.size("d") <= FEW
    sorted_ = once(twice, s=F.when(~few, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def same(e: Column, i: Column) -> Column:
        return F.coalesce(F.get("s", i)["h"] == e["h"], F.lit(False))

    places = once(sorted_, q=F.when(F.size("d") == 0, F.array().cast("array<int>")).when(few, F.filter(
        F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("d", F.get("h", i)))).otherwise(
            F.sort_array(F.transform(F.filter("s", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))))
    return places.withColumn("n_repeat_words", F.aggregate(
        F.transform("q", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("q", i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, b: a + b).cast("long")).drop("h", "d", "s", "q")


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of twice the divergence, in bits."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return part(p, q) + part(q, p)


def _distance(twice: Column) -> Column:
    return F.round(F.sqrt(F.greatest(F.lit(0.0), twice / 2)), 6)


def _bounded(table: DataFrame, most: float) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _common_words(exploded: DataFrame) -> DataFrame:
    """(ref, names, shares): the common words of each reference, commonest first; the share of all others comes first.

    Words are counted by hash bucket first; a common word lies in a bucket as heavy as itself, so only the words of
    these few buckets are then counted one by one.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    buckets = written(exploded.groupBy("ref", bucket.alias("bucket")).agg(F.count("*").alias("n")), "word-buckets")
    totals = buckets.groupBy("ref").agg(F.sum("n").alias("total")).filter(F.col("total") >= REFERENCE_WORDS)
    heavy = buckets.join(totals, "ref").filter(F.col("n") >= COMMON_SHARE * F.col("total")).select("ref", "bucket", "total")
    # At most 1 / COMMON_SHARE buckets of each reference are heavy.
    counted = (exploded.withColumn("bucket", bucket).join(_bounded(written(heavy, "heavy-buckets"), SENT_REFERENCES / COMMON_SHARE), ["ref", "bucket"])
               .groupBy("ref", "word").agg(F.count("*").alias("n"), F.max("total").alias("total"))
               .filter(F.col("n") >= COMMON_SHARE * F.col("total")))
    share = F.col("n") / F.col("total")
    lists = counted.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct((-share).alias("less"), "word"))).alias("found"))
    return totals.select("ref").join(lists, "ref", "left").select(
        "ref", F.coalesce(F.col("found.word"), F.array().cast("array<string>")).alias("names"),
        F.coalesce(F.transform("found.less", lambda x: -x), F.array().cast("array<double>")).alias("shares")).withColumn(
        "shares", F.concat(F.array(1 - F.aggregate("shares", F.lit(0.0), lambda a, b: a + b)), "shares"))


def quality_rules(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
    kept) for each row of (doc_id, text, lang); other columns are ignored.

    A document is kept unless the base rules fail it (fewer than 50 words, or more than half of them in repeated
    windows), its characters are ``LEAST_CHARS`` or more and too far from its language, or its words ``LEAST_COMMON`` or
    more and too far. Distances of documents below these sizes are null. Every language is its own reference, however
    rare; documents without a language, and those whose language has fewer than ``REFERENCE_CHARS`` characters or
    ``REFERENCE_WORDS`` words in all, have null distances. Null text is empty. Repeated rows are judged each. A table
    without words gives no distances.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                            F.nullif(F.col("lang").cast("string"), F.lit("")).alias("ref"))

    exploded = rows.filter("ref IS NOT NULL").select("ref", F.explode(_words(F.lower("text"))).alias("word"))
    common = written(_common_words(exploded), "common-words")

    ascii_, letters, upper = (_without(F.col("text"), p) for p in (r"[^A-Za-z]+", r"\P{L}+", r"[^\p{Lu}]+"))
    counted = once(
        rows, words=_words(F.col("text")), low=_words(F.lower("text")),
        chars=F.length("text").cast("long"), ascii=ascii_, letters=letters, upper=upper,
        n_symbols=F.regexp_count("text", F.lit(SYMBOLS)).cast("long"), digit=F.regexp_count("text", F.lit("[0-9]")).cast("long"),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).drop("text")
    counted = once(counted, word_chars=F.length(F.array_join("words", "")).cast("long"), n_words=F.size("words").cast("long"),
                   n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    counted = _repeated(counted).drop("words")
    blank = F.col("chars") - F.col("word_chars")
    other = F.col("chars") - F.col("letters") - F.col("digit") - blank - F.col("n_symbols")
    bins = F.array(F.greatest(F.col("ascii") - F.least("upper", "ascii"), F.lit(0)), F.least("upper", "ascii"),
                   F.col("letters") - F.col("ascii"), F.col("digit"), blank, F.col("n_symbols"), other)
    met = counted.join(_bounded(common, SENT_REFERENCES), "ref", "left")
    placed = once(met, bins=bins, k=F.when(F.size("low") >= LEAST_COMMON, F.sort_array(
        F.transform("low", lambda w: F.array_position("names", w))))).drop("low", "names")
    starts = once(placed, b=F.when(F.col("n_words") >= LEAST_COMMON, F.filter(
        F.sequence(F.lit(0), F.size("k") - 1), lambda i: F.coalesce(F.get("k", i) != F.get("k", i - 1), F.lit(True)))).otherwise(
            F.array().cast("array<int>")))
    runs = F.transform("b", lambda s, i: F.struct(
        ((F.coalesce(F.get("b", i + 1), F.size("k")) - s) / F.size("k")).alias("p"), F.get("shares", F.get("k", s).cast("int")).alias("q")))
    seen = once(starts, runs=runs)
    sums = F.aggregate("runs", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, r: F.struct(
        (a["d"] + _divergence(r["p"], r["q"])).alias("d"), (a["q"] + r["q"]).alias("q")))
    facts = written(once(seen, sums=sums).select(
        "doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "bins",
        F.when((F.col("n_words") >= LEAST_COMMON) & F.col("shares").isNotNull(), _distance(F.col("sums.d") + F.greatest(F.lit(0.0), 1 - F.col("sums.q")))).alias("word_distance")),
        "quality-facts")

    classes = facts.filter("ref IS NOT NULL").groupBy("ref").agg(*[F.sum(F.get("bins", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)],
                                       F.sum("chars").alias("all_chars")).filter(F.col("all_chars") >= REFERENCE_CHARS)
    reference = classes.select("ref", F.array(*[F.col(c) / F.greatest("all_chars", F.lit(1)) for c in CLASSES]).alias("expected"))
    char = F.aggregate(F.zip_with("bins", "expected", lambda n, q: _divergence(n / F.greatest("chars", F.lit(1)), q)), F.lit(0.0), lambda a, b: a + b)
    judged = facts.join(_bounded(written(reference, "references"), SENT_REFERENCES), "ref", "left").withColumn(
        "char_distance", F.when((F.col("chars") >= LEAST_CHARS) & F.col("expected").isNotNull(), _distance(char)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    near = (F.coalesce(F.col("char_distance") <= MOST_CHAR_DISTANCE, F.lit(True))
            & F.coalesce(F.col("word_distance") <= MOST_WORD_DISTANCE, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), "char_distance", "word_distance", (~failed & near).alias("kept"))
