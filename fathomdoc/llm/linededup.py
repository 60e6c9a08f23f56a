"""Removal of repeated lines, also of lines that differ in one word, by a deletion-neighbourhood join.

An edit is one unit replaced, left out or put in. The unit is a word for lines of five words or more. (A line of 300
characters has 300 variants with a character less, but about 50 with a word less, and a word may differ in any number
of characters.) It is a character of the line, its words joined by one blank, for lines of fewer words, such as text
in scripts without blanks; lines of fewer than five characters have no edit. So an edit is a fifth of a line at most.

Equal lines are first grouped into classes. Short lines, which have few variants, are all expanded. Of the longer ones,
those that share their first or last few units with another are: two lines one edit apart always share one of these,
so the others have no partner. Each emits hashed keys of all its variants with one unit less. Lines that differ by a
replaced unit have the same variant at the same place; a line that lacks a unit of another is itself a variant of it.
Partners are compared unit by unit, and a line goes if any earlier line, kept or not, is equal to it or within the
bound. Columns only: no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.llm.common import columns_of, written
from fathomdoc.session import once

BLANKS, HAS_WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Lines of fewer words are compared by characters; of fewer characters, they go only if equal to an earlier one.
LEAST = 5
#: Words, or characters, at both ends that are compared first; lines of up to twice as many are expanded without that.
EDGE_WORDS, EDGE_CHARACTERS = 5, 32
#: A table of keys is sent to all executors only if it was counted and has no more rows, of 40 bytes at most.
SENT_ROWS = 400_000
#: Hashes are added modulo this prime, so that no line is too long for the sum.
_MODULUS = (1 << 61) - 1
_LAST = (1 << 63) - 1
#: A line's place, in the order in which one is earlier.
PLACE = ["doc_id", "line_no", "text_id"]


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), BLANKS), "")


def _identified(documents: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, text_id, copy, text) and others: an id and a text make a row, so rows that repeat an id stay apart.

    A null id comes after all others. Of the rows without an id that have the same text, all but one are a ``copy``;
    they are numbered in a table, as nothing else tells them apart.
    """
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"), *others)
    named = rows.withColumns({"text_id": F.xxhash64("text"), "copy": F.lit(False)})
    nameless = named.filter("doc_id IS NULL")
    if not nameless.isEmpty():
        nameless = written(nameless.withColumn("number", F.monotonically_increasing_id()), "rows-without-id")
        first = nameless.groupBy("text_id").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("is_first"))
        nameless = nameless.join(first, "number", "left").withColumn("copy", F.col("is_first").isNull())
        named = named.filter("doc_id IS NOT NULL").union(nameless.select(*named.columns))
    return named.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, text_id, copy, line): every line of identified rows that has a word."""
    return rows.select("doc_id", "text_id", "copy", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(
        F.col("line").rlike(HAS_WORD)).select("doc_id", "line_no", "text_id", "copy", "line")


def _by_word() -> Column:
    return F.size("words") >= LEAST


def _units() -> Column:
    """What an edit changes one of: the words, or the characters of a line of few words."""
    return F.when(_by_word(), F.col("words")).otherwise(F.split(F.array_join("words", " "), ""))


def _hashed(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text_id, copy, h, h2, head, tail, short): hashes of a line's words, of the ends of a longer line,
    and the words of a short one.

    A line of just twice the length of an end has all: its partner with a unit less is short, that with one more is not.
    """
    step = once(lines, words=_words(F.col("line"))).drop("line")
    step = once(step, units=_units(), edge=F.when(_by_word(), F.lit(EDGE_WORDS)).otherwise(EDGE_CHARACTERS))
    n, edge = F.size("units"), F.col("edge")
    longer = n >= 2 * edge
    return step.select(
        "doc_id", "line_no", "text_id", "copy", F.xxhash64("words").alias("h"), F.xxhash64("words", F.lit(1)).alias("h2"),
        F.when(longer, F.xxhash64(F.slice("units", F.lit(1), edge), edge, F.lit("head"))).alias("head"),
        F.when(longer, F.xxhash64(F.slice("units", n - edge + 1, edge), edge, F.lit("tail"))).alias("tail"),
        F.when(n.between(LEAST, 2 * edge), F.array_join("words", " ")).alias("short"))


def _bounded(keys: DataFrame, name: str) -> DataFrame:
    """The keys, written; with the hint to send them if they are few enough, and else for a join by shuffle."""
    table = written(keys, name)
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _place(*names: str) -> Column:
    return F.struct(*names)


def _reduced(value: Column) -> Column:
    return F.pmod(value, F.lit(_MODULUS))


def _part(*columns: Column) -> Column:
    return _reduced(F.xxhash64(*columns))


def _unit(i: Column) -> Column:
    """Hash of the i-th unit; beyond both ends there is none, which hashes alike everywhere."""
    return F.coalesce(F.when(i >= 0, F.get("t", i)), F.lit(0).cast("long"))


def _variants(lines: DataFrame) -> DataFrame:
    """Adds the keys of a line: ``own``, and ``variants`` (key of a replacement at a place, key of the shorter line).

    The sum over units and places, less one unit, is the key of a replacement there. The sum over neighbouring pairs
    is a line's own key; a unit less takes two pairs away and puts one in. The ends that a line shares with others say
    where an edit can be: if no other line has its head, only there, and so with the tail. Words and characters hash
    differently, so lines of either kind never meet.
    """
    summed = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, b: _reduced(a + b))
    step = once(lines, t=F.transform("units", lambda u: F.xxhash64(u, "edge")), n=F.size("units"))
    step = once(step, placed=F.transform("t", lambda t, i: _part(t, i)),
                pairs=F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: _part(_unit(i - 1), _unit(i)))).drop("units")
    step = once(step, by_place=summed("placed"), by_pair=summed("pairs"))
    first = F.when(F.col("tail_shared"), F.lit(0)).otherwise(F.col("n") - F.col("edge") - 1)
    last = F.when(F.col("head_shared"), F.col("n") - 1).otherwise(F.least(F.col("edge"), F.col("n") - 1))

    def variant(i: Column) -> Column:
        pairs = _reduced(F.col("by_pair") - F.get("pairs", i)) - F.get("pairs", i + 1)
        return F.struct(F.xxhash64("n", i, _reduced(F.col("by_place") - F.get("placed", i))).alias("same"),
                        F.xxhash64(F.col("n") - 1, _reduced(_reduced(pairs) + _part(_unit(i - 1), _unit(i + 1)))).alias("shorter"))

    return once(step, own=F.xxhash64("n", "by_pair"), variants=F.transform(F.sequence(F.greatest(first, F.lit(0)), last), variant)).select(
        "h", *PLACE, "own", "variants")


def _one_edit(x: Column, y: Column) -> Column:
    """Arrays that differ by at most one replaced, left out or added unit: equal beginnings and ends meet."""
    def equal(a: Column, b: Column) -> Column:
        different = F.array_position(F.zip_with(a, b, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(different == 0, F.size(a)).otherwise(different - 1)

    longest = F.greatest(F.size(x), F.size(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (equal(x, y) + equal(F.reverse(x), F.reverse(y)) >= longest - 1)


def _near(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, near): of each class with an earlier class one edit apart, the earliest place of such a class."""
    ends = classes.filter("head IS NOT NULL").select(F.explode(F.array("head", "tail")).alias("edge"))
    shared = _bounded(ends.groupBy("edge").agg(F.count("*").alias("n")).filter("n > 1").select("edge"), "shared-edges")
    flagged = classes.filter("head IS NOT NULL AND short IS NULL").select("h", *PLACE, "head", "tail")
    for side in ("head", "tail"):
        flagged = flagged.join(shared.withColumnRenamed("edge", side).withColumn(f"{side}_shared", F.lit(True)), side, "left")
    flagged = flagged.filter("head_shared OR tail_shared").select(
        "h", *PLACE, F.coalesce("head_shared", F.lit(False)).alias("head_shared"),
        F.coalesce("tail_shared", F.lit(False)).alias("tail_shared"))
    wanted = _bounded(flagged, "flagged-lines")
    worded = _lines(rows).drop("copy").join(wanted, PLACE).withColumn("words", _words(F.col("line"))).drop("line")
    longer = worded.filter(F.xxhash64("words") == F.col("h")).dropDuplicates(["h"])
    short = classes.filter("short IS NOT NULL").select(
        *PLACE, "h", F.lit(True).alias("head_shared"), F.lit(True).alias("tail_shared"), F.split("short", " ").alias("words"))
    lines = written(longer.unionByName(short).withColumns(
        {"units": _units(), "edge": F.when(_by_word(), F.lit(EDGE_WORDS)).otherwise(EDGE_CHARACTERS)}).drop("words"), "lines-in-units")

    keyed = written(_variants(lines), "line-variants")
    emitted = keyed.select("h", *PLACE, F.explode("variants").alias("v"))
    # Lines with the same key at the same place are one edit apart from each other, so the earliest stands for all.
    several = _bounded(emitted.groupBy(F.col("v.same").alias("same")).agg(F.count("*").alias("n")).filter("n > 1").select("same"), "variant-keys")
    alike = written(emitted.select("h", *PLACE, "v.same").join(several, "same"), "lines-alike")
    earliest = alike.groupBy("same").agg(F.min(_place(*PLACE, "h")).alias("first"))
    replaced = alike.join(earliest, "same").filter(_place(*PLACE, "h") > F.col("first")).select(
        F.col("h").alias("later"), F.col("first.h").alias("earlier"))
    shorter = _bounded(keyed.select(F.col("h").alias("short_h"), F.col("doc_id").alias("short_doc"), F.col("line_no").alias("short_line"),
                                   F.col("text_id").alias("short_text"), "own"), "own-keys")
    met = emitted.select("h", *PLACE, F.col("v.shorter").alias("own")).join(shorter, "own")
    long, short = _place(*PLACE, "h"), F.struct(
        F.col("short_doc").alias("doc_id"), F.col("short_line").alias("line_no"), F.col("short_text").alias("text_id"), F.col("short_h").alias("h"))
    lacking = met.select(F.greatest(long, short)["h"].alias("later"), F.least(long, short)["h"].alias("earlier"))
    pairs = replaced.union(lacking).filter("later <> earlier").distinct()
    units = lines.select("h", *PLACE, "units")
    checked = (pairs.join(units.select(F.col("h").alias("later"), F.col("units").alias("x")), "later")
               .join(units.select(F.col("h").alias("earlier"), F.col("units").alias("y"), *PLACE), "earlier")
               .filter(_one_edit(F.col("x"), F.col("y"))))
    return checked.groupBy(F.col("later").alias("h")).agg(F.min(_place(*PLACE)).alias("near"))


def _repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, text_id, copy, first, edits): the repeated lines of identified rows, and the place of the first."""
    hashed = written(_hashed(_lines(rows)), "line-hashes")
    # Grouping keeps one row per class and task before the shuffle, however often a line occurs.
    classes = written(hashed.groupBy("h", "h2").agg(
        F.min(_place(*PLACE)).alias("first"), F.max(_place(*PLACE)).alias("last"), F.max("copy").alias("copied"),
        F.max("head").alias("head"), F.max("tail").alias("tail"), F.max("short").alias("short")).select(
            "h", "h2", "first.*", "head", "tail", "short", ((F.col("first") < F.col("last")) | F.col("copied")).alias("again")), "line-classes")
    touched = (classes.join(_near(rows, classes), "h", "left").filter("again OR near IS NOT NULL")
               .select("h", "h2", _place(*PLACE).alias("first"), "near"))
    return (hashed.select(*PLACE, "copy", "h", "h2").join(touched, ["h", "h2"])
            .filter((_place(*PLACE) > F.col("first")) | F.col("near").isNotNull() | F.col("copy"))
            .select(*PLACE, "copy", F.least("first", "near").alias("first"),
                    F.when(F.least("first", "near") == F.col("first"), 0).otherwise(1).alias("edits")))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, edits): every line of (doc_id, text) that an earlier line repeats.

    Lines end at \\n and are numbered from 0; their words are compared in lower case, white space does not count,
    and lines without words never repeat. Lines of both five words or more are one edit apart by words, lines of
    both fewer by characters if they have five. Earlier means a smaller (doc_id, line_no), null ids last, and
    between different texts of one id (or of none) a smaller hash of the text; the earliest line that is equal or
    one edit away is named, with ``edits`` 0 if the words are equal. Rows that repeat id and text are the same
    place, and neither is earlier; rows without an id that repeat a text are copies of the first. Null texts have no
    lines; other columns are ignored. Texts and lines are used whole.
    """
    return _repeated(_identified(documents)).select(
        F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "line_no", F.nullif(F.col("first.doc_id"), F.lit(_LAST)).alias("first_doc_id"),
        F.col("first.line_no").alias("first_line_no"), "edits")


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the lines of ``repeated_lines`` taken out of ``text``, and ``n_chars``, if there is such a
    column, counted anew. A document that had words and lost all its lines with words is dropped. Lines are taken only
    from the row they were found in, also where ids are null or repeat."""
    # The row travels as one column, so that none of its names can clash.
    rows = _identified(documents, F.struct(*documents.columns).alias("row"))
    key = ["doc_id", "text_id", "copy"]
    gone = _repeated(rows).groupBy(*key).agg(F.collect_set("line_no").alias("gone"))
    met = rows.drop("text").join(gone, key, "left")
    parts = once(met, parts=F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    text = once(parts, text=F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(numbers, lambda i: F.get("parts", i)), "\n")))
    left = text.filter(F.col("gone").isNull() | F.col("text").rlike(HAS_WORD))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(documents.dtypes).get("n_chars", "long"))}
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
