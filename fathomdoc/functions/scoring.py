"""Distance, similarity and lexical score functions."""

from pyspark.sql import Column, functions as F

from fathomdoc.functions import text as X
from fathomdoc.functions.payload import let


def squared_l2(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def similarity_percent(distance: Column, index: Column, zero_distance_quirk: bool = True) -> Column:
    """Percent from a squared distance between unit vectors; ``index`` is the 0-based rank.

    With the quirk, a distance of exactly 0 scores by rank alone (90, 80, ... 50).
    """
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - distance / 2) * 100))
    if not zero_distance_quirk:
        return percent
    return F.when(distance == 0, F.greatest(F.lit(50.0), 90.0 - index * 10)).otherwise(percent)


def lexical_score(query: Column, content: Column, index: Column) -> Column:
    """Word overlap score of a passage at 0-based rank ``index``, one decimal."""
    # Bound once per row: inside the inner lambda the query would be split again for every word.
    wanted = X.keywords(query)
    bound = F.struct(F.array_distinct(wanted).alias("set"), F.size(wanted).alias("n"), X.words(content).alias("words"))
    ratio = let(bound, lambda b: F.when(b["n"] > 0, F.size(
        F.filter(b["words"], lambda w: F.array_contains(b["set"], w))) / b["n"]).otherwise(0.0))
    overlap = ratio * 60 + 30 - index * 3 + (F.length(content) % 10 - 5)
    score = (
        F.when((F.coalesce(F.length(query), F.lit(0)) == 0) | (F.coalesce(F.length(content), F.lit(0)) == 0),
               85.0 - index * 5)
        .when(F.contains(F.lower(content), F.lower(query)), F.greatest(F.lit(85.0), 90.0 - index * 2))
        .otherwise(F.greatest(F.lit(25.0), F.least(F.lit(95.0), overlap)))
    )
    return F.round(score, 1)


def display_score(similarity: Column, query: Column, content: Column, index: Column) -> Column:
    """A positive similarity to one decimal, else the lexical score."""
    return F.when(similarity > 0, F.round(similarity, 1)).otherwise(lexical_score(query, content, index))


def retry_after(oldest_us: Column, now_us: Column, window_seconds: int, round_up: bool) -> Column:
    """Seconds until the oldest retained request leaves the window; null where none is retained.

    The whole-service rule cuts the fraction off; the per-client rule (``round_up``) adds one.
    """
    left = oldest_us + window_seconds * 1_000_000 - now_us
    # truncation towards zero, as int() does
    seconds = (left / 1_000_000).cast("bigint")
    rounded = seconds + 1 if round_up else seconds
    return F.when(oldest_us.isNotNull(), F.greatest(F.lit(0), rounded)).cast("bigint")
