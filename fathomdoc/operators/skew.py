"""Building blocks that keep one hot key from filling one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: Column,
                salts: int = 16) -> DataFrame:
    """Equi-join for a left side with hot keys and a right side with one row per key.

    Left rows of one key go to ``salts`` tasks, by ``spread``; the right side is repeated that often.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, on + ["_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on the keys, in which a null key is a key like others."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys])
    return left.join(other, equal).drop(*[f"_right_{k}" for k in keys])


def _stretched(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Adds _stretch; rows without an order have no place and are left out, rows with null keys stay."""
    return df.withColumn("_stretch", F.floor(F.col(order) / width)).filter(F.col("_stretch").isNotNull())


def running_total(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """``name`` = sum of ``value`` over all rows of the key with ``order`` up to this row's (peers included).

    ``order`` is integral; rows where it is null are left out. Rows are windowed per (key, stretch of ``width``); a hot
    key therefore spreads over its stretches, and only one total per stretch is windowed per key.
    """
    stretched = _stretched(df, keys, order, width)
    per_key = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        stretched.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
        .withColumn("_carried", F.coalesce(F.sum("_sum").over(per_key), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return (
        stretched.withColumn(name, F.sum(value).over(inside))
        .transform(null_safe_join, carried, keys + ["_stretch"])
        .withColumn(name, F.col(name) + F.col("_carried"))
        .drop("_stretch", "_carried")
    )


def last_items(df: DataFrame, keys: list[str], order: str, item: Column, n: int, width: int, name: str) -> DataFrame:
    """``name`` = array of the items of the last ``n`` rows of the key up to and including this one; null items are
    rows too, and only left out of the array.

    Rows where the order is null are left out. Windowed per (key, stretch of ``width`` order values); the last items of earlier
    stretches are carried in, at most ``n`` per stretch.
    """
    stretched = _stretched(df, keys, order, width).withColumn("_item", F.struct(item.alias("item")))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order)
    local = (
        stretched.withColumn(name, F.collect_list("_item").over(inside.rowsBetween(1 - n, 0)))
        .withColumn("_last", F.lead(order).over(inside).isNull())
    )
    per_key = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(1 - n, -1)
    carried = (
        local.filter("_last").select(*keys, "_stretch", F.col(name).alias("_tail"))
        .withColumn("_before", F.flatten(F.collect_list("_tail").over(per_key)))
        .drop("_tail")
    )
    joined = F.concat("_before", name)
    cut = F.slice(joined, F.greatest(F.size(joined) - n + 1, F.lit(1)), n)
    return (
        null_safe_join(local, carried, keys + ["_stretch"])
        .withColumn(name, F.array_compact(F.transform(cut, lambda row: row["item"])))
        .drop("_stretch", "_item", "_last", "_before")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str, spread: Column,
                  salts: int = 32) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank.

    Cut to ``n`` per (group, salt) first, so that the last cut sees at most ``n * salts`` rows of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= n).drop("_salt")
        .withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= n)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenation by column name; columns missing somewhere become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
