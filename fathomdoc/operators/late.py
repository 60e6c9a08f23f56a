"""Joins of wide rows with few or many narrow keys, in which only rows that can match are shuffled.

Keys that were counted to be few are sent to the scan. For more, a bitmap of hashed keys is built by an aggregate and
sent in their place: its size is fixed by a bound, whatever the number of keys. Rows whose bit is not set match
nothing, so their texts stay where they were read; the others are joined by a shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.operators.skew import salted_join
from fathomdoc.session import written

#: Rows of narrow keys that are sent, of a few dozen bytes each.
SENT_ROWS = 400_000
#: Bits for each key, so that about one in sixteen other rows passes, and bits of a bitmap at most: 32 MiB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
#: Fixed value: bits in one row of Spark's bitmap functions.
ROW_BITS = 32_768


def _slot(key: Column, bits: int) -> Column:
    """1 to ``bits``; a null key has a slot too, but joins with nothing."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def key_bitmap(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """(bucket, bitmap) rows of the keys, of which there are about ``count``, and the number of bits.

    Keys are dealt by bucket before they are aggregated, so eight bytes of each are shuffled and no partial bitmap is.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (BITS_PER_KEY * count - 1).bit_length()))
    slots = keys.select(_slot(F.col(key), bits).alias("slot")).withColumn("bucket", F.bitmap_bucket_number("slot"))
    return slots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")), bits


def with_flag(rows: DataFrame, key: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Adds ``_may_match``: whether the row's bit is set. The rows are not shuffled."""
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("bitmap", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    slotted = rows.withColumn("_slot", _slot(F.col(key), bits)).withColumn("bucket", F.bitmap_bucket_number("_slot"))
    bit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1))
    return slotted.join(F.broadcast(bitmap), "bucket", "left").withColumn("_may_match", F.coalesce(bit == 1, F.lit(False))).drop(
        "bucket", "bitmap", "_slot")


def late_join(rows: DataFrame, wanted: DataFrame, key: str, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """``rows`` joined with the narrow ``wanted`` on ``key``, inner or left; with ``salt``, a hot key is spread by it (then
    ``wanted`` has one row per key).

    ``wanted`` is written once and counted. Null keys match nothing; other columns must not share a name, nor be called
    bucket, bitmap, _slot or _may_match.
    """
    wanted = written(wanted, "wanted-keys")
    count = wanted.count()
    if count <= SENT_ROWS:
        return rows.join(F.broadcast(wanted), key, how)
    flagged = with_flag(rows, key, *key_bitmap(wanted, key, count))
    near = flagged.filter("_may_match").drop("_may_match")
    joined = near.join(wanted, key, how) if salt is None else salted_join(near, wanted, [key], how, salt)
    if how == "inner":
        return joined
    far = flagged.filter("NOT _may_match").drop("_may_match")
    return joined.unionByName(far, allowMissingColumns=True)
