"""Time as microseconds."""

from pyspark.sql import Column, DataFrame, functions as F, types as T


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. Times without a zone are counted as written, whatever the session's zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        time = F.col(ts)
        seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return F.unix_micros(F.col(ts).cast("timestamp"))
