"""Times as numbers, independent of the session time zone for types that carry none."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def epoch_micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00; a timestamp without time zone and a date are read as UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long") * 86_400_000_000
    since = (value - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")
