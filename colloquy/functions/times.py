"""Time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end with their fraction, as a double."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), _col(ts))


def in_days(ts: Column | str, first: str, last: str) -> Column:
    """True when ts falls on a date from first to last, both included.

    Written on the raw column, so that parquet and JDBC scans can use it.
    """
    begin = F.to_date(F.lit(first)).cast("timestamp_ntz")
    end = F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp_ntz")
    return (_col(ts) >= begin) & (_col(ts) < end)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
