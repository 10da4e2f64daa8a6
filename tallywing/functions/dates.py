"""Date parts as text. All work on timestamps of either kind and on ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(ts: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`; cut from the cast so that no time zone is involved."""
    return F.substring(ts.cast("string"), 1, 19)


def month_of(ts: Column) -> Column:
    return F.lpad(F.month(ts).cast("string"), 2, "0")


def year_of(ts: Column) -> Column:
    return F.lpad(F.year(ts).cast("string"), 4, "0")


def year_month(ts: Column) -> Column:
    return F.concat_ws("-", year_of(ts), month_of(ts))


def day_of(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def in_month(ts: Column, year: int, month: int) -> Column:
    """A range test rather than a date-part test, so that files and partitions can be skipped."""
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    lo = F.lit(f"{year:04d}-{month:02d}-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{nxt[0]:04d}-{nxt[1]:02d}-01 00:00:00").cast("timestamp_ntz")
    return (ts >= lo) & (ts < hi)
