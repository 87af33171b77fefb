"""Month and day buckets, in UTC whatever the time zone of the session.

Parsing is strict: an impossible month or day gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def utc_date(ts: Column) -> Column:
    """Calendar date of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / DAY).cast("int"))


def utc_year(ts: Column) -> Column:
    return F.year(utc_date(ts))


def utc_start(date: Column) -> Column:
    """Midnight of a calendar date."""
    return F.timestamp_seconds(F.unix_date(date).cast("bigint") * DAY)


def month_start(text: Column) -> Column:
    """``yyyyMM`` (longer text is cut to its first six characters) to the first of that month."""
    return utc_start(_date(F.left(text, F.lit(6)), "yyyyMM"))


def month_text(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "yyyyMM")


def day_start(text: Column) -> Column:
    """``yyyyMMdd`` to midnight of that day."""
    return utc_start(_date(text, "yyyyMMdd"))


def day_text(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "yyyyMMdd")


def _date(text: Column, form: str) -> Column:
    # Read and cut in the same zone, so the zone drops out.
    return F.try_to_timestamp(text, F.lit(form)).cast("date")
