"""Counts and latency moments per address prefix or time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import day_text, month_text, slash24_number, slash24_text
from tracemill.operators.stats import moments

TIME_UNITS = {"month": month_text, "day": day_text}


def _rollup(df: DataFrame, bucket: Column, name: str, value: str) -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"), *moments(F.col(value)))


def rollup_slash24(hops: DataFrame, ip: str = "ip", value: str = "lat") -> DataFrame:
    """Per /24; ``ip`` is a number or dotted text."""
    textual = dict(hops.dtypes)[ip] == "string"
    prefix = slash24_text(F.col(ip)) if textual else slash24_number(F.col(ip))
    return _rollup(hops, prefix, "prefix", value)


def rollup_time(traces: DataFrame, unit: str = "month", value: str = "e2e") -> DataFrame:
    """Per month (``yyyyMM``) or day (``yyyyMMdd``)."""
    return _rollup(traces, TIME_UNITS[unit](F.col("ts")), unit, value)
