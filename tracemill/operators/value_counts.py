"""Counted values as a stored table that grows part by part, and statistics from it without the traces.

A part (a month, say) is a table of keys, metric, value and how often it occurs, stored with ``write_part`` and read with
``read_parts``. Parts add up, in any order; equal values of several parts are rows of their own, which statistics add
up. Percentiles, distributions, moments and histograms of any coarser keys, or of all years together, follow from the
counts alone and are the same as from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.stats import HOT_ROWS, cdf, stat6

COUNT = "c"


def value_counts(df: DataFrame, keys: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """``keys``, ``metric``, ``value`` and ``c``: how often each value occurs. NULL and NaN are not counted; -0.0 is 0.0.

    One exchange with partial sums; a value of very many rows arrives as one row from each task.
    """
    cells = [cell for name, column in metrics.items() for cell in (F.lit(name), column.cast("double") + F.lit(0.0))]
    stacked = df.select("*", *[cell.alias(f"_cell{k}") for k, cell in enumerate(cells)])
    names = [F.col(f"_cell{k}") for k in range(len(cells))]
    long = stacked.select(*keys, F.stack(F.lit(len(metrics)), *names).alias("metric", "value"))
    known = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias(COUNT))


def merge_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value once per ``keys`` and metric; coarser keys than the stored ones are allowed."""
    return counts.groupBy(*keys, "metric", "value").agg(F.sum(COUNT).alias(COUNT))


def count_stats(
    counts: DataFrame, keys: Sequence[str], min_count: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per ``keys`` and metric: n, min, max, avg, stdev, cv, p25 ... p99; as ``stat6`` gives from the rows."""
    return stat6(counts, keys, min_count, hot_rows, weight=COUNT)


def count_cdf(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per ``keys`` and metric: the points of the empirical distribution; as ``cdf`` gives from the rows."""
    return cdf(counts, [*keys, "metric"], "value", hot_rows, weight=COUNT)


def count_histogram(counts: DataFrame, keys: Sequence[str], metric: str, name: str) -> DataFrame:
    """Per ``keys``: how many values of ``metric`` have each whole number (cut toward zero, within the INT range)."""
    whole = F.least(F.greatest("value", F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("int")
    cut = counts.where(F.col("metric") == metric).groupBy(*keys, whole.alias(name))
    return cut.agg(F.sum(COUNT).alias("n"))
