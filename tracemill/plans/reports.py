"""Reports over ``label_traces``. Each is one plan for all slices.

``by`` names the slice columns, by default the year; ``by=()`` reports on all years together, and ``by=YEARS_AND_ALL`` does
both at once: the column ``slice`` has each year as text, and ``ALL``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import utc_year
from tracemill.operators.paths import links, path_prevalence
from tracemill.operators.stats import HOT_ROWS, hot_keys, moments, tasks_for, value_stats, wide_stats

YEAR = ("year",)
YEARS_AND_ALL = ("slice",)
ALL = "ALL"


def slice_years(label_traces: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Keep the given years; None keeps all."""
    return label_traces if years is None else label_traces.where(F.col("year").isin(list(years)))


def _aggregated(df: DataFrame, by: Sequence[str], keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates by slices and keys. Years and ALL are grouping sets: one scan, and one exchange of partial sums for both.

    Only the year may be NULL for itself; that of ALL is told by the grouping, not by its value.
    """
    if tuple(by) != YEARS_AND_ALL:
        return df.groupBy(*by, *keys).agg(*aggregates)
    year, rest = F.col("year"), [F.col(key) for key in keys]
    slice_ = F.when(F.grouping("year") == 1, F.lit(ALL)).otherwise(F.col("year").cast("string"))
    found = df.groupingSets([[year, *rest], rest], year, *rest).agg(slice_.alias("slice"), *aggregates)
    return found.select("slice", *[name for name in found.columns if name not in ("year", "slice")])


def _in_slices(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row once for its year and once for ALL, where a report needs the rows of a slice and not sums."""
    if tuple(by) != YEARS_AND_ALL:
        return df
    return df.withColumn("slice", F.explode(F.array(F.col("year").cast("string"), F.lit(ALL))))


def overview(label_traces: DataFrame, by: Sequence[str] = YEAR) -> DataFrame:
    """Number of traces, mean compressed and raw hops (whole numbers), mean latency."""
    n = F.count(F.lit(1))
    return _aggregated(
        label_traces,
        by,
        (),
        n.alias("n"),
        F.call_function("div", F.sum("num_hops"), n).alias("avg_hops"),
        F.call_function("div", F.sum("raw_hops"), n).alias("avg_raw_hops"),
        F.avg("e2e").alias("avg_latency"),
    )


def distribution(label_traces: DataFrame, column: str, by: Sequence[str] = YEAR) -> DataFrame:
    """Histogram of ``num_hops`` or ``raw_hops``."""
    return _aggregated(label_traces, by, (column,), F.count(F.lit(1)).alias("n"))


def latency_hist(label_traces: DataFrame, by: Sequence[str] = YEAR) -> DataFrame:
    """Histogram of the latency cut to a whole number (toward zero, within the INT range)."""
    whole = F.least(F.greatest("e2e", F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("int")
    return _aggregated(label_traces.withColumn("latency", whole), by, ("latency",), F.count(F.lit(1)).alias("n"))


def pair_stats(
    label_traces: DataFrame,
    keys: Sequence[str] = ("src", "dst"),
    min_count: int | None = None,
    prevalence: bool = True,
    by: Sequence[str] = YEAR,
    hot_rows: int = HOT_ROWS,
    placed: bool = False,
) -> DataFrame:
    """Per pair: n, statistics of latency, hops and raw hops, and how prevalent its main path is.

    Each part reads its own columns of the traces, so pass a stored table; hot pairs are found once for all parts.
    ``placed``: rows of a pair are together already, as in a table bucketed by ``keys``.
    """
    label_traces = _in_slices(label_traces, by)
    groups = [*by, *keys]
    metrics = {"latency": F.col("e2e"), "hops": F.col("num_hops"), "raw_hops": F.col("raw_hops")}
    hot = hot_keys(label_traces, groups, hot_rows)
    tasks = None if placed else tasks_for(label_traces.count() * len(metrics))
    wide = wide_stats(label_traces, groups, metrics, min_count, hot=hot, placed=placed, tasks=tasks)
    if not prevalence:
        return wide
    paths = path_prevalence(label_traces, groups, hot_rows, hot, placed)
    paths = paths.toDF(*[f"_{name}" if name in groups else name for name in paths.columns])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in groups]
    return wide.join(paths, same).drop(*[f"_{name}" for name in groups])


def endpoint_stats(label_traces: DataFrame, side: str, by: Sequence[str] = YEAR) -> DataFrame:
    """Per ``src`` or ``dst``: n, and avg, stdev, cv of latency and hops."""
    return _aggregated(
        label_traces,
        by,
        (side,),
        F.count(F.lit(1)).alias("n"),
        *moments(F.col("e2e"), "latency_"),
        *moments(F.col("num_hops"), "hops_"),
    )


def multihoming(label_traces: DataFrame, by: Sequence[str] = YEAR) -> DataFrame:
    """Per destination: the distinct labels seen just before the last one, and their number.

    Traces of a single label add nothing, but their destination is listed. Labels are made distinct
    before they meet, so a set is only as large as the number of labels next to the destination.
    """
    upstream = F.when(F.col("num_hops") >= 2, F.get("hops", F.col("num_hops") - 2))
    named = label_traces.withColumn("upstream", upstream)
    seen = _aggregated(named, by, ("dst", "upstream"), F.count(F.lit(1)).alias("n"))
    return seen.groupBy(*by, "dst").agg(
        F.count("upstream").alias("n_upstream"),
        F.sort_array(F.collect_set("upstream")).alias("upstream"),
    )


def link_stats(
    label_traces: DataFrame, by: Sequence[str] = YEAR, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per directed link: n and statistics of the latency on it."""
    groups = [*by, "link_src", "link_dst"]
    steps = F.sum(F.greatest(F.col("num_hops") - 1, F.lit(0)))
    tasks = tasks_for(_in_slices(_with_year(label_traces), by).agg(steps).first()[0] or 0)
    stats = value_stats(_in_slices(links(_with_year(label_traces)), by), groups, "lat", hot_rows, tasks=tasks)
    return stats.withColumn("link", F.concat_ws(" ", "link_src", "link_dst"))


def degree_dist(label_traces: DataFrame, by: Sequence[str] = YEAR) -> DataFrame:
    """Per label: number of distinct links that leave it, largest first."""
    return (
        _in_slices(links(_with_year(label_traces)), by)
        .groupBy(*by, "link_src")
        .agg(F.count_distinct("link_dst").cast("double").alias("degree"))
        .orderBy(*by, F.desc("degree"), "link_src")
    )


def edge_stats(
    label_traces: DataFrame,
    keys: Sequence[str] = ("from_ip", "dst"),
    by: Sequence[str] = YEAR,
    hot_rows: int = HOT_ROWS,
    placed: bool = False,
) -> DataFrame:
    """Per pair whose traces all cross a border: the share of first and last segments in the latency.

    Shares are in percent, NULL (and not counted) for a latency of zero. The least hop count travels
    along with the latencies, so the condition on it needs neither a join nor a window.
    """
    label_traces = _in_slices(label_traces, by)
    groups = [*by, *keys]
    metrics = {
        "latency": F.col("e2e"),
        "first_inside": _share(F.lit(0)),
        "first_link": _share(F.lit(1)),
        "last_link": _share(F.size("segment_lats") - 2),
        "last_inside": _share(F.size("segment_lats") - 1),
        "inside": F.col("inside_pct"),
    }
    tasks = None if placed else tasks_for(label_traces.count() * len(metrics))
    wide = wide_stats(label_traces, groups, metrics, hot_rows=hot_rows, least="num_hops", placed=placed, tasks=tasks)
    return wide.where(F.col("num_hops") > 1).drop("num_hops")


def _share(index: Column) -> Column:
    return F.try_divide(F.get("segment_lats", index), "e2e") * 100


def _with_year(label_traces: DataFrame) -> DataFrame:
    if "year" in label_traces.columns:
        return label_traces
    return label_traces.withColumn("year", utc_year(F.col("ts")))
