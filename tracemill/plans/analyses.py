"""The three complete analyses: read, label, store, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.floor_join import BROADCAST_ROWS
from tracemill.operators.labelling import compress, label_coverage, label_hops
from tracemill.plans import reports as R
from tracemill.sources import (
    account_lines,
    line_counts,
    read_ip_map,
    read_lines,
    read_prefix_map,
    split_checked,
    write_report,
)

# Years reported by default.
YEARS = (2008, 2009, 2010, 2011, 2012, 2013)


@dataclass(frozen=True)
class Analysis:
    level: str
    endpoint: str


ANALYSES = {
    "as": Analysis("as", "as"),
    "as-city": Analysis("geo", "geo"),
    "geo": Analysis("geo", "geo"),
    "geoas": Analysis("as", "geo"),
}
PAIRS_AS_MIN_COUNT = 100


def reports(
    label_traces: DataFrame,
    kind: str,
    min_count: int = PAIRS_AS_MIN_COUNT,
    by: Sequence[str] = R.YEAR,
) -> dict[str, DataFrame]:
    """The reports of an analysis, by name."""
    common = {
        "srcs_stats": R.endpoint_stats(label_traces, "src", by),
        "dsts_stats": R.endpoint_stats(label_traces, "dst", by),
        "bigrams": R.link_stats(label_traces, by),
    }
    if kind == "geo":
        return {"pair_stats": R.pair_stats(label_traces, by=by), **common}
    if kind == "geoas":
        return {
            "pair_stats": R.pair_stats(label_traces, ("from_ip", "dst"), prevalence=False, by=by),
            **common,
            "degree_dist": R.degree_dist(label_traces, by),
            "edge_stats": R.edge_stats(label_traces, by=by),
        }
    return {
        "overview": R.overview(label_traces, by),
        "hop_dist": R.distribution(label_traces, "num_hops", by),
        "raw_hop_dist": R.distribution(label_traces, "raw_hops", by),
        "latency_dist": R.latency_hist(label_traces, by),
        "pair_stats": R.pair_stats(label_traces, min_count=min_count, by=by),
        **common,
        "multihoming": R.multihoming(label_traces, by),
        "degree_dist": R.degree_dist(label_traces, by),
    }


def label_dataset(
    spark: SparkSession,
    dataset: str,
    traces_path: str,
    map_path: str,
    out_path: str,
    partitions: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    prefixes: bool = False,
) -> str:
    """Read and label a dataset once, for every analysis; returns the path of the labelled hops.

    The table is stored by year with both labels of each hop. Rejected trace and map lines are
    written next to it, and ``line_counts`` says how many lines there were and what became of them. Text is read and
    parsed once, into a table below ``out_path`` that all else comes from.
    ``prefixes``: the map has lines of prefixes, which may be nested, and not of range starts.
    """
    checked_path = f"{out_path}/checked_lines"
    checked, account = account_lines(read_lines(spark, traces_path, dataset), dataset)
    checked.write.parquet(checked_path)
    traces, bad_lines = split_checked(spark.read.parquet(checked_path))
    if partitions is not None:
        traces = traces.repartition(partitions, "digest")
    read_map = read_prefix_map if prefixes else read_ip_map
    ip_map, bad_map_lines = read_map(spark, map_path)
    labelled_path = f"{out_path}/labelled_hops"
    labelled = label_hops(traces, ip_map, broadcast_rows)
    # Each year gets as many files as it needs, not one from every task.
    labelled.hint("rebalance", "year").write.partitionBy("year").parquet(labelled_path)
    write_report(line_counts(spark, account), f"{out_path}/line_counts", "json")
    write_report(bad_lines, f"{out_path}/bad_lines", "json")
    write_report(bad_map_lines, f"{out_path}/bad_map_lines", "json")
    return labelled_path


def run_analysis(
    spark: SparkSession,
    kind: str,
    dataset: str,
    labelled_path: str,
    out_path: str,
    years: Sequence[int] | None = YEARS,
    fmt: str = "parquet",
    min_count: int = PAIRS_AS_MIN_COUNT,
    replace: bool = False,
    all_years: bool = False,
) -> dict[str, str]:
    """Run one analysis (``as``, ``as-city``, ``geo`` or ``geoas``) and return its report paths.

    Compressed traces are stored once, by year; every report then reads only its own columns.
    ``years=None`` reports on every year there is. ``coverage`` counts the traces of all years, also of
    those that no report is made for (``reported`` is false).

    ``replace``: run some years again into the output of an earlier run; what is there for other years and datasets stays.
    ``all_years``: reports have a column ``slice`` with each year and ``ALL``, which is all years stored so far.
    """
    shape = ANALYSES[kind]
    everything = spark.read.parquet(labelled_path)
    labelled = R.slice_years(everything, years)
    traces_path = f"{out_path}/label_traces"
    compressed = compress(labelled, shape.level, shape.endpoint)
    traces = compressed.withColumn("dataset", F.lit(dataset))
    write_report(traces, traces_path, replace=replace)
    stored = spark.read.parquet(traces_path).where(F.col("dataset") == dataset).drop("dataset")
    label_traces = stored if all_years else R.slice_years(stored, years)
    by = R.YEARS_AND_ALL if all_years else R.YEAR

    paths = {}
    reported = F.lit(True) if years is None else F.col("year").isin(list(years))
    coverage = label_coverage(everything, shape.level, shape.endpoint).withColumn("reported", reported)
    tables = {"coverage": coverage, **reports(label_traces, kind, min_count, by)}
    for name, table in tables.items():
        paths[name] = f"{out_path}/{name}"
        order = [F.desc("degree"), "link_src"] if name == "degree_dist" else []
        write_report(table, paths[name], fmt, dataset, order_by=order, replace=replace)
    return paths
