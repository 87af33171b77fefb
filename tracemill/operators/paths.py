"""Operators over label-level paths. None brings a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.stats import HOT_ROWS, split_hot


def path_text(hops: Column | str = "hops") -> Column:
    return F.array_join(hops, "-")


def links(label_traces: DataFrame) -> DataFrame:
    """Directed links with the latency spent on them: trace_id, year, link, link_src, link_dst, lat."""
    hops, segments = F.col("hops"), F.col("segment_lats")
    steps = F.transform(
        F.sequence(F.lit(1), F.col("num_hops") - 1),
        lambda i: F.struct(
            F.get(hops, i - 1).alias("link_src"),
            F.get(hops, i).alias("link_dst"),
            F.get(segments, 2 * i - 1).alias("lat"),
        ),
    )
    return (
        label_traces.where(F.col("num_hops") > 1)
        .select("trace_id", "year", F.inline(steps))
        .withColumn("link", F.concat_ws(" ", "link_src", "link_dst"))
    )


def path_strings(label_traces: DataFrame) -> DataFrame:
    """Add ``path`` (hops joined by dashes) and ``label_set`` (distinct hops, sorted, joined)."""
    return label_traces.withColumns(
        {
            "path": path_text("hops"),
            "label_set": path_text(F.array_sort(F.array_distinct("hops"))),
        }
    )


def path_cycles(label_traces: DataFrame) -> DataFrame:
    """Add ``has_cycle``: some label occurs twice on the path."""
    return label_traces.withColumn(
        "has_cycle", F.size("hops") != F.size(F.array_distinct("hops"))
    )


def _efficiency(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entropy of ``c`` per key and its share of the maximum; NULL when there is a single value.

    -sum(p ln p) with p = c/n is ln n - sum(c ln c)/n, which needs no second pass for n.
    """
    n = F.sum("c")
    entropy = F.when(F.count("c") == 1, 0.0).otherwise(F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n)
    return (
        counts.groupBy(*keys)
        .agg(entropy.alias("entropy"), F.count("c").cast("int").alias("distinct_values"))
        .withColumn("efficiency", F.try_divide("entropy", F.ln("distinct_values")))
    )


def hop_efficiency(label_traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: entropy of hop frequencies over the log of the number of distinct hops."""
    counts = (
        label_traces.select(*keys, F.explode("hops").alias("hop"))
        .groupBy(*keys, "hop")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return _efficiency(counts, keys).select(*keys, "efficiency")


def path_efficiency(
    label_traces: DataFrame, keys: Sequence[str], just_num_paths: bool = False
) -> DataFrame:
    """Per key: efficiency, entropy and number of distinct paths (the first two 0 on request)."""
    paths = label_traces.select(*keys, path_text().alias("path"))
    if just_num_paths:
        distinct = paths.groupBy(*keys).agg(F.count_distinct("path").cast("int").alias("num_paths"))
        return distinct.select(
            *keys, F.lit(0.0).alias("efficiency"), F.lit(0.0).alias("entropy"), "num_paths"
        )
    counts = paths.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("c"))
    return _efficiency(counts, keys).select(
        *keys, "efficiency", "entropy", F.col("distinct_values").alias("num_paths")
    )


def _pieces(
    label_traces: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    placed: bool = False,
) -> list[DataFrame]:
    """The timeline of each key in pieces: keys, begin and end (ts, trace_id), first and last path, changes inside.

    The timeline of a hot key is cut into stretches, contiguous ranges of (key, ts, trace_id) that Spark
    samples from the rows themselves, whatever the ids look like and however many traces share a time.
    """
    rows = label_traces.select(*keys, F.struct("ts", "trace_id").alias("_at"), path_text().alias("_path"))
    cold, hot_part = split_hot(rows, keys, hot_rows, hot)
    ranges = hot_part.repartitionByRange(*keys, "_at.ts", "_at.trace_id")
    parts = [_cut(ranges.withColumn("_stretch", F.spark_partition_id()), keys)]
    if keys:
        # Brought together by key once, and in one piece each.
        together = cold if placed else cold.repartition(*keys)
        parts.append(_cut(together.withColumn("_stretch", F.lit(-1)), keys))
    return parts


def _cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = F.lag("_path").over(Window.partitionBy(*keys, "_stretch").orderBy("_at"))
    return (
        rows.withColumn("_changed", (F.col("_path") != before).cast("bigint"))
        .groupBy(*keys, "_stretch")
        .agg(
            F.min("_at").alias("begin"),
            F.max("_at").alias("end"),
            F.min_by("_path", "_at").alias("first_path"),
            F.max_by("_path", "_at").alias("last_path"),
            F.coalesce(F.sum("_changed"), F.lit(0)).alias("changes"),
        )
        .drop("_stretch")
    )


def join_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One piece for each key, from pieces that do not overlap: changes inside add up, and those between neighbours."""
    previous = F.lag("last_path").over(Window.partitionBy(*keys).orderBy("begin"))
    between = F.coalesce((F.col("first_path") != previous).cast("bigint"), F.lit(0))
    return (
        pieces.withColumn("changes", F.col("changes") + between)
        .groupBy(*keys)
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.min_by("first_path", "begin").alias("first_path"),
            F.max_by("last_path", "end").alias("last_path"),
            F.sum("changes").alias("changes"),
        )
    )


def path_timeline(
    label_traces: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Per key: begin and end (ts, trace_id), first and last path, and how often the path differs from the one before."""
    stretches, *whole = _pieces(label_traces, keys, hot_rows, hot, placed)
    # Only hot keys have more than one piece.
    return reduce(DataFrame.unionByName, [join_pieces(stretches, keys), *whole])


def path_changes(
    label_traces: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Per key: how often the path differs from the one before, in order of (ts, trace_id)."""
    timeline = path_timeline(label_traces, keys, hot_rows, hot, placed)
    return timeline.select(*keys, F.col("changes").alias("num_changes"))


def path_counts(label_traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and path: number of traces ``c``."""
    paths = label_traces.select(*keys, path_text().alias("path"))
    return paths.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("c"))


def path_prevalence(
    label_traces: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Per key: share of the most frequent path, path changes over time, distinct paths, that path.

    Among equally frequent paths the lexicographically smallest is the dominant one. The traces are
    read more than once, so pass a stored table.
    """
    changes = path_changes(label_traces, keys, hot_rows, hot, placed)
    return prevalence_of(path_counts(label_traces, keys), changes, keys)


def prevalence_of(counts: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same, from ``path_counts`` and ``path_changes``."""
    dominant = counts.groupBy(*keys).agg(
        (F.max("c") / F.sum("c")).alias("prevalence"),
        F.count("path").alias("num_paths"),
        F.min_by("path", F.struct(-F.col("c"), F.col("path"))).alias("dominant_path"),
    )
    # Both tables have one row per key. Grouping brings these together, a NULL key included.
    both = dominant.unionByName(changes.select(*keys, "num_changes"), allowMissingColumns=True)
    columns = ["prevalence", "num_changes", "num_paths", "dominant_path"]
    return both.groupBy(*keys).agg(*[F.max(name).alias(name) for name in columns])
