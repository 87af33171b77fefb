"""Prevalence of paths as stored tables that grow part by part.

Of each part two tables are kept: how often each path of a key occurs, and the timeline of each key as one piece, with its begin,
end, first and last path and the changes inside. Counts add up. Pieces that follow each other join, whatever the order
they were written in; those that overlap in time do not, and only for these are traces read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.paths import join_pieces, path_counts, path_timeline, prevalence_of
from tracemill.operators.stats import HOT_ROWS
from tracemill.sources.parts import read_parts, write_part


def write_paths(
    label_traces: DataFrame, keys: Sequence[str], path: str, part: str, hot_rows: int = HOT_ROWS
) -> None:
    """Store what ``read_prevalence`` needs of ``part``, in place of an older one of that name. Parts have no trace in common."""
    write_part(path_counts(label_traces, keys), f"{path}/counts", part)
    write_part(path_timeline(label_traces, keys, hot_rows), f"{path}/timeline", part)


def read_prevalence(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    label_traces: DataFrame,
    parts: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What ``path_prevalence`` gives for the traces of all parts, or of some.

    ``label_traces`` has the traces of these parts; of it only the spans of time are read in which parts of a key overlap.
    """
    counted = read_parts(spark, f"{path}/counts", parts)
    counts = counted.groupBy(*keys, "path").agg(F.sum("c").alias("c"))
    timeline = joined_timeline(read_parts(spark, f"{path}/timeline", parts), keys, label_traces, hot_rows)
    return prevalence_of(counts, timeline.select(*keys, F.col("changes").alias("num_changes")), keys)


def joined_timeline(
    pieces: DataFrame, keys: Sequence[str], label_traces: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One piece for each key, from pieces in any order, overlapping or not.

    In order of their begins, a piece that begins after all ends before it starts a new span. Spans of a single piece are
    taken as they are; the traces inside others are put in order again.
    """
    order = Window.partitionBy(*keys).orderBy("begin", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True))
    spans = pieces.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(order))
    sizes = Window.partitionBy(*keys, "span")
    spans = spans.withColumn("pieces", F.count(F.lit(1)).over(sizes))
    columns = [*keys, "begin", "end", "first_path", "last_path", "changes"]
    single = spans.where("pieces = 1").select(*columns)
    names = [F.col(key).alias(f"_{key}") for key in keys]
    crossed = spans.where("pieces > 1").groupBy(*names, "span").agg(F.min("begin").alias("_from"), F.max("end").alias("_to"))
    at = F.struct("ts", "trace_id")
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    inside = label_traces.join(crossed, [*same, at.between(F.col("_from"), F.col("_to"))])
    again = path_timeline(inside.select(*label_traces.columns, "span"), [*keys, "span"], hot_rows)
    return join_pieces(single.unionByName(again.select(*columns)), keys)
