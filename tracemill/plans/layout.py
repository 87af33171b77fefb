"""Label traces laid out by the key of the reports, so that these move no traces.

A table bucketed by, say, source and destination holds all traces of a pair in one bucket, and Spark knows it: counting,
ranking and ordering by pair then read the buckets as they are. One exchange at writing serves every later report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a bucket and year that are meant to be read by one task.
ROWS_A_BUCKET = 5_000_000


def buckets_for(label_traces: DataFrame) -> int:
    """Buckets for the largest year; the count is one pass over the year column."""
    sizes = label_traces.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 1
    return max(1, -(-largest // ROWS_A_BUCKET))


def store_by_key(
    label_traces: DataFrame,
    name: str,
    path: str,
    keys: Sequence[str] = ("src", "dst"),
    buckets: int | None = None,
) -> DataFrame:
    """Write ``label_traces`` below ``path`` as the table ``name``, by year, in buckets of ``keys`` sorted by them; returns the table.

    Reports of these keys take it with ``placed=True``. A table of that name is replaced. Each bucket of a year is one file; where
    reports go by other keys, Spark reads the files as usual, also in pieces.
    """
    n = buckets or buckets_for(label_traces)
    (
        label_traces.repartition(n, *keys)
        .write.mode("overwrite")
        .option("path", path)
        .partitionBy("year")
        .bucketBy(n, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    return label_traces.sparkSession.table(name)


def open_by_key(spark: SparkSession, name: str, path: str, schema, keys: Sequence[str], buckets: int) -> DataFrame:
    """Name a table again that another session has written below ``path``."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    by = ", ".join(keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (year) "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
