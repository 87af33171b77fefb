"""Tables that grow part by part; a part written again takes the place of the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_part(df: DataFrame, path: str, part: str) -> None:
    """Store ``df`` below ``path`` as ``part``. A part of that name is replaced, all others stay as they are.

    A table without rows leaves an old part of its name in place, since Spark replaces what it writes.
    """
    (
        df.withColumn("part", F.lit(part))
        .hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def read_parts(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """All parts or some, with their ``part``; a name stays text, even where it looks like a number or a date."""
    stored = spark.read.parquet(path).drop("part").schema
    found = spark.read.schema(stored.add("part", "string")).parquet(path)
    return found if parts is None else found.where(F.col("part").isin(list(parts)))
