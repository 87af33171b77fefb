"""The table of address ranges: range_start BIGINT, as_no STRING, geo STRING.

A range reaches up to the next start. On equal starts the later line wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import prefix_start


def read_ip_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(ip_map, bad_lines)`` of lines ``start as code [city]``."""
    return parse_ip_map(map_lines(spark, path))


def map_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines below ``path`` with a ``line_order`` that follows their place in their file."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        "value",
        # Blocks of one file may be read in any order; inside a block the id grows line by line.
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    )


def parse_labels(lines: DataFrame) -> DataFrame:
    """Lines with their ``words`` and the labels in words 1 to 3: ``as_no`` and ``geo``."""
    words = lines.withColumn("words", F.split(F.regexp_replace("value", r"\s+$", ""), r"\s+"))
    code = F.upper(F.get("words", F.lit(2)))
    city = F.upper(F.get("words", F.lit(3)))
    geo = F.when(F.size("words") > 3, F.concat(city, F.lit("@"), code)).otherwise(code)
    return words.withColumns({"as_no": F.get("words", F.lit(1)), "geo": geo})


def parse_ip_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ip_map, bad_lines)`` of lines with ``value`` and a sortable ``line_order``."""
    start = F.get("words", F.lit(0)).try_cast("bigint")
    typed = parse_labels(lines).select("value", "line_order", start.alias("range_start"), "as_no", "geo")
    # A start outside the IPv4 space, or none, or no geo code
    good = F.coalesce(F.col("range_start").between(0, 2**32 - 1), F.lit(False)) & F.col("geo").isNotNull()
    ip_map = (
        typed.where(good)
        .groupBy("range_start")
        .agg(F.max_by(F.struct("as_no", "geo"), "line_order").alias("label"))
        .select("range_start", "label.as_no", "label.geo")
    )
    return ip_map, typed.where(~good).select("value")


def normalise_cidr(prefixes: DataFrame) -> DataFrame:
    """Add ``range_start``, the base address of a ``prefix`` column ``a.b.c.d/len``."""
    return prefixes.withColumn("range_start", prefix_start(F.col("prefix")))
