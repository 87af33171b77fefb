"""Tables of nested prefixes, flattened into the disjoint ranges that the floor join reads.

Inside a prefix ``a.b.c.d/len`` others may lie; an address has the label of the longest prefix around it. After an
inner prefix ends, the outer one's label holds again, and after the outermost none.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import prefix_length, prefix_start
from tracemill.sources.ipmap import map_lines, parse_labels

LAST_ADDRESS = 2**32 - 1
# Prefixes of this length or more lie inside one bucket of addresses; there are under 2^16 shorter ones.
BUCKET_LENGTH = 16
BUCKET = 1 << 32 - BUCKET_LENGTH


def read_prefix_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(ip_map, bad_lines)`` of lines ``a.b.c.d/len as code [city]``; of equal prefixes the later line wins."""
    return parse_prefix_map(map_lines(spark, path))


def parse_prefix_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ip_map, bad_lines)`` of lines with ``value`` and a sortable ``line_order``."""
    typed = parse_labels(lines).withColumn("prefix", F.get("words", F.lit(0)))
    good = _valid() & F.col("geo").isNotNull()
    return flatten_prefixes(typed.where(good), "line_order"), typed.where(~good).select("value")


def _valid() -> Column:
    """A well-formed prefix inside the IPv4 space."""
    return F.coalesce(prefix_start(F.col("prefix")).between(0, LAST_ADDRESS), F.lit(False))


def flatten_prefixes(prefixes: DataFrame, order: str | None = None) -> DataFrame:
    """The ``ip_map`` (range_start, as_no, geo) of ``prefixes`` (prefix, as_no, geo), for ``floor_lookup``.

    Labels are NULL where no prefix reaches. Of equal prefixes the one with the greatest ``order`` wins, without
    it the one with the greatest labels; malformed prefixes and those outside IPv4 are left out.

    Every start and every first address after an end begins a range. In address order the open prefixes form a stack
    with at most one of each length, since prefixes of one length do not overlap: the last one that began, if
    it has not ended. So a window holds the stack as one value for each length and takes the longest open one. It runs over
    /16 buckets; prefixes that span buckets are swept by themselves, and what lies open below a bucket is carried in.
    """
    label = F.struct("as_no", "geo")
    by = label if order is None else F.struct(F.col(order), label)
    ranges = (
        prefixes.where(_valid())
        .groupBy(prefix_start(F.col("prefix")).alias("start"), prefix_length(F.col("prefix")).alias("length"))
        .agg(F.max_by(label, by).alias("label"))
        .withColumn("end", F.col("start") + F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.col("length")) - 1)
    )
    wide, narrow = (ranges.where(F.col("length") < BUCKET_LENGTH), ranges.where(F.col("length") >= BUCKET_LENGTH))
    # Two borders for each of at most 2^16 - 1 prefixes, so one task is enough.
    around = _swept(_borders(wide), Window.orderBy("address"), range(BUCKET_LENGTH))
    around = around.select("address", F.struct("label").alias("around"))
    inner = _borders(narrow).unionByName(around.select("address"), allowMissingColumns=True)
    inner = inner.withColumn("bucket", F.floor(F.col("address") / BUCKET))
    swept = _swept(inner, Window.partitionBy("bucket").orderBy("address"), range(BUCKET_LENGTH, 33), "bucket")

    # At most 65,536 buckets, each with the label that is open when it begins.
    begins = around.select(F.floor(F.col("address") / BUCKET).alias("bucket"), "around")
    known = swept.select("bucket").distinct().join(begins, "bucket", "left")
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = known.select("bucket", F.last("around", ignorenulls=True).over(upto).alias("around"))
    found = swept.join(F.broadcast(carried), "bucket")
    named = found.select(F.col("address").alias("range_start"), F.coalesce("label", "around.label").alias("label"))
    return named.select("range_start", "label.as_no", "label.geo")


def _borders(ranges: DataFrame) -> DataFrame:
    """Where a range begins, with its length, end and label, and the address after its end."""
    begins = ranges.select(F.col("start").alias("address"), "length", "end", "label")
    return begins.unionByName(ranges.select((F.col("end") + 1).alias("address")), allowMissingColumns=True)


def _swept(borders: DataFrame, order, lengths: Iterable[int], *keys: str) -> DataFrame:
    """Each border address once with the label of the longest range open there, NULL if none is."""
    opened = F.struct("end", "label")
    # The frame reaches up to all rows of the same address.
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stack = {f"open_{n}": F.last(F.when(F.col("length") == n, opened), ignorenulls=True).over(upto) for n in lengths}
    top = [
        F.when(F.col(f"{name}.end") >= F.col("address"), F.col(f"{name}.label")) for name in reversed(list(stack))
    ]
    found = borders.select(*keys, "address", *[column.alias(name) for name, column in stack.items()])
    return found.select(*keys, "address", F.coalesce(*top).alias("label")).dropDuplicates([*keys, "address"])
