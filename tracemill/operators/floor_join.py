"""Floor lookup: the label of an address is that of the greatest range start at or below it.

Spark has no efficient plan for this inequality, so it is turned into an equality on /16 buckets. Two
ways, chosen by the checked size of the map:

* a small map is broadcast, cut at bucket borders; the hops are never shuffled;
* a larger one meets only the distinct addresses, at most 65,536 per bucket, and the labelled
  addresses are then joined back to the hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import stored

BUCKET_BITS = 16
LAST_BUCKET = 65535
# Up to these the map is broadcast: its rows, and an estimate of its bytes with labels.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000
ROW_BYTES = 64
# The most used addresses, broadcast in the shuffled way. Any other address then holds less than
# one part in HOT_ADDRESSES of all hops.
HOT_ADDRESSES = 10_000
HOT_SPREAD = 4096


def floor_lookup(
    hops: DataFrame, ip_map: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``hops`` (any columns, with ``ip``) plus ``as_no`` and ``geo``.

    Both are NULL below the first range start. The map has one row per ``range_start``.
    """
    size = ip_map.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(ROW_BYTES + F.coalesce(F.octet_length("as_no"), F.lit(0)) + F.coalesce(F.octet_length("geo"), F.lit(0))).alias(
            "bytes"
        ),
    ).first()
    if size["rows"] <= broadcast_rows and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return _broadcast_lookup(hops, ip_map)
    return _shuffled_lookup(hops, ip_map)


def _bucket(address: Column) -> Column:
    """Addresses outside the IPv4 space go to the first and the last bucket; the order is kept."""
    inside = F.greatest(F.shiftright(address, BUCKET_BITS), F.lit(0).cast("bigint"))
    return F.least(inside, F.lit(LAST_BUCKET).cast("bigint"))


def _broadcast_lookup(hops: DataFrame, ip_map: DataFrame) -> DataFrame:
    # One window over the whole map is fine here: its size has been checked.
    following = F.lead("range_start").over(Window.orderBy("range_start"))
    ranges = ip_map.select(
        F.col("range_start").alias("_start"),
        F.coalesce(following - 1, F.lit(2**63 - 1)).alias("_end"),
        "as_no",
        "geo",
    )
    # Ranges are disjoint, so cutting them at bucket borders adds at most one row per bucket.
    pieces = ranges.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col("_start")), _bucket(F.col("_end"))))
    )
    match = (_bucket(F.col("ip")) == F.col("_bucket")) & F.col("ip").between(
        F.col("_start"), F.col("_end")
    )
    return hops.join(F.broadcast(pieces), match, "left").drop("_start", "_end", "_bucket")


def label_addresses(addresses: DataFrame, ip_map: DataFrame) -> DataFrame:
    """Distinct addresses (``ip`` and any other columns) plus ``label`` STRUCT<as_no, geo>.

    Starts and addresses are sorted together inside each bucket and the last label seen is carried
    down. What enters a bucket from below comes from a table of one row per bucket.
    """
    starts = ip_map.select(
        F.col("range_start").alias("ip"),
        F.lit(False).alias("_asked"),
        F.struct("as_no", "geo").alias("label"),
    )
    asked = addresses.withColumn("_asked", F.lit(True))
    line = starts.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", _bucket(F.col("ip")))

    start = F.when(~F.col("_asked"), F.col("ip"))
    per_bucket = line.groupBy("_bucket").agg(F.max_by("label", start).alias("_last"))
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        F.col("_bucket"), F.last("_last", ignorenulls=True).over(below).alias("_carried")
    )

    upto = (
        Window.partitionBy("_bucket")
        .orderBy("ip", "_asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = line.withColumn("label", F.last("label", ignorenulls=True).over(upto)).where("_asked")
    # ``carried`` has at most LAST_BUCKET + 1 rows, whatever the data.
    return (
        inside.join(F.broadcast(carried), "_bucket")
        .withColumn("label", F.coalesce("label", "_carried"))
        .drop("_bucket", "_asked", "_carried")
    )


def _shuffled_lookup(hops: DataFrame, ip_map: DataFrame) -> DataFrame:
    used = hops.groupBy("ip").agg(F.count(F.lit(1)).alias("uses"))
    labels = stored(label_addresses(used, ip_map), "labelled-addresses")

    hottest = labels.orderBy(F.desc("uses"), "ip").limit(HOT_ADDRESSES)
    hot = hottest.select(F.col("ip").alias("_hot_ip"), F.col("label").alias("_hot"))
    rest = labels.select(
        F.col("ip").alias("_ip"), F.col("label").alias("_rest"), F.lit(0).cast("bigint").alias("_slot")
    )
    # Hops of the hottest addresses are done after the broadcast; a slot of their own row keeps them
    # from piling up in one partition of the second join, which they pass without a match.
    slot = F.when(F.col("_hot_ip").isNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(*hops.columns), F.lit(HOT_SPREAD))
    )
    found = (
        hops.join(F.broadcast(hot), F.col("ip") == F.col("_hot_ip"), "left")
        .withColumn("_want", slot.cast("bigint"))
        .join(rest, (F.col("ip") == F.col("_ip")) & (F.col("_want") == F.col("_slot")), "left")
        .withColumn("_label", F.coalesce("_hot", "_rest"))
    )
    return found.select(*hops.columns, "_label.as_no", "_label.geo")
