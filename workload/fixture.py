"""Traces, hops, address map and text lines derived by Spark from the given tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import number_to_ip, utc_start

FIRST_ADDRESS = 16777216
ADDRESSES = 2**32 - FIRST_ADDRESS
BLOCKS = 4


# The columns in use. Stating them saves a job per table to read the file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _address(supplier: Column, low: Column | int) -> Column:
    """A /16 per supplier, kept inside the IPv4 space at any scale."""
    return F.lit(FIRST_ADDRESS) + (supplier * 65536 + low) % ADDRESSES


def traces(
    spark: SparkSession, sf_dir: str, shift: float = 0.0, daily: bool = False
) -> DataFrame:
    """One trace per order; ``shift`` is added to every latency, ``daily`` keeps the day of ``ts``."""
    # Spread before grouping: the lines of an order are scattered, so there is nothing to combine first.
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").cast("string").alias("trace_id"),
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
            ).alias("line"),
        )
        .repartition("trace_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        F.col("o_custkey").cast("string").alias("region"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        utc_start(F.col("o_orderdate").cast("date")).alias("day"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    grouped = lines.groupBy("trace_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    shaped = grouped.join(orders, "trace_id").select(
        "trace_id",
        (F.col("day") if daily else utc_start(F.trunc("date", "month"))).alias("ts"),
        F.year("date").alias("year"),
        "day",
        "date",
        "region",
        "status",
        "priority",
        F.transform(
            "lines", lambda x: _address(x["l_suppkey"], x["l_partkey"] % 256)
        ).alias("hops"),
        F.transform(
            "lines",
            lambda _, i: F.aggregate(
                F.slice("lines", F.lit(1), i + 1),
                F.lit(shift),
                lambda acc, x: acc + x["l_quantity"],
            ),
        ).alias("lats"),
    )
    return shaped.select(
        "*",
        number_to_ip(F.element_at("hops", -1)).alias("target"),
        F.size("hops").alias("num_hops"),
        F.element_at("lats", -1).alias("e2e"),
    )


def ip_map(spark: SparkSession, sf_dir: str, offset: int = 0) -> DataFrame:
    """Every supplier owns BLOCKS /16 blocks, from ``offset`` blocks on; the later supplier wins."""
    suppliers = labelled_suppliers(spark, sf_dir).withColumn(
        "range_start", _address(F.col("s_suppkey") * BLOCKS + offset, 0)
    )
    return (
        suppliers.groupBy("range_start")
        .agg(F.max_by(F.struct("as_no", "geo"), "s_suppkey").alias("label"))
        .select("range_start", "label.as_no", "label.geo")
    )


def labelled_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "s_suppkey",
            "s_acctbal",
            F.concat(F.lit("AS"), F.col("s_suppkey").cast("string")).alias("as_no"),
            F.concat(F.upper("n_name"), F.lit("@"), F.upper("r_name")).alias("geo"),
            F.translate("n_name", " ", "_").alias("city"),
            F.translate("r_name", " ", "_").alias("code"),
        )
    )


def _whole(latency: Column, tail: str | Column) -> Column:
    tail = F.lit(tail) if isinstance(tail, str) else tail
    return F.concat(latency.cast("bigint").cast("string"), tail)


def _hop_words(address, tail: str = ".25") -> Column:
    """Addresses and latencies in turn, separated by blanks."""
    words = F.zip_with(
        "hops", "lats", lambda ip, lat: F.concat_ws(" ", address(ip), _whole(lat, tail))
    )
    return F.array_join(words, " ")


def ark_lines(df: DataFrame, address=number_to_ip) -> DataFrame:
    flag = F.when(F.col("status") == "P", "ERR").otherwise("MOS")
    day = F.date_format("date", "yyyyMMdd")
    return df.select(
        F.concat_ws(" ", day, "region", "target", flag, _hop_words(address)).alias("value")
    )


def iplane_lines(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat_ws(" ", F.date_format("date", "yyyyMM"), _hop_words(number_to_ip)).alias("value")
    )


def cdn_lines(df: DataFrame) -> DataFrame:
    """Even positions end in .5, which rounds up, odd ones in .49."""
    spots = F.zip_with("hops", "lats", lambda ip, lat: F.struct(ip.alias("ip"), lat.alias("lat")))
    cells = F.transform(
        spots,
        lambda hop, i: F.concat(
            F.lit("1:"),
            number_to_ip(hop["ip"]),
            F.lit("_"),
            _whole(hop["lat"], F.when(i % 2 == 0, ".5").otherwise(".49")),
        ),
    )
    seconds = F.unix_timestamp("day").cast("string")
    return df.select(
        F.concat_ws(
            ",", F.lit("a"), F.lit("b"), seconds, "region", "target", F.array_join(cells, "|")
        ).alias("value")
    )


def zero_address(ip: Column) -> Column:
    """Addresses with a zero last part, written as the sentinel."""
    return F.when(ip % 256 == 0, "0.0.0.0").otherwise(number_to_ip(ip))


def broken_lines(df: DataFrame) -> DataFrame:
    """IPLANE lines, malformed in a way that goes by the priority of the order."""
    day = F.date_format("date", "yyyyMM")
    words = _hop_words(number_to_ip)
    kind = F.left("priority", F.lit(1))
    return df.select(
        F.when(kind == "1", F.concat_ws(" ", F.lit("200813"), words))
        .when(kind == "2", day)
        .when(kind == "3", F.concat_ws(" ", day, F.lit("10.0.1"), F.lit("3.5"), words))
        .when(kind == "4", F.concat_ws(" ", day, words, F.lit("10.0.0.1"), F.lit("fast")))
        .when(F.col("status") == "P", F.concat_ws(" ", day, words, F.lit("10.0.0.1")))
        .otherwise(F.concat(F.concat_ws(" ", day, words), F.lit("  ")))
        .alias("value")
    )


def map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map lines in order; two suppliers in a row give the same start, so the second one counts."""
    suppliers = labelled_suppliers(spark, sf_dir)
    start = _address(F.floor(F.col("s_suppkey") / 2), 0)
    city = F.when(F.col("s_acctbal") > 0, F.col("city"))
    return suppliers.orderBy("s_suppkey").select(
        F.concat_ws(" ", start.cast("string"), "as_no", F.lower("code"), city).alias("value")
    )


def prefix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map lines of nested prefixes, six for each supplier; in order, since equal ones follow each other.

    A wide one over many suppliers, the /16 of most, one of 24 to 32 bits anywhere among the addresses in use, two touching
    quarters of a /24, and for some suppliers the first quarter again.
    """
    s = F.col("s_suppkey")
    quarter = lambda k: _address(s, 64 * ((s + k) % 4))
    kinds = [
        ("", _address(s, 12345), 12 + s % 3),
        ("B", F.when(s % 4 != 0, _address(s, 0)), F.lit(16)),
        ("C", _address(s, s * 37 % 256), 24 + s % 9),
        ("D", quarter(0), F.lit(26)),
        ("E", quarter(1), F.lit(26)),
        ("F", F.when(s % 5 == 0, quarter(0)), F.lit(26)),
    ]
    rows = [
        F.struct(F.lit(k).alias("kind"), number_to_ip(at).alias("at"), at.alias("number"), bits.cast("string").alias("bits"), F.lit(tail).alias("tail"))
        for k, (tail, at, bits) in enumerate(kinds)
    ]
    city = F.when(F.col("s_acctbal") > 0, F.col("city"))
    each = labelled_suppliers(spark, sf_dir).select("*", F.inline(F.array(*rows))).where("number IS NOT NULL")
    return each.orderBy("s_suppkey", "kind").select(
        F.concat_ws(" ", F.concat_ws("/", "at", "bits"), F.concat("as_no", "tail"), F.lower("code"), city).alias("value")
    )


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix per supplier, of 16 to 24 bits, with bits set below the prefix length."""
    suppliers = labelled_suppliers(spark, sf_dir)
    text = F.concat(
        number_to_ip(_address(F.col("s_suppkey"), 12345)),
        F.lit("/"),
        (F.col("s_suppkey") % 9 + 16).cast("string"),
    )
    return suppliers.select(text.alias("prefix"), "as_no", "geo")
