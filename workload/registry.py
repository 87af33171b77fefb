"""One registered query per operator; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import tracemill as tm
from tracemill.functions import day_start, day_text, month_text
from tracemill.operators.stats import PERCENTILES
from tracemill.session import scratch_path, stored
from tracemill.sql import register_functions, register_reports
from workload import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
DECIMALS = 6
# Pairs of the fixture are small, so the pair report by AS runs on all years with this threshold.
PAIRS_MIN_COUNT = 20
# Takes latencies below zero, and some of them to zero.
SHIFT = -25.0
# Makes the larger geo pairs hot keys.
HOT_ROWS = 40
# Variances of whole numbers end in a five now and then, where the last digit of a rounded value would
# depend on the order of summation; scaled ones do not.
SCALE = 0.7071067811865476


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of decimals; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(name, DECIMALS) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _labelled(spark: SparkSession, sf: str, shift: float = 0.0, offset: int = 0) -> DataFrame:
    return tm.label_hops(fx.traces(spark, sf, shift), fx.ip_map(spark, sf, offset))


def _label(spark: SparkSession, sf: str, level: str, endpoint: str | None = None, shift: float = 0.0):
    return tm.compress(_labelled(spark, sf, shift), level, endpoint)


def _as(spark, sf):
    return _label(spark, sf, "as")


def _geo(spark, sf):
    return _label(spark, sf, "geo")


def _geoas(spark, sf):
    return _label(spark, sf, "as", "geo")


def _geo_stored(spark, sf):
    return stored(_geo(spark, sf), "label-traces")


def _as_stored(spark, sf):
    return stored(_as(spark, sf), "label-traces")


def _geoas_stored(spark, sf):
    return stored(_geoas(spark, sf), "label-traces")


def _on(table: Callable[[SparkSession, str], DataFrame], report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _rounded(report(table(spark, sf)))


# --- sources -----------------------------------------------------------------------------------


def _files(spark: SparkSession, lines: DataFrame, name: str, gzip: bool = True) -> str:
    path = scratch_path(spark, name)
    options = {"compression": "gzip"} if gzip else {}
    lines.write.options(**options).text(path)
    return path


def _clock(ts):
    """Hours, minutes and seconds of an instant, in UTC."""
    second = F.pmod(F.unix_seconds(ts), F.lit(86400))
    parts = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60]
    return F.concat(*[F.lpad(part.cast("string"), 2, "0") for part in parts])


def _flat_traces(traces: DataFrame) -> DataFrame:
    return traces.select(
        F.concat(day_text(F.col("ts")), _clock(F.col("ts"))).alias("at"),
        "year",
        "region",
        "target",
        F.array_join(F.col("hops").cast("array<string>"), " ").alias("hops"),
        F.array_join(F.col("lats").cast("array<string>"), " ").alias("lats"),
        "num_hops",
        "e2e",
    )


def src_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.iplane_lines(fx.traces(spark, sf))
    return tm.read_lines(spark, _files(spark, lines, "iplane"), "IPLANE").select("value", "dataset")


def src_ark(spark: SparkSession, sf: str) -> DataFrame:
    path = _files(spark, fx.ark_lines(fx.traces(spark, sf)), "ark")
    return _flat_traces(tm.read_traces(spark, path, "ARK")[0])


def src_iplane(spark: SparkSession, sf: str) -> DataFrame:
    path = _files(spark, fx.iplane_lines(fx.traces(spark, sf)), "iplane")
    return _flat_traces(tm.read_traces(spark, path, "IPLANE", partitions=8)[0])


def src_cdn(spark: SparkSession, sf: str) -> DataFrame:
    path = _files(spark, fx.cdn_lines(fx.traces(spark, sf)), "cdn")
    return _flat_traces(tm.read_traces(spark, path, "LARGECDN")[0])


def src_headers(spark: SparkSession, sf: str) -> DataFrame:
    path = _files(spark, fx.ark_lines(fx.traces(spark, sf)), "ark")
    traces, _ = tm.read_traces(spark, path, "ARK")
    return tm.trace_headers(traces).select(
        month_text(F.col("ts")).alias("month"), "year", "region", "target", "num_hops", "e2e"
    )


def src_ipmap(spark: SparkSession, sf: str) -> DataFrame:
    path = _files(spark, fx.map_lines(spark, sf), "ipmap", gzip=False)
    return tm.read_ip_map(spark, path)[0]


def cidr_floor_join(spark: SparkSession, sf: str) -> DataFrame:
    """Longest-prefix labels of all hops, from a file of nested prefixes."""
    path = _files(spark, fx.prefix_lines(spark, sf), "prefixes", gzip=False)
    ip_map = stored(tm.read_prefix_map(spark, path)[0], "ip-map")
    return tm.floor_lookup(tm.explode_hops(fx.traces(spark, sf)), ip_map).select("trace_id", "pos", "ip", "as_no", "geo")


def bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.broken_lines(fx.traces(spark, sf))
    return tm.parse_lines(lines, "IPLANE")[1].select("value", "reason")


def flt_clean(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.ark_lines(fx.traces(spark, sf, SHIFT), fx.zero_address)
    return tm.clean_lines(lines, "ARK")


def sink_report(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    tm.write_report(tm.endpoint_stats(_as(spark, sf), "src"), path, dataset="ARK")
    return _rounded(spark.read.parquet(path))


def sink_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text lines of a written report, with the folders that hold them."""
    path = scratch_path(spark, "report-text")
    tm.write_report(tm.distribution(_geo(spark, sf), "num_hops"), path, "text", dataset="ARK")
    return spark.read.text(path).select("value", "dataset", F.col("year").cast("int").alias("year"))


# --- labelling ---------------------------------------------------------------------------------


def _floor_join(broadcast_rows: int) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        hops = tm.explode_hops(fx.traces(spark, sf))
        found = tm.floor_lookup(hops, fx.ip_map(spark, sf, offset=8), broadcast_rows)
        return found.select("trace_id", "pos", "ip", "as_no", "geo")

    return query


def _compressed(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id",
        month_text(F.col("ts")).alias("month"),
        "year",
        "from_ip",
        "src",
        "dst",
        F.array_join("hops", " ").alias("hops"),
        F.array_join(F.col("segment_lats").cast("array<string>"), " ").alias("segment_lats"),
        F.array_join(F.col("hop_indices").cast("array<string>"), " ").alias("hop_indices"),
        "num_hops",
        "raw_hops",
        "e2e",
        "has_negative",
        "inside_pct",
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    table = _label(spark, sf, "geo", shift=SHIFT)
    return _rounded(table.select("trace_id", F.posexplode("segment_lats").alias("idx", "lat")))


def hop_indices(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stored(_labelled(spark, sf), "labelled-hops")
    text = F.array_join(F.col("hop_indices").cast("array<string>"), " ").alias("hop_indices")
    both = [
        tm.compress(labelled, level).select("trace_id", F.lit(level).alias("level"), text)
        for level in ("as", "geo")
    ]
    return both[0].unionByName(both[1])


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stored(_labelled(spark, sf), "labelled-hops")
    crossed = [
        tm.compress(labelled, level, end).select(
            "trace_id", F.lit(level).alias("level"), F.lit(end).alias("endpoint"), "src", "dst", "num_hops"
        )
        for level, end in (("as", "geo"), ("geo", "as"))
    ]
    return crossed[0].unionByName(crossed[1])


def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tm.label_coverage(_labelled(spark, sf, offset=8))


def label_coverage_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of every third supplier have no location."""
    ip_map = fx.ip_map(spark, sf, offset=8)
    number = F.substring("as_no", 3, 20).cast("bigint")
    holes = ip_map.withColumn("geo", F.when(number % 3 != 0, F.col("geo")))
    return tm.label_coverage(tm.label_hops(fx.traces(spark, sf), holes), "geo")


def pair_stats_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose source is not known: the prevalence must not lose them."""
    table = _geo(spark, sf).withColumn("src", F.when(F.col("src") != F.col("dst"), F.col("src")))
    stats = tm.pair_stats(stored(table, "label-traces"), by=())
    return _rounded(stats.select("src", "dst", "n", "latency_avg", "prevalence", "num_paths"))


def pair_stats_as_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """The AS pair report as published, by year and from 100 traces on; two networks make the pairs dense."""
    some = F.substring("as_no", 3, 20).cast("bigint") % 50 == 49
    two = fx.ip_map(spark, sf).withColumn("as_no", F.when(some, "AS0").otherwise("AS1"))
    table = tm.label_traces(fx.traces(spark, sf), two)
    return _rounded(tm.reports(stored(table, "label-traces"), "as")["pair_stats"])


def floor_join_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Starts and addresses far outside the IPv4 space, on both ways of the join."""
    ip_map = fx.ip_map(spark, sf, offset=8).withColumn(
        "range_start",
        F.when(F.col("as_no") == "AS1", F.lit(-(10**15)))
        .when(F.col("as_no") == "AS2", F.lit(10**15))
        .otherwise(F.col("range_start")),
    )
    sign = F.when(F.col("ip") % 3 == 0, -1).when(F.col("ip") % 3 == 1, 1).otherwise(10**6)
    hops = tm.explode_hops(fx.traces(spark, sf)).withColumn("ip", F.col("ip") * sign)
    ways = [
        tm.floor_lookup(hops, ip_map, limit).select("trace_id", "pos", "ip", "as_no", F.lit(way).alias("way"))
        for way, limit in (("broadcast", tm.operators.floor_join.BROADCAST_ROWS), ("shuffled", 0))
    ]
    return ways[0].unionByName(ways[1])


def degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the degree report as it is written, as a number."""
    degrees = tm.degree_dist(_as(spark, sf))
    order = Window.partitionBy("year").orderBy(F.desc("degree"), "link_src")
    return degrees.withColumn("place", F.row_number().over(order))


def _count_parts(spark: SparkSession, sf: str, table, keys: list[str], metrics) -> DataFrame:
    """Counted values of three parts, read together; the first one held other traces before it was written again."""
    label_traces = stored(table(spark, sf), "label-traces")
    path = scratch_path(spark, "counts")
    third = F.pmod(F.xxhash64("trace_id"), F.lit(3))
    for part, rows in ((1, third != 2), (2, third == 2), (0, third == 0), (1, third == 1)):
        tm.write_part(tm.value_counts(label_traces.where(rows), keys, metrics), path, str(part))
    return tm.read_parts(spark, path)


def counts_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    counts = _count_parts(spark, sf, _geo, ["year", "src", "dst"], {"e2e": F.col("e2e"), "hops": F.col("num_hops")})
    stats = tm.count_stats(counts, ["src", "dst"], hot_rows=HOT_ROWS).where("metric = 'e2e'")
    return _rounded(stats.select("src", "dst", "n", *[f"p{p}" for p in PERCENTILES]))


def counts_cdf(spark: SparkSession, sf: str) -> DataFrame:
    counts = _count_parts(spark, sf, _geo, ["year", "src", "dst"], {"e2e": F.col("e2e")})
    return _rounded(tm.count_cdf(counts, ["src", "dst"]).drop("metric"))


def counts_latency_hist(spark: SparkSession, sf: str) -> DataFrame:
    def table(spark, sf):
        return _label(spark, sf, "geo", shift=SHIFT - 0.5)

    counts = _count_parts(spark, sf, table, ["year", "src", "dst"], {"e2e": F.col("e2e")})
    return tm.count_histogram(counts, ["year"], "e2e", "latency")


def counts_moments(spark: SparkSession, sf: str) -> DataFrame:
    def table(spark, sf):
        return _label(spark, sf, "as", shift=SHIFT).withColumn("e2e", F.col("e2e") * SCALE)

    counts = _count_parts(spark, sf, table, ["year", "src", "dst"], {"e2e": F.col("e2e")})
    stats = tm.count_stats(counts, ["year", "src"])
    variance = (F.col("stdev") * F.col("stdev")).alias("variance")
    return _rounded(stats.select("year", "src", "n", "min", "max", variance, "avg", "stdev", "cv"))


def path_prevalence_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written out of order; one of them overlaps another in time."""
    label_traces = stored(_geo(spark, sf), "label-traces")
    path, keys = scratch_path(spark, "paths"), ["src", "dst"]
    stray = F.pmod(F.xxhash64("trace_id"), F.lit(10)) == 0
    late = F.col("year") >= 1998
    parts = {"late": late & ~stray, "stray": late & stray, "early": F.col("year") < 1997, "middle": F.col("year") == 1997}
    for part, rows in parts.items():
        tm.write_paths(label_traces.where(rows), keys, path, part)
    return _rounded(tm.read_prevalence(spark, path, keys, label_traces, hot_rows=HOT_ROWS))


def line_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each line of a text dataset; every second line or so is malformed or dropped."""
    path = _files(spark, fx.broken_lines(fx.traces(spark, sf, SHIFT)), "broken")
    checked, account = tm.account_lines(tm.read_lines(spark, path, "IPLANE"), "IPLANE")
    checked.write.parquet(scratch_path(spark, "checked"))
    return tm.line_counts(spark, account)


def sink_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """A report of all years, one year of which is then written again from other traces."""
    label_traces = stored(_as(spark, sf), "label-traces")
    path = scratch_path(spark, "rerun")
    tm.write_report(tm.endpoint_stats(label_traces, "src"), path, dataset="ARK")
    again = tm.slice_years(label_traces, [1996]).where("num_hops > 1")
    tm.write_report(tm.endpoint_stats(again, "src"), path, dataset="ARK", replace=True)
    return _rounded(spark.read.parquet(path))


def sql_slash24(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up by /24, from SQL alone."""
    register_functions(spark)
    tm.explode_hops(fx.traces(spark, sf)).createOrReplaceTempView("hops")
    return _rounded(
        spark.sql(
            "SELECT prefix, n, avg, stdev, coefficient_of_variation(avg, stdev) AS cv FROM ("
            "SELECT slash24(ip) AS prefix, count(*) AS n, avg(lat) AS avg, stddev_pop(lat) AS stdev FROM hops GROUP BY slash24(ip))"
        )
    )


def sql_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Two years of a report, from SQL alone."""
    register_reports(spark, stored(_as(spark, sf), "label-traces"), "as")
    return _rounded(spark.sql("SELECT * FROM overview_of(1996, 1997)"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tm.links(_as(spark, sf)))


# --- scalar functions inside table jobs --------------------------------------------------------


def rollup_slash24(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tm.rollup_slash24(tm.explode_hops(fx.traces(spark, sf))))


def rollup_slash24_text(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tm.rollup_slash24(fx.traces(spark, sf), "target", "e2e"))


def rollup_month(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tm.rollup_time(fx.traces(spark, sf, daily=True), "month"))


def rollup_day(spark: SparkSession, sf: str) -> DataFrame:
    """Days go to text and back before the roll-up."""
    traces = fx.traces(spark, sf, daily=True)
    return _rounded(tm.rollup_time(traces.withColumn("ts", day_start(day_text(F.col("ts")))), "day"))


# What the queries start from.
FIXTURES: dict[str, Query] = {"traces": fx.traces, "as": _as, "geo": _geo, "geoas": _geoas}

QUERIES: dict[str, Query] = {
    "src_lines": src_lines,
    "src_ark": src_ark,
    "src_iplane": src_iplane,
    "src_cdn": src_cdn,
    "src_headers": src_headers,
    "src_ipmap": src_ipmap,
    "bad_lines": bad_lines,
    "flt_clean": flt_clean,
    "flt_year": _on(
        _as, lambda lt: tm.overview(tm.slice_years(lt, [1996, 1997]), by=("year",))
    ),
    "sink_report": sink_report,
    "sink_text": sink_text,
    "ip_floor_join": _floor_join(tm.operators.floor_join.BROADCAST_ROWS),
    "ip_floor_join_shuffled": _floor_join(0),
    "compress_as": _on(_as, _compressed),
    "compress_geo": _on(_geo, _compressed),
    "segments": segments,
    "hop_indices": hop_indices,
    "inside_share": lambda spark, sf: _rounded(
        _label(spark, sf, "as", shift=SHIFT).select("trace_id", "e2e", "inside_pct")
    ),
    "endpoints": endpoints,
    "has_negative": lambda spark, sf: _label(spark, sf, "as", shift=SHIFT).select(
        "trace_id", "has_negative"
    ),
    "label_coverage": label_coverage,
    "links": links,
    "path_strings": _on(_as, lambda lt: tm.path_strings(lt).select("trace_id", "path", "label_set")),
    "path_cycles": _on(_as, lambda lt: tm.path_cycles(lt).select("trace_id", "has_cycle")),
    "label_coverage_geo": label_coverage_geo,
    "pair_stats_null_keys": pair_stats_null_keys,
    "floor_join_bounds": floor_join_bounds,
    "overview_city": _on(_geo, tm.overview),
    "hop_dist_label_city": _on(_geo, lambda lt: tm.distribution(lt, "num_hops")),
    "hop_dist_raw_city": _on(_geo, lambda lt: tm.distribution(lt, "raw_hops")),
    "latency_hist_city": lambda spark, sf: tm.latency_hist(_label(spark, sf, "geo", shift=SHIFT - 0.5)),
    "multihoming_city": _on(
        _geo, lambda lt: tm.multihoming(lt).withColumn("upstream", F.array_join("upstream", " "))
    ),
    "degree_dist_city": _on(_geo, tm.degree_dist),
    "degree_rank": degree_rank,
    "pair_stats_as_yearly": pair_stats_as_yearly,
    "overview": _on(_as, tm.overview),
    "overview_all": _on(_as, lambda lt: tm.overview(lt, by=())),
    "hop_dist_label": _on(_as, lambda lt: tm.distribution(lt, "num_hops")),
    "hop_dist_raw": _on(_as, lambda lt: tm.distribution(lt, "raw_hops")),
    "latency_hist": lambda spark, sf: tm.latency_hist(_label(spark, sf, "as", shift=SHIFT - 0.5)),
    "pair_stats_as": _on(_as_stored, lambda lt: tm.pair_stats(lt, min_count=PAIRS_MIN_COUNT, by=())),
    "pair_stats_geo": _on(_geo_stored, tm.pair_stats),
    "pair_stats_geo_all": _on(_geo_stored, lambda lt: tm.pair_stats(lt, by=())),
    "pair_stats_geoas": _on(
        _geoas_stored, lambda lt: tm.pair_stats(lt, ("from_ip", "dst"), prevalence=False)
    ),
    "src_stats": _on(_as, lambda lt: tm.endpoint_stats(lt, "src")),
    "src_stats_geo": _on(_geo, lambda lt: tm.endpoint_stats(lt, "src")),
    "src_stats_geoas": _on(_geoas, lambda lt: tm.endpoint_stats(lt, "src")),
    "dst_stats": _on(_as, lambda lt: tm.endpoint_stats(lt, "dst")),
    "dst_stats_geo": _on(_geo, lambda lt: tm.endpoint_stats(lt, "dst")),
    "dst_stats_geoas": _on(_geoas, lambda lt: tm.endpoint_stats(lt, "dst")),
    "multihoming": _on(
        _as, lambda lt: tm.multihoming(lt).withColumn("upstream", F.array_join("upstream", " "))
    ),
    "link_stats": _on(_as_stored, tm.link_stats),
    "link_stats_geo": _on(_geo_stored, tm.link_stats),
    "degree_dist": _on(_as, tm.degree_dist),
    "edge_stats": lambda spark, sf: _rounded(
        tm.edge_stats(stored(_label(spark, sf, "as", "geo", SHIFT), "label-traces"))
    ),
    "agg_moments": _on(
        lambda spark, sf: _label(spark, sf, "as", shift=SHIFT),
        lambda lt: tm.moment_table(lt.withColumn("e2e", F.col("e2e") * SCALE), ["year", "src"], "e2e"),
    ),
    "agg_percentiles": _on(_geo_stored, lambda lt: tm.percentiles(lt, ["src", "dst"], "e2e")),
    "agg_cdf": _on(_geo_stored, lambda lt: tm.cdf(lt, ["src", "dst"], "e2e")),
    "agg_percentiles_hot": _on(
        _geo_stored, lambda lt: tm.percentiles(lt, ["src", "dst"], "e2e", hot_rows=HOT_ROWS)
    ),
    "agg_cdf_hot": _on(
        _geo_stored, lambda lt: tm.cdf(lt, ["src", "dst"], "e2e", hot_rows=HOT_ROWS)
    ),
    "agg_corr": _on(_as, lambda lt: tm.correlation(lt, ["year", "src"], "num_hops", "inside_pct")),
    "hop_efficiency": _on(_as, lambda lt: tm.hop_efficiency(lt, ["src", "dst"])),
    "path_efficiency": _on(_geo, lambda lt: tm.path_efficiency(lt, ["src", "dst"])),
    "path_count": _on(_geo, lambda lt: tm.path_efficiency(lt, ["src", "dst"], just_num_paths=True)),
    "path_prevalence": _on(_geo_stored, lambda lt: tm.path_prevalence(lt, ["src", "dst"])),
    "path_prevalence_hot": _on(
        _geo_stored, lambda lt: tm.path_prevalence(lt, ["src", "dst"], hot_rows=HOT_ROWS)
    ),
    "line_accounting": line_accounting,
    "sink_rerun": sink_rerun,
    "overview_years_all": _on(_as, lambda lt: tm.overview(lt, tm.YEARS_AND_ALL)),
    "hop_dist_years_all": _on(_as, lambda lt: tm.distribution(lt, "num_hops", tm.YEARS_AND_ALL)),
    "latency_hist_years_all": _on(_as, lambda lt: tm.latency_hist(lt, tm.YEARS_AND_ALL)),
    "src_stats_years_all": _on(_as, lambda lt: tm.endpoint_stats(lt, "src", tm.YEARS_AND_ALL)),
    "multihoming_years_all": _on(_as, 
        lambda lt: tm.multihoming(lt, tm.YEARS_AND_ALL).withColumn("upstream", F.array_join("upstream", " "))
    ),
    "link_stats_years_all": _on(_geo_stored, lambda lt: tm.link_stats(lt, tm.YEARS_AND_ALL)),
    "sql_slash24": sql_slash24,
    "sql_reports": sql_reports,
    "counts_percentiles": counts_percentiles,
    "counts_cdf": counts_cdf,
    "counts_latency_hist": counts_latency_hist,
    "counts_moments": counts_moments,
    "path_prevalence_appended": path_prevalence_appended,
    "cidr_floor_join": cidr_floor_join,
    "cidr_normalise": lambda spark, sf: tm.normalise_cidr(fx.prefixes(spark, sf)),
    "rollup_slash24": rollup_slash24,
    "rollup_slash24_text": rollup_slash24_text,
    "rollup_month": rollup_month,
    "rollup_day": rollup_day,
}
