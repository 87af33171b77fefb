"""From address-level traces to AS-level or geo-level ones.

``label_traces``: trace_id, ts, year, from_ip, src, dst, hops ARRAY<STRING>, segment_lats
ARRAY<DOUBLE>, hop_indices ARRAY<INT>, num_hops, raw_hops, e2e, has_negative, inside_pct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import utc_year
from tracemill.operators.floor_join import BROADCAST_ROWS, floor_lookup

LABELS = {"as": "as_no", "geo": "geo"}


def explode_hops(traces: DataFrame) -> DataFrame:
    """One row per hop: trace_id, ts, year, region, pos, ip, lat; and the digest of the trace's line, if there is one."""
    keys = _trace_keys(traces)
    return traces.select(
        *keys,
        "ts",
        "year",
        "region",
        F.posexplode(F.arrays_zip("hops", "lats")).alias("pos", "hop"),
    ).select(
        *keys, "ts", "year", "region", "pos", F.col("hop.hops").alias("ip"), F.col("hop.lats").alias("lat")
    )


def _trace_keys(traces: DataFrame) -> list[str]:
    """What tells traces apart. Traces read from text are partitioned by the digest of their line."""
    return [name for name in ("digest", "trace_id") if name in traces.columns]


def label_hops(
    traces: DataFrame, ip_map: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Both labels of every hop: trace_id, ts, year, from_ip, hops ARRAY<STRUCT<pos, lat, as_no, geo>>.

    One lookup serves every combination of hop and endpoint level. The array of a trace is no longer
    than the input row it came from. Traces already partitioned by trace_id, or by digest as they are read, are not
    shuffled again when the map is broadcast.
    """
    found = floor_lookup(explode_hops(traces), ip_map, broadcast_rows)
    grouped = found.groupBy(*_trace_keys(traces)).agg(
        F.any_value("ts").alias("ts"),
        F.any_value("year").alias("year"),
        F.any_value("region").alias("from_ip"),
        F.sort_array(F.collect_list(F.struct("pos", "lat", "as_no", "geo"))).alias("hops"),
    )
    return grouped.select("trace_id", "ts", "year", "from_ip", "hops")


def _year(labelled: DataFrame) -> Column:
    """The year the trace was stored under; one way of cutting years everywhere."""
    return F.col("year") if "year" in labelled.columns else utc_year(F.col("ts"))


def _unlabelled(level: str, endpoint: str | None) -> Column:
    """Some hop lacks its label, or an end the label of the endpoint level."""
    label, end = LABELS[level], LABELS[endpoint or level]
    ends = (F.get("hops", F.lit(0))[end].isNull()) | (F.element_at("hops", -1)[end].isNull())
    return F.exists("hops", lambda hop: hop[label].isNull()) | ends


def label_coverage(labelled: DataFrame, level: str = "as", endpoint: str | None = None) -> DataFrame:
    """Per year: traces, and those that ``compress`` leaves out at these levels, since the map has no label.

    An address below the first range start has none, nor has a range whose label is NULL.
    """
    return labelled.groupBy(_year(labelled).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_unlabelled(level, endpoint)).alias("unlabelled")
    )


def compress(labelled: DataFrame, level: str = "as", endpoint: str | None = None) -> DataFrame:
    """Collapse runs of equal labels and split the latency at the borders.

    ``level`` and ``endpoint`` (default: the level) are each ``as`` or ``geo``. Traces that lack a label at
    one of these levels are left out; ``label_coverage`` counts them.
    """
    label, end = LABELS[level], LABELS[endpoint or level]
    flat = labelled.where(~_unlabelled(level, endpoint)).select(
        "trace_id",
        "ts",
        _year(labelled).alias("year"),
        "from_ip",
        F.get("hops", F.lit(0))[end].alias("src"),
        F.element_at("hops", -1)[end].alias("dst"),
        F.transform("hops", lambda hop: hop[label]).alias("labels"),
        F.transform("hops", lambda hop: hop["lat"]).alias("lats"),
        F.size("hops").alias("raw_hops"),
        F.element_at("hops", -1)["lat"].alias("e2e"),
    )
    labels, lats, cuts = F.col("labels"), F.col("lats"), F.col("cuts")
    # Positions where the label differs from the one before. sequence(1, 0) counts down, hence the guard.
    with_cuts = flat.withColumn(
        "cuts",
        F.when(
            F.col("raw_hops") > 1,
            F.filter(
                F.sequence(F.lit(1), F.col("raw_hops") - 1),
                lambda i: F.get(labels, i) != F.get(labels, i - 1),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    # Latency at which each run was entered; the first one counts from zero.
    with_entries = with_cuts.withColumn(
        "entries", F.concat(F.array(F.lit(0.0)), F.transform(cuts, lambda i: F.get(lats, i)))
    )
    entries = F.col("entries")
    split = F.transform(
        cuts,
        lambda i, k: F.array(
            F.get(lats, i - 1) - F.get(entries, k),
            F.get(lats, i) - F.get(lats, i - 1),
        ),
    )
    lead_in = [F.array(F.lit(0))] if level == "as" else []
    shaped = with_entries.select(
        "trace_id",
        "ts",
        "year",
        "from_ip",
        "src",
        "dst",
        F.concat(F.slice(labels, 1, 1), F.transform(cuts, lambda i: F.get(labels, i))).alias("hops"),
        F.concat(
            F.flatten(split), F.array(F.col("e2e") - F.element_at(entries, -1))
        ).alias("segment_lats"),
        F.concat(*lead_in, cuts, F.array("raw_hops")).alias("hop_indices"),
        (F.size(cuts) + 1).alias("num_hops"),
        "raw_hops",
        "e2e",
        F.exists(lats, lambda lat: lat < 0).alias("has_negative"),
    )
    inside = F.aggregate(
        F.filter("segment_lats", lambda _, i: i % 2 == 0), F.lit(0.0), lambda acc, lat: acc + lat
    )
    return shaped.withColumn("inside_pct", F.try_divide(100 * inside, "e2e"))


def label_traces(
    traces: DataFrame,
    ip_map: DataFrame,
    level: str = "as",
    endpoint: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``compress(label_hops(...))``."""
    return compress(label_hops(traces, ip_map, broadcast_rows), level, endpoint)
