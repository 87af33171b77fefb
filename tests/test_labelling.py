import bisect
import itertools
import random

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from tracemill.operators import floor_join
from workload import fixture as fx

SF_DIR = "/root/testdata/sf0.001"
TRACES = (
    "trace_id string, ts timestamp, year int, region string, target string, hops array<bigint>, "
    "lats array<double>, num_hops int, e2e double"
)
IP_MAP = [(100, "A1", "X"), (200, "A2", "X"), (300, "A3", "Y")]


def make(spark, *hops_and_lats):
    rows = []
    for i, (hops, lats) in enumerate(hops_and_lats):
        rows.append((f"t{i}", None, 2008, "src", "dst", hops, lats, len(hops), lats[-1]))
    return spark.createDataFrame(rows, TRACES).withColumn(
        "ts", F.lit("2008-01-01 00:00:00").cast("timestamp")
    )


def ip_map(spark, rows=None):
    return spark.createDataFrame(rows or IP_MAP, "range_start bigint, as_no string, geo string")


def runs_of(labels, lats, as_level):
    """Hops, segments and indices from the runs of equal labels: [first, last] of each, in order."""
    runs = [[i for i, _ in run] for _, run in itertools.groupby(enumerate(labels), key=lambda pair: pair[1])]
    inside = [lats[run[-1]] - (lats[run[0]] if k else 0.0) for k, run in enumerate(runs)]
    between = [lats[right[0]] - lats[left[-1]] for left, right in itertools.pairwise(runs)]
    segments = [x for pair in zip(inside, between) for x in pair] + inside[-1:]
    starts = [run[0] for run in runs]
    return [labels[i] for i in starts], segments, starts[0 if as_level else 1 :] + [len(labels)]


@pytest.mark.parametrize("level", ["as", "geo"])
@pytest.mark.parametrize("endpoint", ["as", "geo"])
def test_compress_against_runs(spark, level, endpoint):
    rng = random.Random(1)
    given = []
    for _ in range(200):
        n = rng.randint(1, 9)
        given.append(
            ([rng.randint(100, 399) for _ in range(n)], [float(rng.randint(-5, 50)) for _ in range(n)])
        )
    given += [([150], [0.0]), ([150, 160, 199], [1.0, 2.0, 0.0])]
    table = tm.label_traces(make(spark, *given), ip_map(spark), level, endpoint)
    got = {r.trace_id: r for r in table.collect()}
    assert len(got) == len(given)
    pick = {"as": 1, "geo": 2}
    find = lambda ip, lvl: IP_MAP[ip // 100 - 1][pick[lvl]]
    for i, (ips, lats) in enumerate(given):
        row = got[f"t{i}"]
        hops, segments, indices = runs_of([find(ip, level) for ip in ips], lats, level == "as")
        assert (row.hops, row.segment_lats, row.hop_indices) == (hops, segments, indices)
        assert (row.src, row.dst) == (find(ips[0], endpoint), find(ips[-1], endpoint))
        assert row.num_hops == len(hops) and row.raw_hops == len(ips) and row.e2e == lats[-1]
        assert row.has_negative == any(x < 0 for x in lats)
        if lats[-1] == 0:
            assert row.inside_pct is None
        else:
            assert row.inside_pct == pytest.approx(100 * sum(segments[::2]) / lats[-1])


def test_invariants(spark):
    table = tm.label_traces(fx.traces(spark, SF_DIR), fx.ip_map(spark, SF_DIR), "as", "geo")
    broken = table.where(
        (F.size("segment_lats") != 2 * F.col("num_hops") - 1)
        | (F.aggregate("segment_lats", F.lit(0.0), lambda a, x: a + x) != F.col("e2e"))
        | (F.element_at("hop_indices", -1) != F.col("raw_hops"))
        | (F.size("hop_indices") != F.col("num_hops") + 1)
    )
    assert broken.count() == 0
    total = table.agg(F.sum(F.col("num_hops") - 1)).first()[0]
    assert tm.links(table).count() == total
    assert tm.links(table).where("link_src = link_dst").count() == 0


def test_unlabelled_traces_are_left_out_and_counted(spark):
    traces = make(spark, ([150, 50], [1.0, 2.0]), ([150], [1.0]))
    labelled = tm.label_hops(traces, ip_map(spark))
    assert [r.trace_id for r in tm.compress(labelled).collect()] == ["t1"]
    assert [tuple(r) for r in tm.label_coverage(labelled).collect()] == [(2008, 2, 1)]


@pytest.mark.parametrize("broadcast_rows", [floor_join.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("hot", [floor_join.HOT_ADDRESSES, 3])
def test_floor_lookup_against_bisect(spark, monkeypatch, broadcast_rows, hot):
    monkeypatch.setattr(floor_join, "HOT_ADDRESSES", hot)
    rng = random.Random(2)
    starts = sorted(rng.sample(range(70_000, 2**32), 60)) + [2**32 - 3]
    table = [(s, f"A{i}", f"G{i}") for i, s in enumerate(starts)]
    ips = [rng.randrange(2**32) for _ in range(300)] + [starts[0] - 1, 0, 2**32 - 1, 300 * 2**24]
    ips += starts + [starts[7] + 1] * 500
    hops = spark.createDataFrame(list(enumerate(ips)), "id int, ip bigint")
    found = tm.floor_lookup(hops, ip_map(spark, table), broadcast_rows)
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(ips)
    for i, ip in enumerate(ips):
        at = bisect.bisect_right(starts, ip) - 1
        want = (ip, None, None) if at < 0 else (ip, f"A{at}", f"G{at}")
        assert (got[i].ip, got[i].as_no, got[i].geo) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_traces_are_labelled_without_a_shuffle(spark):
    traces = make(spark, ([150, 250], [1.0, 2.0])).repartition(4, "trace_id")
    text = plan(tm.label_traces(traces, ip_map(spark)))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastNestedLoopJoin" not in text


def test_shuffled_lookup_is_an_equi_join(spark):
    hops = spark.createDataFrame([(1, 150)], "id int, ip bigint")
    text = plan(tm.floor_lookup(hops, ip_map(spark), 0))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_missing_locations_are_left_out_and_counted(spark):
    holes = ip_map(spark, [(100, "A1", "X"), (200, "A2", None), (300, "A3", "Y")])
    labelled = tm.label_hops(make(spark, ([150, 250, 350], [1.0, 2.0, 3.0]), ([150, 350], [1.0, 2.0])), holes)
    assert [r.hops for r in tm.compress(labelled, "geo").collect()] == [["X", "Y"]]
    assert tm.compress(labelled, "as").count() == 2
    assert [tuple(r) for r in tm.label_coverage(labelled, "geo").collect()] == [(2008, 2, 1)]
    assert [tuple(r) for r in tm.label_coverage(labelled).collect()] == [(2008, 2, 0)]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Pacific/Auckland"])
def test_a_trace_has_one_year_in_every_zone(spark, zone):
    line = spark.createDataFrame([("200801 10.0.0.1 1.5",), ("200712 10.0.0.1 1.5",)], "value string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        traces, _ = tm.parse_lines(line, "IPLANE")
        everywhere = ip_map(spark, [(0, "A", "X")])
        labelled = tm.label_hops(traces, everywhere)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        years = {r.year for r in tm.overview(tm.slice_years(tm.compress(labelled), [2008])).collect()}
        assert years == {2008}
        assert {r.year: r.n for r in tm.label_coverage(labelled).collect()} == {2007: 1, 2008: 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
