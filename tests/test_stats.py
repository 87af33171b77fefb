import bisect
import contextlib
import io
import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from tracemill.operators import stats
from tracemill.operators.stats import PERCENTILES, stat6

SIZES = [*range(1, 140), 500, 9_999, 10_099, 20_001]


def rank(n, k):
    """Rank of the k-th of 100 points among n sorted values: the least r with r/n at k hundredths, within a millionth."""
    return math.ceil((k / 100 - 1e-6) * n)


def points(values):
    """The distribution as defined: 100 points by rank from 100 values on, else one point for each value."""
    values, n = sorted(values), len(values)
    if n >= 100:
        return [(0.0, 0.0)] + [(k / 100, values[max(rank(n, k), 1) - 1]) for k in range(1, 101)]
    return [(0.0, 0.0)] + [(math.floor(100 * p + 0.5) / 100, v) for p, v in zip(shares(n), values)]


def shares(n):
    """1/n added up once, twice, ... n times."""
    return itertools.accumulate([1.0 / n] * n)


def percentile(cdf, p):
    if len(cdf) == 101:
        return cdf[p][1]
    k = bisect.bisect_left([q for q, _ in cdf], p / 100)
    (p0, v0), (p1, v1) = cdf[k - 1 : k + 1]
    return v0 + (v1 - v0) / (p1 - p0) * (p / 100 - p0)


# By hand: sorted values, then p25, p50, p75, p90.
SMALL = [
    ([4.0], (1.0, 2.0, 3.0, 3.6)),
    ([2.0, 6.0], (1.0, 2.0, 4.0, 5.2)),
    ([1.0, 2.0, 3.0, 10.0], (1.0, 2.0, 3.0, 7.2)),
    ([-5.0, 0.0, 0.0, 5.0, 20.0], (-3.75, 0.0, 3.75, 12.5)),
]


def test_small_groups_by_hand(spark):
    rows = [(g, v) for g, (values, _) in enumerate(SMALL) for v in values]
    got = {r.g: r for r in tm.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    for g, (_, want) in enumerate(SMALL):
        assert [got[g][f"p{p}"] for p in (25, 50, 75, 90)] == pytest.approx(want)


def test_every_hot_key_is_split(spark):
    """The plan is built without a job."""
    df = spark.range(30_000).select((F.col("id") % 3000).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    assert stats.hot_keys(df, ["g"], 10).count() == 3000
    cold, hot = stats.split_hot(df, ["g"], 10)
    assert (cold.count(), hot.count()) == (0, 30_000)
    cold, hot = stats.split_hot(df, ["g"], 11)
    assert (cold.count(), hot.count()) == (30_000, 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "")
    tm.percentiles(df, ["g"], "v", hot_rows=5), tm.cdf(df, ["g"], "v", hot_rows=5)
    assert list(tracker.getJobIdsForGroup("plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_largest_keys_are_hot_if_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(stats, "HOT_KEYS", 2)
    df = spark.createDataFrame([(g, float(v)) for g, n in (("a", 9), ("b", 7), (None, 8), ("c", 1)) for v in range(n)], "g string, v double")
    assert {r[0] for r in stats.hot_keys(df, ["g"], 5).collect()} == {"a", None}
    got = {r.g: (r.n, r.p50) for r in tm.percentiles(df, ["g"], "v", hot_rows=5).collect()}
    assert got == {"a": (9, pytest.approx(3.5)), "b": (7, pytest.approx(2.5)), None: (8, pytest.approx(3.0)), "c": (1, 0.0)}


def test_rows_of_a_key_are_brought_together_once(spark, tmp_path):
    """Without hot keys, all that moves are the rows by key and the counts that find hot keys."""
    rows = spark.range(1000).select((F.col("id") % 9).alias("g"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    none = spark.createDataFrame([], "_g long")
    wide = stats.wide_stats(rows, ["g"], {"a": F.col("a"), "b": F.col("b")}, hot=none)
    wide.collect()
    final = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", final)) == 1


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    out = {}
    for n in SIZES:
        if n % 3 == 0:
            out[n] = [float(rng.randint(-20, 20)) for _ in range(n)]
        else:
            out[n] = [rng.lognormvariate(3, 1) - 5 for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(n, v) for n, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g int, v double")


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_percentiles(table, groups, hot_rows):
    got = {r.g: r for r in tm.percentiles(table, ["g"], "v", hot_rows).collect()}
    assert set(got) == set(groups) and 24 in groups
    for n, values in groups.items():
        cdf = points(values)
        assert got[n].n == n
        for p in PERCENTILES:
            assert got[n][f"p{p}"] == pytest.approx(percentile(cdf, p), abs=1e-9), (n, p)


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_cdf(table, groups, hot_rows):
    got = {}
    for r in tm.cdf(table, ["g"], "v", hot_rows).collect():
        got.setdefault(r.g, []).append((r.prob, r.value))
    for n, values in groups.items():
        want = points(values)
        assert sorted(got[n]) == sorted(want), n
        assert len(want) == min(n, 100) + 1


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_moments(table, groups, hot_rows):
    long = table.select("g", F.lit("m").alias("metric"), F.col("v").alias("value"))
    got = {r.g: r for r in stat6(long, ["g"], hot_rows=hot_rows).collect()}
    for n, values in groups.items():
        mean, stdev = statistics.fmean(values), statistics.pstdev(values)
        assert (got[n].min, got[n].max) == (min(values), max(values))
        assert got[n].avg == pytest.approx(mean, abs=1e-9)
        assert got[n].stdev == pytest.approx(stdev, abs=1e-9)
        assert got[n].cv == pytest.approx(0.0 if mean <= 0 else stdev / mean, rel=1e-9)


def test_a_key_with_most_of_the_rows(spark):
    """One key holds nearly everything; its values are still ranked exactly."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(-1).alias("g"),
        (F.col("id") * 7919 % 200_003 / 10).alias("v"),
    )
    row = tm.percentiles(df, ["g"], "v", hot_rows=50_000).where("g = -1").first()
    values = [i * 7919 % 200_003 / 10 for i in range(200_000) if i % 100]
    cdf = points(values)
    assert row.n == len(values)
    assert [row[f"p{p}"] for p in PERCENTILES] == [cdf[p][1] for p in PERCENTILES]


def test_missing_values_and_keys(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("a", 2.0), ("a", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for hot_rows in (1_000_000, 1):
        got = {r.g: r for r in tm.percentiles(df, ["g"], "v", hot_rows).collect()}
        assert {g: r.n for g, r in got.items()} == {None: 2, "a": 1}
        # a single value is interpolated from the anchor
        assert got["a"].p25 == pytest.approx(0.5) and got["a"].p50 == pytest.approx(1.0)


def test_min_count(table):
    long = table.select("g", F.lit("m").alias("metric"), F.col("v").alias("value"))
    assert {r.g for r in stat6(long, ["g"], min_count=100).collect()} == {n for n in SIZES if n >= 100}


def test_correlation(spark):
    rows = [("c", float(x), 5.0) for x in range(4)] + [("l", float(x), 2.0 * x + 1) for x in range(4)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in tm.correlation(df, ["g"], "x", "y").collect()}
    assert got["c"].pearson is None and got["c"].covariance == 0.0
    assert got["l"].pearson == pytest.approx(1.0) and got["l"].covariance == pytest.approx(2.5)


def test_moment_table_of_negatives(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", -3.0)], "g string, v double")
    row = tm.moment_table(df, ["g"], "v").first()
    assert (row.avg, row.variance, row.stdev, row.cv) == (-2.0, 1.0, 1.0, 0.0)


def test_without_keys(table, groups):
    everything = sorted(v for values in groups.values() for v in values)
    row = tm.percentiles(table, [], "v").first()
    assert row.n == len(everything)
    assert [row[f"p{p}"] for p in PERCENTILES] == [points(everything)[p][1] for p in PERCENTILES]


def _traces(spark, n=600):
    """Label traces with few, many and missing values a key."""
    return spark.range(n).selectExpr(
        "CAST(id AS STRING) AS trace_id",
        "CAST(2008 + id % 2 AS INT) AS year",
        "CASE WHEN id % 11 < 10 THEN CAST(id % 37 AS STRING) END AS from_ip",
        "CAST(id % 3 AS STRING) AS dst",
        "transform(sequence(0, 1 + CAST(id % 3 AS INT)), k -> CAST((id * k) % 7 AS STRING)) AS hops",
        "transform(sequence(0, 2 + 2 * CAST(id % 3 AS INT)), k -> CAST((id * 7 + k) % 50 AS DOUBLE)) AS segment_lats",
        "CAST(2 + id % 3 AS INT) AS num_hops",
        "CAST(3 + id % 5 AS INT) AS raw_hops",
        "CAST(id * 13 % 101 AS DOUBLE) AS e2e",
        "CAST(id % 100 AS DOUBLE) AS inside_pct",
    )


def _plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def _rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in df.select(*sorted(df.columns)).collect())


REPORTS = {
    # Values: six metrics of 600 rows; 1 to 3 links of each trace; three metrics.
    "edge_stats": (3600, tm.edge_stats),
    "link_stats": (1200, tm.link_stats),
    "pair_stats": (1800, lambda lt: tm.pair_stats(lt, ("from_ip", "dst"), prevalence=False)),
}


@pytest.mark.parametrize("name", REPORTS)
def test_tasks_grow_with_the_values(spark, monkeypatch, name):
    values, report = REPORTS[name]
    traces = _traces(spark)
    want = _rows(report(traces))
    assert len(want) > 30
    monkeypatch.setattr(stats, "VALUES_A_TASK", 100)
    got = report(traces)
    assert f", {values // 100}), REPARTITION_BY_NUM" in _plan(got)
    assert _rows(got) == want
    assert _rows(report(traces.limit(0))) == []


def test_groups_are_summed_in_the_order_of_their_ranks(spark):
    """Beside the two hash tables that count equal values there is none, and no second sort of all rows."""
    ranks = stats._cold_ranks(stats._together(_traces(spark).selectExpr("year", "dst AS metric", "e2e AS value"), ["year", "metric"], tasks=3), ["year", "metric"])
    plan = _plan(stats._summary(ranks, stats.small_group_points(spark), ["year", "metric"]))
    assert (plan.count("HashAggregate("), plan.count("SortAggregate("), plan.count("Sort [")) == (2, 2, 1), plan
