"""Tables that grow part by part against the same figures from all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

import tracemill as tm

SCHEMA = "g string, h int, v double, w double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), -0.0, 0.0, rng.gauss(0, 30), float(rng.randrange(9)), 1e12 + rng.randrange(5)])
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), value(), value()) for _ in range(3000)] + [("lone", 0, 4.5, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def counts(spark, table, tmp_path_factory):
    """Three parts in any order, one written twice."""
    path = str(tmp_path_factory.mktemp("parts") / "counts")
    third = F.pmod(F.xxhash64("g", "h", "v", "w"), F.lit(3))
    metrics = {"v": F.col("v"), "w": F.col("w")}
    for part, some in (("2009-02", third != 0), ("2009-03", third == 2), ("2009-01", third == 0), ("2009-02", third == 1)):
        tm.write_part(tm.value_counts(table.where(some), ["g", "h"], metrics), path, part)
    return tm.read_parts(spark, path)


def listed(df):
    """Rows with doubles to nine digits."""
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else repr(x)
    return sorted([text(x) for x in row] for row in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("keys, hot_rows", [(["g"], 50), (["g", "h"], 1_000_000), ([], 1_000_000)])
def test_statistics(table, counts, keys, hot_rows):
    mine = counts.where("metric = 'v'")
    got = tm.count_stats(mine, keys, hot_rows=hot_rows).drop("metric")
    assert listed(got) == listed(tm.value_stats(table, keys, "v"))
    points = tm.count_cdf(mine, keys, hot_rows).drop("metric")
    assert listed(points) == listed(tm.cdf(table.withColumn("v", F.col("v") + 0.0), keys, "v"))


def test_histogram_and_merge(table, counts):
    known = table.where("v IS NOT NULL AND NOT isnan(v)")
    whole = F.least(F.greatest("v", F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("int").alias("whole")
    want = known.groupBy("h", whole).agg(F.count(F.lit(1)).alias("n"))
    assert listed(tm.count_histogram(counts, ["h"], "v", "whole")) == listed(want)
    merged = tm.merge_counts(counts, ["g"])
    assert merged.groupBy("g", "metric", "value").count().where("count > 1").count() == 0
    assert listed(tm.count_stats(merged, ["g"])) == listed(tm.count_stats(counts, ["g"]))
    assert tm.count_stats(counts, ["g"], min_count=2).where("g = 'lone'").count() == 0


def test_parts_by_name(spark, counts, tmp_path):
    path = str(tmp_path / "t")
    for part, n in (("01", 3), ("1", 2), ("x", 1)):
        tm.write_part(spark.range(n), path, part)
    sizes = lambda df: {r.part: r["count"] for r in df.groupBy("part").count().collect()}
    assert sizes(tm.read_parts(spark, path)) == {"01": 3, "1": 2, "x": 1}
    files = sorted((tmp_path / "t").glob("part=*/*.parquet"))
    tm.write_part(spark.range(5), path, "1")
    after = sorted((tmp_path / "t").glob("part=*/*.parquet"))
    assert [f for f in files if "part=1/" not in str(f)] == [f for f in after if "part=1/" not in str(f)]
    assert sizes(tm.read_parts(spark, path, ["1", "x"])) == {"1": 5, "x": 1}


# --- paths ----------------------------------------------------------------------------------------

TRACES = "k string, ts timestamp, trace_id string, hops array<string>"


def traces(spark, seed, days):
    """Traces of some keys, many at equal times; the first column says which part they go to."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        day = rng.randrange(1, days)
        rows.append((rng.choice(["a", "a", None, "b", "c"]), f"2009-01-{day:02d} 00:00:00", f"t{rng.randrange(10**6)}-{i}", ["x", rng.choice("yz")]))
    frame = spark.createDataFrame(rows, "k string, day string, trace_id string, hops array<string>")
    return frame.select("k", F.to_timestamp("day").alias("ts"), "trace_id", "hops").cache()


@pytest.mark.parametrize(
    "cut, hot_rows", [("days", 1_000_000), ("random", 40), ("both", 1_000_000), ("both", 40), ("equal times", 40)]
)
def test_prevalence_appended(spark, tmp_path, cut, hot_rows):
    table = traces(spark, len(cut), 4 if cut == "equal times" else 25)
    day = F.dayofmonth("ts")
    random_part = F.pmod(F.xxhash64("trace_id"), F.lit(3)).cast("string")
    by_day = F.floor(day / 6).cast("string")
    part = {"days": by_day, "random": random_part, "both": F.when(day < 12, by_day).otherwise(random_part), "equal times": random_part}[cut]
    named = table.withColumn("name", part)
    names = [r[0] for r in named.select("name").distinct().collect()]
    random.Random(3).shuffle(names)
    path = str(tmp_path / "paths")
    for name in names:
        tm.write_paths(named.where(F.col("name") == name), ["k"], path, name, hot_rows)
    tm.write_paths(named.where(F.col("name") == names[0]), ["k"], path, names[0], hot_rows)
    got = tm.read_prevalence(spark, path, ["k"], named, hot_rows=hot_rows)
    assert listed(got) == listed(tm.path_prevalence(table, ["k"]))
    some = tm.read_prevalence(spark, path, ["k"], named.where(F.col("name") != names[0]), names[1:], hot_rows)
    assert listed(some) == listed(tm.path_prevalence(named.where(F.col("name") != names[0]), ["k"]))


def test_only_overlapping_spans_are_read_again(spark, tmp_path):
    """Traces outside the spans in which parts overlap may be gone."""
    table = traces(spark, 9, 25)
    day = F.dayofmonth("ts")
    odd = F.pmod(F.xxhash64("trace_id"), F.lit(2)) == 1
    parts = {"first": day < 10, "second": (day >= 10) & (day < 17) & odd, "third": (day >= 10) & (day < 17) & ~odd, "last": day >= 17}
    for name, rows in parts.items():
        tm.write_paths(table.where(rows), ["k"], str(tmp_path), name)
    left = table.where((day >= 10) & (day < 17))
    assert listed(tm.read_prevalence(spark, str(tmp_path), ["k"], left)) == listed(tm.path_prevalence(table, ["k"]))
