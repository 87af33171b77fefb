import gzip

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from workload import fixture as fx

SF_DIR = "/root/testdata/sf0.001"
YEARS = (1996, 1997)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("ark")
    traces = fx.traces(spark, SF_DIR)
    fx.ark_lines(traces).write.option("compression", "gzip").text(str(base / "traces"))
    with gzip.open(base / "traces" / "extra.gz", "wt") as f:
        f.write("20080101 a b MOS 1.0.0.1 x\n20080101 a b MOS 0.0.0.0 1\n")
    lines = fx.ip_map(spark, SF_DIR).select(
        F.concat_ws(" ", F.col("range_start").cast("string"), "as_no", F.split("geo", "@")[1])
    )
    lines.write.text(str(base / "map"))
    path = tm.label_dataset(
        spark, "ARK", str(base / "traces"), str(base / "map"), str(base / "out"), partitions=4
    )
    return base, path


REPORTS = {
    "as": "coverage overview hop_dist raw_hop_dist latency_dist pair_stats srcs_stats dsts_stats "
    "multihoming bigrams degree_dist",
    "as-city": "coverage overview hop_dist raw_hop_dist latency_dist pair_stats srcs_stats dsts_stats "
    "multihoming bigrams degree_dist",
    "geo": "coverage pair_stats srcs_stats dsts_stats bigrams",
    "geoas": "coverage pair_stats srcs_stats dsts_stats bigrams degree_dist edge_stats",
}


@pytest.mark.parametrize("kind", sorted(REPORTS))
def test_analysis(spark, labelled, tmp_path, kind):
    base, path = labelled
    out = str(tmp_path / kind)
    paths = tm.run_analysis(spark, kind, "ARK", path, out, years=YEARS, min_count=5)
    assert set(paths) == set(REPORTS[kind].split())
    total = fx.traces(spark, SF_DIR).where(F.col("year").isin(*YEARS) & (F.col("status") != "P")).count()
    for name, report in paths.items():
        df = spark.read.parquet(report)
        if name == "coverage":  # counts the years without a report as well
            assert {r.year for r in df.where("reported").collect()} == set(YEARS)
            assert df.where("NOT reported").agg(F.sum("n")).first()[0] > 0
            df = df.where("reported")
        assert {r.year for r in df.select("year").distinct().collect()} <= set(YEARS)
        assert {r.dataset for r in df.select("dataset").distinct().collect()} == {"ARK"}
        if name in ("coverage", "hop_dist", "srcs_stats", "dsts_stats"):
            assert df.agg(F.sum("n")).first()[0] == total
    assert spark.read.json(str(base / "out" / "bad_lines")).count() == 1


def test_all_years_and_no_rows(spark, labelled):
    hops = spark.read.parquet(labelled[1])
    table = tm.compress(hops)
    everything = tm.overview(table, by=()).first()
    assert everything.n == table.count()
    assert tm.overview(tm.slice_years(table, [1900])).count() == 0
    assert tm.slice_years(table, None).count() == everything.n


def test_year_reaches_the_partition_filter(spark, labelled):
    hops = tm.slice_years(spark.read.parquet(labelled[1]), YEARS)
    plan = hops._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_text_is_read_once(spark, labelled):
    """Labelled hops and rejected lines come from the one table that the text was parsed into."""
    base, _ = labelled
    checked = spark.read.parquet(str(base / "out" / "checked_lines"))
    traces, bad = tm.split_checked(checked)
    for table in (traces, bad):
        text = table._jdf.queryExecution().executedPlan().toString()
        assert "checked_lines" in text and "FileScan text" not in text
    assert traces.count() + bad.count() == checked.count()
    assert checked.where("reason IS NULL AND value IS NOT NULL").count() == 0


def test_files_follow_the_years(spark, labelled):
    """One file or few for each year, not one from each task."""
    files = spark.read.parquet(labelled[1]).inputFiles()
    years = {f.split("year=")[1].split("/")[0] for f in files}
    assert len(files) <= 2 * len(years)


def test_degree_is_sorted(spark, labelled):
    df = tm.degree_dist(tm.compress(spark.read.parquet(labelled[1])), by=())
    degrees = [r.degree for r in df.collect()]
    assert degrees == sorted(degrees, reverse=True) and degrees


def test_multihoming_lists_single_label_destinations(spark):
    df = spark.createDataFrame(
        [(2008, "d", ["d"], 1), (2008, "e", ["x", "e"], 2), (2008, "e", ["y", "e"], 2), (2008, "e", ["x", "e"], 2)],
        "year int, dst string, hops array<string>, num_hops int",
    )
    got = {r.dst: (r.n_upstream, r.upstream) for r in tm.multihoming(df).collect()}
    assert got == {"d": (0, []), "e": (2, ["x", "y"])}


def test_latency_is_cut_toward_zero(spark):
    df = spark.createDataFrame([(2008, v) for v in (-1.9, -0.5, 0.5, 1.9, 1e12)], "year int, e2e double")
    got = {r.latency: r.n for r in tm.latency_hist(df).collect()}
    assert got == {-1: 1, 0: 2, 1: 1, 2**31 - 1: 1}
