"""One year run again, years and ALL together, accounts of lines, and tables laid out by key."""

import os
import re

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from workload import fixture as fx

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hops") / "labelled")
    tm.label_hops(fx.traces(spark, SF_DIR), fx.ip_map(spark, SF_DIR)).write.partitionBy("year").parquet(path)
    return path


@pytest.fixture(scope="module")
def traces(spark, labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("traces") / "geo")
    tm.compress(spark.read.parquet(labelled), "geo").write.parquet(path)
    return spark.read.parquet(path)


def files(path):
    """Every data file with its time of change."""
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in found}


def listed(df, but=()):
    return sorted(map(repr, df.select(*sorted(set(df.columns) - set(but))).collect()))


def test_one_year_again(spark, labelled, tmp_path):
    out = str(tmp_path / "geo")
    tm.run_analysis(spark, "geo", "ARK", labelled, out, years=(1996, 1997))
    first = {name: files(f"{out}/{name}") for name in os.listdir(out)}
    before = {name: listed(spark.read.parquet(f"{out}/{name}")) for name in first}
    # the traces of a year have changed since
    changed = str(tmp_path / "changed")
    hops = spark.read.parquet(labelled).where("year <> 1997 OR from_ip > '5'")
    hops.write.partitionBy("year").parquet(changed)
    paths = tm.run_analysis(spark, "geo", "ARK", changed, out, years=(1997,), replace=True)
    for name, old in first.items():
        if name == "coverage":
            continue
        now = files(f"{out}/{name}")
        assert {f: t for f, t in old.items() if "year=1996" in f} == {f: t for f, t in now.items() if "year=1996" in f}
        assert not {f for f in old if "year=1997" in f} & {f for f in now if "year=1997" in f}
    again = spark.read.parquet(paths["srcs_stats"])
    want = tm.endpoint_stats(tm.compress(hops.where("year = 1997"), "geo"), "src")
    assert listed(again.where("year = 1997"), ["dataset"]) == listed(want)
    with pytest.raises(Exception, match="already exists"):
        tm.run_analysis(spark, "geo", "ARK", labelled, out, years=(1997,))
    # a second dataset beside the first
    tm.run_analysis(spark, "geo", "IPLANE", labelled, out, years=(1996,), replace=True)
    both = spark.read.parquet(paths["srcs_stats"])
    assert {tuple(r) for r in both.select("dataset", "year").distinct().collect()} == {("ARK", 1996), ("ARK", 1997), ("IPLANE", 1996)}
    assert len(before["srcs_stats"]) > 0


def test_years_and_all_at_once(spark, labelled, tmp_path, traces):
    paths = tm.run_analysis(spark, "as-city", "ARK", labelled, str(tmp_path / "as"), years=None, min_count=5, all_years=True)
    for name in ("overview", "hop_dist", "srcs_stats", "multihoming", "bigrams", "degree_dist", "pair_stats"):
        slices = {r[0] for r in spark.read.parquet(paths[name]).select("slice").distinct().collect()}
        assert "ALL" in slices and (name == "pair_stats" or len(slices) > 2)
    reports = {
        "overview": lambda by: tm.overview(traces, by),
        "hop_dist": lambda by: tm.distribution(traces, "num_hops", by),
        "srcs_stats": lambda by: tm.endpoint_stats(traces, "src", by),
        "multihoming": lambda by: tm.multihoming(traces, by),
    }
    for name, report in reports.items():
        both = report(tm.YEARS_AND_ALL)
        rounded = lambda df: df.select([F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
        assert listed(rounded(both.where("slice = 'ALL'").drop("slice"))) == listed(rounded(report(())))
        years = both.where("slice <> 'ALL'").withColumn("year", F.col("slice").cast("int")).drop("slice")
        assert listed(rounded(years)) == listed(rounded(report(("year",))))


def test_years_and_all_take_one_scan_and_one_exchange(traces):
    for report in (tm.overview(traces, tm.YEARS_AND_ALL), tm.endpoint_stats(traces, "src", tm.YEARS_AND_ALL)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Expand" in plan


def test_a_year_that_is_not_known_is_no_all(spark):
    rows = [(None, 1, 2, 1.0), (2008, 3, 4, 2.0)]
    table = spark.createDataFrame(rows, "year int, num_hops int, raw_hops int, e2e double")
    got = {r.slice: r.n for r in tm.overview(table, tm.YEARS_AND_ALL).collect()}
    assert got == {None: 1, "2008": 1, "ALL": 2}


def test_account_of_lines(spark, tmp_path):
    ark = ["20080312 a b MOS 10.0.0.1 0.5", "20080312 a b MOS 10.0.0.1 0.5", "20080312 a b ERR 10.0.0.1 0.5", "20080312 a b ERR 0.0.0.0 -1",
           "20080312 a b MOS 10.0.0.0 0.5", "20080312 a b MOS 10.0.0.1 -0.5", "20081312 a b MOS 10.0.0.1 1", "20080312 a b MOS", "20080312 a b MOS x 1",
           "20080312 a b MOS 10.0.0.1 x"]
    lines = spark.createDataFrame([(v,) for v in ark], "value string").repartition(3)
    checked, account = tm.account_lines(lines, "ARK")
    checked.write.parquet(str(tmp_path / "checked"))
    got = {(r.step, r.name): r.n for r in tm.line_counts(spark, account).collect()}
    assert got == {
        ("read", "lines"): 10, ("kept", "traces"): 2, ("dropped", "incomplete"): 2, ("dropped", "sentinel"): 1, ("dropped", "hyphen"): 1,
        ("bad", "date"): 1, ("bad", "hops"): 1, ("bad", "address"): 1, ("bad", "latency"): 1, ("bad", "endpoint"): 0,
    }
    assert spark.read.parquet(str(tmp_path / "checked")).count() == 6
    assert listed(tm.check_lines(tm.clean_lines(lines, "ARK"), "ARK")) == listed(spark.read.parquet(str(tmp_path / "checked")))


def test_label_dataset_accounts_for_its_lines(spark, tmp_path):
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "t.txt").write_text("200901 10.0.0.1 0.5\n200901 0.0.0.0 1\n200901 10.0.0.1 -1\n200913 10.0.0.1 1\n")
    (tmp_path / "map.txt").write_text("1 AS1 us\n")
    tm.label_dataset(spark, "IPLANE", str(tmp_path / "traces"), str(tmp_path / "map.txt"), str(tmp_path / "out"))
    counts = {(r.step, r.name): r.n for r in spark.read.json(str(tmp_path / "out" / "line_counts")).collect()}
    assert counts[("read", "lines")] == 4 == sum(n for (step, _), n in counts.items() if step != "read")
    assert (counts[("kept", "traces")], counts[("bad", "date")], counts[("dropped", "hyphen")]) == (1, 1, 1)


# --- layout -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def placed(spark, traces, tmp_path_factory):
    return tm.store_by_key(traces, "traces_by_pair", str(tmp_path_factory.mktemp("layout") / "t"), ("src", "dst"), 3)


def moved(df):
    """Exchanges by a hash in the plan that was run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_reports_of_a_table_laid_out_by_key(spark, traces, placed):
    for by in (("year",), ()):
        got = tm.pair_stats(placed, by=by, placed=True)
        assert listed(got) == listed(tm.pair_stats(traces, by=by))
    stats = tm.wide_stats(placed, ["year", "src", "dst"], {"latency": F.col("e2e"), "hops": F.col("num_hops")}, placed=True)
    assert moved(stats) == []
    assert len(moved(tm.wide_stats(traces, ["year", "src", "dst"], {"latency": F.col("e2e")}))) >= 1
    assert listed(tm.edge_stats(placed, ("src", "dst"), placed=True)) == listed(tm.edge_stats(traces, ("src", "dst")))


def test_a_table_of_another_session(spark, traces, placed):
    path = spark.sql("DESCRIBE FORMATTED traces_by_pair").where("col_name = 'Location'").first()["data_type"]
    again = tm.open_by_key(spark, "traces_again", path, placed.schema, ("src", "dst"), 3)
    assert again.count() == traces.count()
    stats = tm.wide_stats(again, ["src", "dst"], {"latency": F.col("e2e")}, placed=True)
    assert moved(stats) == []
