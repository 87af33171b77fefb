import gzip

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from tracemill.functions import ip_to_number, prefix_start, slash24_number, slash24_text


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def one(spark, dataset, text):
    traces, bad = tm.parse_lines(lines(spark, text), dataset)
    assert bad.count() == 0
    return traces.first()


def reasons(spark, dataset, *texts):
    bad = tm.parse_lines(lines(spark, *texts), dataset)[1]
    return {r.value: r.reason for r in bad.collect()}


def number(text):
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


HOPS = [number("10.0.0.1"), number("10.0.1.1"), number("9.9.9.9")]


def test_ark(spark):
    row = one(
        spark, "ARK", "20080312 1.1.1.1 9.9.9.9 MOS 10.0.0.1 0.5 10.0.1.1 2.25 9.9.9.9 7.0  "
    )
    assert (row.region, row.target, row.num_hops, row.e2e) == ("1.1.1.1", "9.9.9.9", 3, 7.0)
    assert row.hops == HOPS and row.lats == [0.5, 2.25, 7.0]
    assert row.year == 2008 and str(row.ts) == "2008-03-01 00:00:00"


def test_ark_ignores_an_odd_last_word(spark):
    row = one(spark, "ARK", "200803 a b MOS 10.0.0.1 0.5 10.0.1.1")
    assert row.num_hops == 1 and row.e2e == 0.5


def test_iplane(spark):
    row = one(spark, "IPLANE", "200901 10.0.0.1 0.5 10.0.1.1 2.5 9.9.9.9 8")
    assert (row.region, row.target) == ("10.0.0.1", "9.9.9.9")
    assert row.hops == HOPS and row.lats == [0.5, 2.5, 8.0]


def test_cdn_rounds_half_up(spark):
    row = one(spark, "LARGECDN", "a,b,1230768000,7,9.9.9.9,1:10.0.0.1_0.5|2:10.0.1.1_2.49|3:9.9.9.9_7.5")
    assert (row.region, row.target, row.lats) == ("7", "9.9.9.9", [1.0, 2.0, 8.0])
    assert str(row.ts) == "2009-01-01 00:00:00"
    row = one(spark, "LARGECDN", "a,b,1230768000,7,t,1:10.0.0.1_-0.5|2:10.0.1.1_-1.5|")
    assert row.lats == [0.0, -1.0]


def test_bad_lines(spark):
    texts = {
        "200813 10.0.0.1 1": "date",
        "2008 10.0.0.1 1": "date",
        "": "date",
        " 200812 10.0.0.1 1": "date",
        "200812": "hops",
        "200812 10.0.0.1 1 10.0.0.2": "hops",
        "200812 10.0.1 1": "address",
        "200812 10.0.x.1 1": "address",
        "200812 10.0.0.1 fast": "latency",
        "200812 10.0.0.1 NaN": "latency",
    }
    assert reasons(spark, "IPLANE", *texts) == texts
    assert reasons(spark, "ARK", "200812 a b MOS", "200812 a") == {
        "200812 a b MOS": "hops",
        "200812 a": "hops",
    }
    broken = "a,b,now,7,t,1:10.0.0.1_5"
    assert reasons(spark, "LARGECDN", broken, "a,b,5,7,t", "a,b,5,7,t,") == {
        broken: "date",
        "a,b,5,7,t": "hops",
        "a,b,5,7,t,": "address",
    }
    with pytest.raises(ValueError):
        tm.parse_lines(lines(spark, "x"), "OTHER")


def test_clean_lines_are_substring_tests(spark):
    texts = ["a MOS 1.2.3.4", "a 1.2.3.4", "MOS 110.0.0.0", "MOS 0.0.0.0", "MOS x-y", "MOS -1"]
    kept = tm.clean_lines(lines(spark, *texts), "ARK")
    assert [r.value for r in kept.collect()] == texts[:1]
    assert tm.clean_lines(lines(spark, *texts), "IPLANE").count() == 2


def test_files_gzip_and_duplicates(spark, tmp_path):
    text = "200901 10.0.0.1 0.5 9.9.9.9 8\n" * 3 + "bad line\n"
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write(text)
    (tmp_path / "b.txt").write_text(text)
    traces, bad = tm.read_traces(spark, str(tmp_path), "IPLANE", partitions=3)
    assert traces.count() == 6 and bad.count() == 2
    assert traces.select("trace_id").distinct().count() == 6
    assert traces.rdd.getNumPartitions() == 3
    headers = tm.trace_headers(traces)
    assert "hops" not in headers.columns and "lats" not in headers.columns
    assert {r.path.split("/")[-1] for r in bad.collect()} == {"a.gz", "b.txt"}


def test_ip_map_later_line_wins(spark, tmp_path):
    (tmp_path / "map").write_text(
        "16777216 AS1 us Oakland\n5 AS2 de\n16777216 AS3 fr\nx AS4 de\n7 AS5\n16777216 AS9 it rome extra \n"
    )
    ip_map, bad = tm.read_ip_map(spark, str(tmp_path / "map"))
    assert sorted(tuple(r) for r in ip_map.collect()) == [
        (5, "AS2", "DE"),
        (16777216, "AS9", "ROME@IT"),
    ]
    assert sorted(r.value for r in bad.collect()) == ["7 AS5", "x AS4 de"]


def test_ip_map_order_over_many_blocks(spark, tmp_path):
    path = tmp_path / "map"
    path.write_text("".join(f"{i % 10} AS{i} de\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        ip_map = tm.read_ip_map(spark, str(path))[0].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.range_start: r.as_no for r in ip_map} == {i % 10: f"AS{i}" for i in range(1990, 2000)}


def test_addresses(spark):
    row = spark.range(1).select(
        ip_to_number(F.lit("1.2.3.4.5")).alias("five"),
        ip_to_number(F.lit("300.0.0.1")).alias("large"),
        ip_to_number(F.lit("1.2.3")).alias("three"),
        ip_to_number(F.lit("9223372036854775807.1.1.1")).alias("huge"),
        prefix_start(F.lit("10.1.2.3/16")).alias("p16"),
        prefix_start(F.lit("10.1.2.3/32")).alias("p32"),
        prefix_start(F.lit("10.1.2.3/0")).alias("p0"),
        prefix_start(F.lit("10.1.2.3")).alias("none"),
        slash24_number(F.lit(number("10.1.2.3"))).alias("s24"),
        slash24_text(F.lit("10.1.2.3")).alias("t24"),
        slash24_text(F.lit("host")).alias("nodot"),
    ).first()
    assert row.five == number("1.2.3.4") and row.large == 300 * 2**24 + 1
    assert row.three is None and row.none is None
    # 64-bit shifts wrap around
    assert row.huge == -(2**24) + number("0.1.1.1")
    assert (row.p16, row.p32, row.p0) == (number("10.1.0.0"), number("10.1.2.3"), 0)
    assert row.s24 == number("10.1.2.0") and row.t24 == "10.1.2" and row.nodot == ""


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "text"])
def test_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [(2008, "a", 2, ["x", "y"]), (2009, "b", 1, [])], "year int, dst string, n long, upstream array<string>"
    )
    path = str(tmp_path / fmt)
    tm.write_report(df, path, fmt, dataset="ARK", order_by=["n"])
    assert (tmp_path / fmt / "dataset=ARK" / "year=2008").is_dir()
    reader = spark.read.option("header", "false")
    back = reader.format(fmt).load(path)
    assert back.count() == 2
    if fmt == "text":
        assert sorted(r.value for r in back.collect()) == ["(a,2,x y)", "(b,1,)"]


def test_nested_folders_are_read(spark, tmp_path):
    (tmp_path / "2008" / "b").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("200801 10.0.0.1 1\n")
    (tmp_path / "2008" / "b" / "c.txt").write_text("200802 10.0.0.1 1\n")
    assert tm.read_lines(spark, str(tmp_path), "IPLANE").count() == 2


def test_ids_do_not_depend_on_the_splits(spark, tmp_path):
    texts = [f"2008{1 + k % 9:02d} 10.0.0.{k % 50} {k % 3}" for k in range(300)] + ["200801 10.0.0.1 1"] * 2500
    (tmp_path / "lines.txt").write_text("\n".join(texts))
    found = []
    for size in ("1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = tm.read_traces(spark, str(tmp_path), "IPLANE", clean=False)[0].select("trace_id", "year", "e2e").collect()
        found.append(sorted(map(tuple, rows)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({i for i, _, _ in found[0]}) == len(texts)


def test_seconds_without_a_timestamp(spark):
    texts = [f"a,b,{s},7,t,1:10.0.0.1_5" for s in ("1230768000000000", "-1230768000000000", "99999999999999999999")]
    assert reasons(spark, "LARGECDN", *texts) == dict.fromkeys(texts, "date")


def test_starts_outside_the_address_space(spark):
    rows = spark.createDataFrame([("-5 1 us", 1), (f"{2**32} 2 us", 2), ("7 3 us", 3)], "value string, line_order int")
    ip_map, bad = tm.sources.ipmap.parse_ip_map(rows)
    assert [r.range_start for r in ip_map.collect()] == [7]
    assert bad.count() == 2


def test_traces_move_once_from_text_to_labels(spark, tmp_path):
    """One exchange by the digest of the line; headers do not carry the hops through it."""
    (tmp_path / "t.txt").write_text("200901 10.0.0.1 0.5 10.0.1.1 2.5\n" * 3 + "200902 10.0.0.1 0.5\n")
    ip_map = spark.createDataFrame([(1, "AS1", "US")], "range_start long, as_no string, geo string")
    traces, _ = tm.parse_lines(tm.read_lines(spark, str(tmp_path), "IPLANE"), "IPLANE")
    labelled = tm.label_hops(traces, ip_map)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(digest" in plan
    assert sorted(len(r.hops) for r in labelled.collect()) == [1, 2, 2, 2]
    assert labelled.select("trace_id").distinct().count() == 4
    headers = tm.trace_headers(traces).select("region", "num_hops")._jdf.queryExecution().optimizedPlan().toString()
    assert "first(lats" not in headers and "first(num_hops" in headers

