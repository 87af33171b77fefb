"""The library from SQL alone."""

import pytest
from pyspark.sql import functions as F

import tracemill as tm
from tracemill import functions as fn
from tracemill import sql

TEXTS = ["10.0.0.1", "1.2.3", "1.2.3.4.5", "300.1.1.1", "a.b.c.d", "", None, "10.1.2.3/8", "10.1.2.3/33", "10.1.2.3/x", "255.255.255.255/0",
         "200902", "200913", "20090230", "20090228", "2009"]


@pytest.mark.parametrize(
    "name", ["ip_to_number", "prefix_length", "prefix_start", "slash24_text", "month_start", "day_start"]
)
def test_functions_of_text(spark, name):
    sql.register_functions(spark)
    table = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    pairs = table.select("x", getattr(fn, name)(F.col("x")).alias("a"), F.expr(f"{name}(x)").alias("b")).collect()
    assert all(r.a == r.b for r in pairs) and any(r.a is not None for r in pairs)


def test_other_functions(spark):
    names = sql.register_functions(spark)
    assert len(names) == len(set(names))
    row = spark.sql(
        "SELECT number_to_ip(167772161L) AS ip, slash24(167772161L) AS net, utc_year(TIMESTAMP '2008-12-31 23:59:59') AS year, "
        "month_text(TIMESTAMP '2009-02-03 04:05:06') AS month, day_text(TIMESTAMP '2009-02-03 04:05:06') AS day, "
        "coefficient_of_variation(2D, 1D) AS cv, coefficient_of_variation(-2D, 1D) AS none, "
        "path_text(array('a', 'b')) AS path, has_cycle(array('a', 'b', 'a')) AS cycle"
    ).first()
    assert tuple(row) == ("10.0.0.1", 167772160, 2008, "200902", "20090203", 0.5, 0.0, "a-b", True)


def test_reports(spark):
    hops = "a b b c"
    rows = [(f"t{k}", 2008 + k % 3, "a", "c", hops.split(), float(k)) for k in range(9)]
    table = spark.createDataFrame(rows, "trace_id string, year int, src string, dst string, hops array<string>, e2e double").withColumns(
        {
            "ts": F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
            "from_ip": F.lit("1.1.1.1"), "segment_lats": F.array(*[F.lit(1.0)] * 7), "num_hops": F.lit(4), "raw_hops": F.lit(5),
            "inside_pct": F.lit(50.0),
        }
    )
    names = sql.register_reports(spark, table, "as", min_count=1)
    assert {"label_traces", "links", "overview", "pair_stats", "bigrams", "degree_dist"} <= set(names)
    assert [r.n for r in spark.sql("SELECT n FROM overview_of(2009, 2010)").collect()] == [3, 3]
    row = spark.sql("SELECT n, latency_p50, num_paths FROM pair_stats_of(2008, 2008) WHERE src = 'a'").first()
    assert (row.n, row.num_paths) == (3, 1) and 0 < row.latency_p50 < 6
    assert spark.sql("SELECT link FROM links WHERE year = 2008").distinct().count() == 3
    want = tm.link_stats(table).where("year = 2009").select("link", "n").collect()
    assert sorted(spark.sql("SELECT link, n FROM bigrams_of(2009, 2009)").collect()) == sorted(want)
