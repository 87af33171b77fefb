"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores), BENCH_QUERIES (comma list),
BENCH_RUNS (warm runs, the median counts). Every query derives its traces from the tables and labels them
first; ``fixture`` states what that alone takes, so the operator's own time is the difference.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.session import drop_stored  # noqa: E402
from workload.registry import FIXTURES, QUERIES  # noqa: E402

HEADLINE = (
    "src_ark",
    "ip_floor_join",
    "ip_floor_join_shuffled",
    "compress_as",
    "compress_geo",
    "overview",
    "latency_hist",
    "pair_stats_as",
    "pair_stats_geo",
    "pair_stats_geoas",
    "src_stats",
    "dst_stats",
    "multihoming",
    "link_stats",
    "degree_dist",
    "edge_stats",
    "agg_percentiles",
    "agg_cdf",
    "path_prevalence",
    "path_efficiency",
    "rollup_slash24",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str, queries=QUERIES) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        drop_stored(spark)
        return took

    timings = {}
    for name in names:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    fixture = {name: round(min(once(name, FIXTURES) for _ in range(2)), 3) for name in FIXTURES}
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total median warm time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "fixture": fixture,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
