import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tracemill as tm

SCHEMA = "k string, trace_id string, ts string, hops array<string>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(3000):
        # month starts, full hours, and other times, with many ties
        ts = rng.choice(
            ["2008-01-01 00:00:00", "2008-02-01 00:00:00", "2008-02-01 00:00:07", "2008-02-01 05:00:00"]
            + [f"2008-03-0{rng.randint(1, 9)} 0{rng.randint(0, 9)}:1{rng.randint(0, 9)}:00"]
        )
        hops = rng.choice([["a", "b"], ["a", "c"], ["a"], ["a", "b", "a"]])
        key = rng.choice(["hot", "hot", "hot", "cold", None])
        out.append((key, f"{rng.randrange(2**32):08x}-{i}", ts, hops))
    out.append(("single", "x", "2008-01-01 00:00:00", ["a", "b"]))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return (
        spark.createDataFrame(rows, SCHEMA)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("num_hops", F.size("hops"))
    )


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 1000, 1])
@pytest.mark.parametrize("partitions", [1, 50])
def test_path_prevalence(spark, table, rows, partitions, hot_rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.k: r for r in tm.path_prevalence(table, ["k"], hot_rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = by_key(rows)
    assert set(got) == set(want)
    for key, group in want.items():
        paths = ["-".join(r[3]) for r in sorted(group, key=lambda r: (r[2], r[1]))]
        counts = Counter(paths)
        top = max(counts.values())
        assert got[key].prevalence == pytest.approx(top / len(paths))
        assert got[key].num_changes == sum(a != b for a, b in zip(paths, paths[1:]))
        assert got[key].num_paths == len(counts)
        assert got[key].dominant_path == min(p for p, c in counts.items() if c == top)


def entropy(items):
    counts = Counter(items)
    total = sum(counts.values())
    return -sum(c / total * math.log(c / total) for c in counts.values()), len(counts)


def test_efficiencies(table, rows):
    paths = {r.k: r for r in tm.path_efficiency(table, ["k"]).collect()}
    hops = {r.k: r for r in tm.hop_efficiency(table, ["k"]).collect()}
    number = {r.k: r for r in tm.path_efficiency(table, ["k"], just_num_paths=True).collect()}
    for key, group in by_key(rows).items():
        h, k = entropy("-".join(r[3]) for r in group)
        assert paths[key].entropy == pytest.approx(h) and paths[key].num_paths == k
        assert (number[key].efficiency, number[key].entropy, number[key].num_paths) == (0.0, 0.0, k)
        if k == 1:
            assert paths[key].efficiency is None and paths[key].entropy == 0.0
        else:
            assert paths[key].efficiency == pytest.approx(h / math.log(k))
        h, k = entropy(hop for r in group for hop in r[3])
        assert hops[key].efficiency == pytest.approx(h / math.log(k))


def test_path_strings_and_cycles(table):
    row = tm.path_cycles(tm.path_strings(table)).where("size(hops) = 3").first()
    assert (row.path, row.label_set, row.has_cycle) == ("a-b-a", "a-b", True)
    assert tm.path_cycles(table).where("has_cycle and size(hops) < 3").count() == 0


def test_cycle_of_hyphenated_labels(spark):
    df = spark.createDataFrame([(["a-b", "b"],)], "hops array<string>")
    assert not tm.path_cycles(df).first().has_cycle


def test_ids_with_one_prefix_are_split(spark):
    """Stretches come from the rows, so equal times and look-alike ids do not hold a hot key together."""
    rows = [("hot", f"trace-{k:06d}", "2008-01-01 00:00:00", ["a", "bc"[k % 5 == 0]]) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    got = tm.path_prevalence(df, ["k"], 100).first()
    assert got.num_changes == sum(a[3] != b[3] for a, b in zip(rows, rows[1:]))
