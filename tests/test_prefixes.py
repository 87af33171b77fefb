"""Nested prefixes against longest-prefix matching of every address, by hand."""

import random

import pytest
from pyspark.sql import functions as F

import tracemill as tm

SCHEMA = "prefix string, as_no string, geo string, place int"


def text(number):
    return ".".join(str(number >> bits & 255) for bits in (24, 16, 8, 0))


def longest(prefixes, address):
    """Label of the longest prefix around the address; of equal ones that of the later place."""
    best = None
    for prefix, as_no, geo, place in prefixes:
        base, bits = prefix.split("/")
        number = int.from_bytes(bytes(map(int, base.split("."))), "big")
        size = 2 ** (32 - int(bits))
        if number // size == address // size and (best is None or (int(bits), place) > best[0]):
            best = ((int(bits), place), (as_no, geo))
    return best[1] if best else (None, None)


def borders(prefixes):
    """The first and last address of every prefix, and those beside them."""
    out = {0, 1, 2**32 - 1, 2**31}
    for prefix, *_ in prefixes:
        base, bits = prefix.split("/")
        number = int.from_bytes(bytes(map(int, base.split("."))), "big")
        size = 2 ** (32 - int(bits))
        low = number // size * size
        out |= {low - 1, low, low + 1, low + size // 2, low + size - 1, low + size}
    return sorted(a for a in out if 0 <= a < 2**32)


def family(rng, count):
    """Random prefixes close together, so that many are nested, equal or touching."""
    out = []
    for k in range(count):
        bits = rng.choice([0, 1, 7, 8, 9, 14, 15, 16, 17, 20, 23, 24, 25, 31, 32])
        number = rng.choice([10 << 24, 10 << 24 | 1 << 16, 255 << 24]) + rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 20, 2**24 - 1])
        out.append((f"{text(number)}/{bits}", f"AS{k}" if k % 9 else None, f"G{k % 5}" if k % 4 else None, k))
    return out


@pytest.mark.parametrize(
    "seed, count, broadcast_rows", [(1, 3, 500_000), (2, 12, 0), (3, 40, 500_000), (4, 150, 0), (5, 150, 500_000)]
)
def test_random_prefixes(spark, seed, count, broadcast_rows):
    prefixes = [p for p in family(random.Random(seed), count) if seed % 2 or not p[0].endswith("/0")]
    asked = borders(prefixes)
    ip_map = tm.flatten_prefixes(spark.createDataFrame(prefixes, SCHEMA).repartition(3), "place")
    starts = [r.range_start for r in ip_map.collect()]
    assert len(starts) == len(set(starts)) <= 2 * count
    hops = spark.createDataFrame([(a,) for a in asked], "ip long").repartition(3)
    got = {r.ip: (r.as_no, r.geo) for r in tm.floor_lookup(hops, ip_map, broadcast_rows).collect()}
    assert got == {a: longest(prefixes, a) for a in asked}


def test_lines(spark):
    rows = ["10.0.0.0/8 AS1 us", "10.1.0.0/16 AS2 us Oak land", "10.1.0.0/16 AS3 de Bonn", "10.1.2.3/33 AS4 us", "10.1.2/24 AS5 us",
            "300.0.0.1/24 AS6 us", "10.2.0.0/16 AS7", "", "10.0.0.0/x AS8 us"]
    lines = spark.createDataFrame([(v, k) for k, v in enumerate(rows)], "value string, line_order int")
    ip_map, bad = tm.parse_prefix_map(lines)
    base = 10 << 24
    assert sorted(map(tuple, ip_map.collect())) == [
        (base, "AS1", "US"), (base + 65536, "AS3", "BONN@DE"), (base + 131072, "AS1", "US"), (base + (1 << 24), None, None)
    ]
    assert {r.value for r in bad.collect()} == set(rows[3:])


def test_no_prefixes_and_no_order(spark):
    assert tm.flatten_prefixes(spark.createDataFrame([], SCHEMA)).count() == 0
    two = [("10.0.0.0/8", "AS1", "A", 2), ("10.0.0.0/8", "AS2", "A", 1)]
    got = tm.flatten_prefixes(spark.createDataFrame(two, SCHEMA).withColumn("bucket", F.lit("given"))).where("as_no IS NOT NULL")
    assert [tuple(r) for r in got.collect()] == [(10 << 24, "AS2", "A")]


def test_a_dataset_with_a_prefix_map(spark, tmp_path):
    (tmp_path / "map.txt").write_text("10.0.0.0/8 AS1 us\n10.0.1.0/24 AS2 us Reno\n")
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "t.txt").write_text("200901 10.0.0.1 0.5 10.0.1.1 2.5 10.0.2.9 8\n")
    path = tm.label_dataset(spark, "IPLANE", str(tmp_path / "traces"), str(tmp_path / "map.txt"), str(tmp_path / "out"), prefixes=True)
    assert [h.as_no for h in spark.read.parquet(path).first().hops] == ["AS1", "AS2", "AS1"]
