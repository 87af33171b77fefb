"""Clustering by bit planes against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm.bitplanes import cluster_vectors, component_sums, dots, nearest_centroid, planes_of, squares

SCHEMA = "vec_id long, embedding array<double>"


def clusters(rows, k=40, rounds=5):
    """All columns, by plain Python whole numbers."""
    kept = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept = [(i, v) for i, v in kept if all(abs(x) < 2**27 for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[v for _, v in kept if nearest(v)[1] == n] for n in range(len(centroids))] if kept else []
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = lambda n: sum(d for _, d, m in found if m == n)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia(n), sum(d for _, d, _ in found), digest[n]) for i, d, n in found]


@pytest.mark.parametrize("count, top", [(2, 2), (10, 512), (28, 2**27)])
def test_arithmetic_is_exact(count, top):
    rng = np.random.default_rng(count)
    a, b = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
    a[0], a[1], b[0] = -top, top - 1, -top
    pa, pb = planes_of(a, count), planes_of(b, count)
    exact = lambda x, y: [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in y] for r in x]
    assert dots(pa, pb).tolist() == exact(a, b)
    assert squares(pa).tolist() == [row[k] for k, row in enumerate(exact(a, a))]
    assert component_sums(pa).tolist() == a.sum(axis=0).tolist()
    best, apart = nearest_centroid(pa, pb)
    wide = [[sum((int(p) - int(q)) ** 2 for p, q in zip(r, s)) for s in b] for r in a]
    assert best.tolist() == [row.index(min(row)) for row in wide] and apart.tolist() == [min(row) for row in wide]


def vector(rng, center=0.0):
    return [center + rng.gauss(0, 0.1) for _ in range(64)]


def test_odd_rows(spark, same):
    rng = random.Random(2)
    rows = [(i, vector(rng, rng.choice([-0.5, 0.0, 0.75]))) for i in range(150)]
    rows += [(7, vector(rng)), (7, rows[7][1]), (3, rows[3][1]), (None, vector(rng)), (None, vector(rng))]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.5] * 63), (205, [math.nan] * 64)]
    rows += [(206, [math.inf] + [0.0] * 63), (207, [1e30] * 64), (208, [0.0] * 64), (209, [-2.0**19] + [2.0**19 - 0.01] * 63), (210, [2.0**19] * 64)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    frame = frame.withColumns({name: F.lit("given") for name in ["values", "planes", "cluster", "distance", "n", "row"]})
    same(cluster_vectors(frame).collect(), clusters(rows))


def test_fewer_vectors_than_centroids(spark, same):
    rng = random.Random(5)
    rows = [(i, vector(rng)) for i in range(6)] + [(9, [0.0] * 64), (10, [0.0] * 64)]
    same(cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect(), clusters(rows))


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        table = cluster_vectors(spark.createDataFrame(rows, SCHEMA))
        assert table.columns == "vec_id cluster distance cluster_inertia inertia centroid_sha256".split() and not table.collect()
