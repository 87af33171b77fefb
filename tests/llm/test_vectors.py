"""Nearest neighbours and cosine groups against plain versions."""

import numpy as np
import pytest
from brute import groups
from pyspark.sql import functions as F

from tracemill.llm.tiles import embedding_groups
from tracemill.llm.vptree import nearest

SCHEMA = "vec_id long, embedding array<double>, vector string, tile string, shard string, block string, score string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, size=(300, 1))
    near = base[:40] + 0.02 * rng.normal(size=(40, 8))
    out = {k: x.tolist() for k, x in enumerate(np.concatenate([base, near]))}
    out |= {1000 + k: base[7].tolist() for k in range(150)}  # copies of one vector
    out |= {2000 + k: (3 * base[9]).tolist() for k in range(3)}  # one direction
    odd = {3000: None, 3020: [0.0] * 8, 3040: [1.0] * 7 + [None], 3060: [1.0] * 7 + [float("nan")]}
    odd |= {3080: [float("inf")] + [0.0] * 7, 3100: [], 3120: [1.0, 2.0]}
    return out, odd


@pytest.fixture(scope="module")
def frame(spark, rows):
    table = [(k, x, *["given"] * 5) for part in rows for k, x in part.items()]
    table += [(None, rows[0][0], *["given"] * 5)]
    return spark.createDataFrame(table, SCHEMA).repartition(6)


def ranked(good, k, asked):
    want = {}
    for q in asked:
        scores = [(-sum(a * b for a, b in zip(good[q], x)), i) for i, x in good.items() if i != q]
        want[q] = sorted(scores)[:k]
    return want


@pytest.mark.parametrize("pairs", [1024, 1])
def test_exact_search(frame, rows, monkeypatch, pairs):
    from tracemill.llm import vptree

    monkeypatch.setattr(vptree, "PAIRS", pairs)
    monkeypatch.setattr(vptree, "LONGEST_SIDE", 3)
    monkeypatch.setattr(vptree, "SHARD_ROWS", 120)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 10)
    got = nearest(frame, F.col("vec_id") % 20 == 0, factor=1.0).collect()
    want = ranked(rows[0], 20, [i for i in rows[0] if i % 20 == 0])
    assert {r.query_id for r in got} == set(want)
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], [-s for s, _ in best])
        if all(abs(a[0] - b[0]) > 1e-9 or a[0] == b[0] for a, b in zip(best, best[1:])):
            assert [r.vec_id for r in mine] == [i for _, i in best]


def test_recall_of_the_relaxed_search(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = F.col("vec_id") % 20 == 0
    got, exact = ({(r.query_id, r.vec_id) for r in x.collect()} for x in (nearest(table, asked), nearest(table, asked, factor=1.0)))
    assert len(got) == len(exact) and len(got & exact) >= 0.95 * len(exact)


def test_repeated_ids(spark):
    """A query id asks once, with the smallest of its vectors; repeated candidates have ranks each."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 3.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0)]


def test_few_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0])], "vec_id long, embedding array<float>")
    got = nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 1.0)]


@pytest.mark.parametrize("pairs", [1024, 1])
def test_groups(frame, rows, same, monkeypatch, pairs):
    from tracemill.llm import tiles

    monkeypatch.setattr(tiles, "PAIRS", pairs)
    monkeypatch.setattr(tiles, "LONGEST_SIDE", 3)
    monkeypatch.setattr(tiles, "TILE_ROWS", 64)
    monkeypatch.setattr(tiles, "STRIP_ROWS", 16)
    good, odd = rows
    units = {k: np.array(x) / np.linalg.norm(x) for k, x in good.items()}
    linked = lambda a, b: units[a] @ units[b] >= 0.9
    root = groups(list(good), linked)
    want = [(k, sum(linked(k, j) for j in good if j != k), root[k], root[k] == k) for k in good]
    want += [(k, 0, k, True) for k in odd] + [(None, 0, None, True)]
    same(embedding_groups(frame).collect(), want)


def test_empty(frame):
    for table in (frame.limit(0), frame.where("vec_id >= 3000")):
        assert nearest(table, F.col("vec_id") % 20 == 0).count() == 0
        assert embedding_groups(table).count() == table.count()
