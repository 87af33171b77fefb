"""The quality classifier against a plain recomputation: statistics, covariances and normal densities."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm.quality import POOLED, RIDGE, score_quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def kind(char):
    category = unicodedata.category(char)
    return {"Lu": "upper", "Lt": "upper", "L": "lower", "M": "lower", "N": "digit", "P": "mark", "S": "mark"}.get(
        category, {"L": "lower", "M": "lower", "N": "digit", "P": "mark", "S": "mark"}.get(category[0])
    )


def share(part, whole, more):
    return math.asin(math.sqrt(min(part / (whole + more), 1.0)))


def plain_statistics(text):
    words = WORD.findall(text or "")
    if not words:
        return [0.0] * 9
    kinds = Counter(map(kind, text))
    letters = kinds["upper"] + kinds["lower"]
    chars = letters + kinds["digit"] + kinds["mark"]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    bare = sum(not any(kind(c) in ("upper", "lower", "digit") for c in word) for word in words)
    return [
        math.log1p(len(words)), math.log1p(chars / len(words)), share(kinds["upper"], letters, 40), share(kinds["mark"], chars, 40),
        share(kinds["digit"], chars, 40), math.log1p(len(set(words))) / math.log1p(len(words)),
        share(max(Counter(words).values()) - 1, len(words), 8), share(repeats, len(words), 8), share(bare, len(words), 8),
    ]


def plain_scores(rows, labels):
    """Score of every row, by densities written out."""
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows if i is not None}
    seen = {}
    for i, quality in labels:
        if quality in (0, 1) and i is not None:
            seen.setdefault(i, set()).add(quality)
    stats = [(i, np.array(plain_statistics(text))) for i, text in rows]
    classes = [np.array([x for i, x in stats if i in seen and seen[i] == {k} and not held[i]]) for k in (0, 1)]
    counts = [len(c) for c in classes]
    scatter = [(c - c.mean(axis=0)).T @ (c - c.mean(axis=0)) for c in classes]
    pooled = sum(scatter) / (sum(counts) - 2)
    ridge = RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
    covariances = [(1 - POOLED) * s / (n - 1) + POOLED * pooled + ridge for s, n in zip(scatter, counts)]

    def density(x, k):
        distance = x - classes[k].mean(axis=0)
        return math.log(counts[k] / sum(counts)) - 0.5 * (
            np.linalg.slogdet(covariances[k])[1] + distance @ np.linalg.solve(covariances[k], distance)
        )

    odds = [min(max(density(x, 0) - density(x, 1), -700), 700) for _, x in stats]
    return [(i, held.get(i, False), 1 / (1 + math.exp(o))) for (i, _), o in zip(stats, odds)]


def close(got, want):
    def key(row):
        return (row[0] is None, row[0] or 0, round(row[2], 6))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2], abs=1e-6) and g[3] == int(g[2] >= 0.7), (g, w)


def test_scores_of_the_smallest_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    close(score_quality(docs, labels).collect(), plain_scores(rows, marks))


def test_scores_of_odd_rows(spark, docs, texts):
    """Classes that overlap, so that scores lie between 0 and 1; labels that contradict, are NULL or have no row."""
    rng = random.Random(3)
    pool = ["word", "Other", "ÉTÉ", "12", "--", "x1", "日本", "á", "the", "the", "of"]
    extra = [(1000 + k, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for k in range(160)]
    rows = [*texts, *extra]
    labels = [(i, rng.randrange(2)) for i in range(1000, 1150)] + [(1000, 1), (1000, 0), (1001, None), (1002, 7), (99999, 1), (None, 1), (20, 0)]
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    table = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("words", F.lit("given"))
    found = score_quality(frame.withColumn("words", F.lit("given")), table).collect()
    assert sum(0.05 < r.score < 0.95 for r in found) > 20
    close(found, plain_scores(rows, labels))
