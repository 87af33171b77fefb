"""The filter audit against plain counting, filter by filter."""

import random
from itertools import permutations

import numpy as np
from brute import WORD
from pyspark.sql import functions as F

from tracemill.llm.filters import audit_rows, filter_audit, survivors

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The letters each row fails; ``rows``: (doc_id, text, ...)."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        own = "A" if len(words) < 50 else ""
        own += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        own += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
        own += "D" if any(c in "#$%&*|" for c in text) else ""
        own += "E" if i is not None and first[text] < i else ""
        out.append(own)
    return out


def audit(rows, marks):
    """``rows``: (doc_id, text, source); ``marks``: doc_id to (good, toxic)."""
    failed, out = fails(rows), []
    for part in {source or "" for _, _, source in rows}:
        mine = [(own, *marks.get(i, (False, False))) for (i, _, source), own in zip(rows, failed) if (source or "") == part]
        table = []
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, start=1):
                before = set(order[: step - 1])
                left = [m for m in mine if not before & set(m[0])]
                gone = [m for m in left if letter in m[0]]
                failing = sum(letter in m[0] for m in mine)
                alone = sum(m[0] == letter for m in mine)
                table.append(["".join(order), step, len(left) - len(gone), len(gone), failing - len(gone), alone,
                              sum(m[1] for m in gone), sum(m[2] for m in gone), letter])
        for *row, letter in table:
            out.append((part, *row, sum(r[3] for r in table if r[-1] == letter)))
    return out


def test_survivors_of_all_subsets():
    cells = np.random.default_rng(3).integers(0, 9, (32, 3))
    states = survivors(cells)
    for on in range(32):
        assert (states[on] == cells[[mask for mask in range(32) if not mask & on]].sum(axis=0)).all()
    assert len(audit_rows(cells)) == 600


def test_odd_rows(spark, texts, same):
    rng = random.Random(4)
    say = lambda n, k: " ".join(rng.choice([f"w{i}" for i in range(k)]) for _ in range(n))
    long = [say(60, 1000), say(60, 10), say(60, 1000).upper(), say(60, 1000) + " #", say(60, 10).upper() + "|é", say(60, 1000)]
    rows = [(i, text, ["a", "b", None, ""][k % 4]) for k, (i, text) in enumerate(texts)]
    rows += [(100 + k, long[k % 6], "c" if k % 3 else "a") for k in range(40)] + [(None, long[0], "c"), (None, long[0], "c")]
    rows += [(100, long[0], "a"), (-7, long[5], "d")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(90, 130)] + [(101, 1, 0), (101, 0, 1), (102, None, None), (None, 1, 1)]
    marks = {}
    for i, good, toxic in labels:
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or good == 1, old[1] or toxic == 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.withColumns({name: F.lit("given") for name in ["mask", "part", "n", "good", "quality", "digest"]})
    table = filter_audit(docs, spark.createDataFrame(labels, LABELS))
    same(table.collect(), audit(rows, marks))


def test_no_rows(spark, no_docs):
    table = filter_audit(no_docs.withColumn("source", F.lit("a")), spark.createDataFrame([], LABELS))
    assert table.columns[:3] == ["part", "filter_order", "step"] and table.count() == 0


def test_a_text_of_most_rows_is_counted_before_it_meets(spark):
    """One text makes up nearly all rows, in two parts; only its smallest id passes E."""
    rows = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("t"), "id")).otherwise("same").alias("text"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"),
    )
    got = filter_audit(rows, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1").collect()
    # ids 0, 50, ... have texts of their own; id 1 is the first of the others
    assert {(r.part, r.kept, r.removed) for r in got} == {("x", 400, 9600), ("y", 1, 9999)}
