"""Exact groups by radix partitioning against grouping by text."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tracemill.llm import radix
from tracemill.llm.radix import exact_groups

SCHEMA = "doc_id long, text string"


def groups(rows):
    members = defaultdict(list)
    for i, text in rows:
        members[text or ""].append(i)
    out = []
    for text, ids in members.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays = i == top and not kept
            kept = kept or stays
            out.append((i, top, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd(texts):
    """Texts of one length that differ at every border of a digit, one byte before and one after."""
    base = "b" * 3000
    differ = [base[:at] + "x" + base[at + 1 :] for at in (0, 30, 31, 32, 33, 286, 287, 288, 289, 2334, 2335, 2336, 2337, 2999)]
    some = [(1000 + k, text) for k, text in enumerate([base, *differ, base, *differ[3:9], "é" * 1500, "é" * 1500, "é" * 40])]
    ends = [(2000 + k, "c" * n) for k, n in enumerate([31, 32, 33, 31, 32, 33, 287, 288, 289, 288, 2336, 2336, 2337])]
    return [*texts, *some, *ends]


def test_odd_rows(spark, texts, same):
    rows = odd(texts)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ["size", "head", "ids", "name", "entry", "rest", "left", "digit", "keep_id", "kept"]
    same(exact_groups(frame.withColumns({name: F.lit("given") for name in names})).collect(), groups(rows))


def test_digits_of_a_few_bytes(spark, texts, same, monkeypatch):
    """The width of digits changes no result."""
    for name, value in (("FIRST", 1), ("GROWTH", 2), ("LONGEST", 1024)):
        monkeypatch.setattr(radix, name, value)
    rows = [(i, text and text[:3000]) for i, text in odd(texts)]
    same(exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), groups(rows))


def test_one_text_of_most_rows(spark):
    """20,000 copies over many partitions, with another text of their length and first digits."""
    same_text = "z" * 400
    rows = spark.range(20001).repartition(40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 20000, "z" * 399 + "y").otherwise(same_text).alias("text")
    )
    got = exact_groups(rows)
    counts = got.groupBy("keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in counts} == {(19999, 20000, True, 1), (19999, 20000, False, 19999), (20000, 1, True, 1)}


def test_no_rows(spark, no_docs):
    table = exact_groups(no_docs)
    assert table.columns == "doc_id keep_id group_size kept text_sha256".split() and table.count() == 0
