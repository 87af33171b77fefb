"""How filters interact: what each removes at each place in each order, by a Gray-code walk over their subsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.session import stored

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
UPPER = bytes(range(65, 91))
# Bytes of UTF-8 that do not start a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOL = re.compile(b"[#$%&*|]")
# The filter that looks at other documents; the bits below it look at the text alone.
REPEATED = 4
MEASURES = ("n", "good", "toxic")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: bytes) -> int:
    """Of a UTF-8 text, the bits of the filters A to D that it fails."""
    words = text.split()  # splits at \x20 and \x09-\x0D only
    points = len(text.translate(None, CONTINUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2
        | (SYMBOL.search(text) is not None) << 3
    )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = texts_of(part, "text")
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("part"),
                pa.array([text_failures(text) for text in texts], pa.int32()),
                pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary()),
            ],
            ["doc_id", "part", "mask", "digest"],
        )


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of a part by the exact set of filters they fail, as bits of ``mask``.

    ``docs``: doc_id, text, part. Rows of one text are counted by their ids before they meet, so a text of very many
    copies is brought together as a few rows, one for each part and kind of label.
    """
    marked = stored(docs.mapInArrow(_marked, "doc_id long, part string, mask int, digest binary"), "masks", compact=True)
    is_one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        is_one("quality").alias("good"), is_one("toxic").alias("toxic")
    )
    labelled = marked.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    unnamed = marked.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kind = ["digest", "mask", "part", "good", "toxic"]
    one = F.count(F.lit(1)).alias("n")
    each = labelled.unionByName(unnamed).groupBy(*kind, "doc_id").agg(one)
    named = F.col("doc_id").isNotNull()
    groups = each.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("low"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    at_first = F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0)
    split = groups.withColumn("unique", F.col("unnamed") + at_first)
    cells = split.select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask"), F.col("unique").alias("n")),
                F.struct(F.col("mask").bitwiseOR(1 << REPEATED).alias("mask"), (F.col("n") - F.col("unique")).alias("n")),
            )
        ),
    )
    total = lambda name: F.coalesce(F.sum(F.when(F.col(name), F.col("n"))), F.lit(0)).alias(name)
    return cells.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def survivors(cells: np.ndarray) -> np.ndarray:
    """Of each subset of filters (as bits), what passes all of them; ``cells`` has a row for each set of failures.

    The subsets are walked in Gray code, one filter switched at a time. Every cell counts how many of the filters
    that are on it fails; only cells whose count leaves or reaches zero change the running survivors.
    """
    masks = np.arange(len(cells))
    failing = np.zeros(len(cells), dtype=np.int64)
    states = np.zeros_like(cells)
    states[0] = left = cells.sum(axis=0)
    on = 0
    for step in range(1, len(cells)):
        bit = step & -step
        on ^= bit
        hit = masks & bit > 0
        was_zero = failing == 0
        failing[hit] += 1 if on & bit else -1
        now_zero = failing == 0
        left = left - cells[was_zero & ~now_zero].sum(axis=0) + cells[now_zero & ~was_zero].sum(axis=0)
        states[on] = left
    return states


def audit_rows(cells: np.ndarray, letters: str = FILTERS) -> pd.DataFrame:
    """All steps of all orders of the filters, as differences of the states of ``survivors``."""
    states = survivors(cells)
    everyone, size = (1 << len(letters)) - 1, len(letters)
    rows = []
    for order in permutations(range(size)):
        on = 0
        for step, k in enumerate(order, start=1):
            lost = states[on] - states[on | 1 << k]
            fails = states[0, 0] - states[1 << k, 0]
            alone = states[everyone ^ 1 << k, 0] - states[everyone, 0]
            on |= 1 << k
            rows.append(("".join(letters[i] for i in order), step, states[on, 0], lost[0], fails - lost[0], alone, *lost[1:], k))
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "filter"]
    table = pd.DataFrame(rows, columns=names)
    table["shapley"] = table.groupby("filter")["removed"].transform("sum")
    return table.drop(columns="filter")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    cells = np.zeros((1 << len(FILTERS), len(MEASURES)), dtype=np.int64)
    cells[group["mask"]] = group[list(MEASURES)]
    table = audit_rows(cells)
    table.insert(0, "part", group["part"].iloc[0])
    return table


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """One row for each part, order of the filters A to E and step: what stays, goes and would go anyway.

    A fails a text of under 50 words, B one whose distinct words are under 65 % of all, C one with over 5 % capital
    letters A-Z, D one with any of ``#$%&*|`` and E a text that a row with a smaller id has too (byte for byte, by
    SHA-256). A NULL text is empty, a NULL part the empty one. A row with a NULL id is never smaller nor larger, so it
    passes E, and has no label. Of rows with one text and one id none is smaller, so all pass E. Repeated rows count
    each. A document is good or toxic if any of its rows in ``labels`` says 1. Other columns are not read. A part is
    32 rows of counts at most when its states are worked out; an empty table has no parts and gives no row.
    """
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    return failure_cells(given, marks).groupBy("part").applyInPandas(_walk, AUDIT)
