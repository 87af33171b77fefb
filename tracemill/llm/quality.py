"""Document quality by regularised quadratic discriminant analysis of text statistics."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.llm.windows import span_hashes
from tracemill.session import stored

FEATURES = (
    "words",  # log(1 + number of words)
    "word_length",  # log(1 + letters and marks a word)
    "upper",  # share of capitals among letters
    "marks",  # share of punctuation and symbols among characters
    "digits",  # share of digits among characters
    "variety",  # log of distinct words against log of words
    "top_word",  # share of the most frequent word
    "repeats",  # share of words equal to the word before
    "bare_marks",  # share of words without letter or digit
)
# Shares are taken to the arc sine of their root, which evens out their variances. Texts of a few words
# would have extreme shares by chance, so their denominators have some characters or words more.
MORE_CHARS, MORE_WORDS = 40, 8
THRESHOLD = 0.7
POOLED = 0.2  # weight of the pooled covariance in each class
RIDGE = 0.02  # weight of the mean variance, on the diagonal
LOWER, UPPER, DIGIT, MARK, BLANK = 1, 2, 3, 4, 5
POINT_BASE = 0x9E3779B97F4A7C15
HELD_OUT = 2


def kind_ranges() -> list[tuple[int, int, int]]:
    """Runs ``(first, last, kind)`` of code points, from the Unicode categories."""
    kinds = {"Lu": UPPER, "Lt": UPPER, "L": LOWER, "M": LOWER, "N": DIGIT, "P": MARK, "S": MARK}

    def kind(point: int) -> int:
        category = unicodedata.category(chr(point))
        return kinds.get(category) or kinds.get(category[0], 0)

    runs = []
    for value, run in groupby(range(0x110000), kind):
        if value:
            points = list(run)
            runs.append((points[0], points[-1], value))
    return [*runs, (9, 13, BLANK), (32, 32, BLANK)]


def _share(part: np.ndarray, whole: np.ndarray, more: int) -> np.ndarray:
    return np.arcsin(np.sqrt(np.minimum(part / (whole + more), 1.0)))


def statistics(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; zeros for a text without words."""
    count = len(texts)
    points = np.frombuffer(b"\n".join([*texts, b""]).decode().encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(text.decode()) + 1 for text in texts])
    kinds = table[points]
    borders = np.concatenate([[0], ends[:-1]])

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), borders)

    upper, digits, marks = (per_text(kinds == kind) for kind in (UPPER, DIGIT, MARK))
    letters = upper + per_text(kinds == LOWER)
    edges = np.diff(np.concatenate([[0], (kinds != BLANK).astype(np.int8)]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(ends, first, side="right")
    words = np.bincount(owner, minlength=count)
    out = np.zeros((count, len(FEATURES)))
    if not len(first):
        return out
    hashes = span_hashes(points.astype(np.uint64) + np.uint64(1), first, last, POINT_BASE)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    named = np.concatenate([[0], np.cumsum((kinds > 0) & (kinds < MARK))])
    bare = named[last] == named[first]
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=count)
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(count, dtype=np.int64)
    np.maximum.at(top, owner[order][new], runs)
    chars = letters + digits + marks
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(chars / np.maximum(words, 1))
    out[:, 2] = _share(upper, letters, MORE_CHARS)
    out[:, 3] = _share(marks, chars, MORE_CHARS)
    out[:, 4] = _share(digits, chars, MORE_CHARS)
    out[:, 5] = np.log1p(distinct) / np.log1p(np.maximum(words, 1))
    out[:, 6] = _share(np.maximum(top - 1, 0), words, MORE_WORDS)
    out[:, 7] = _share(np.bincount(owner[1:][again], minlength=count), words, MORE_WORDS)
    out[:, 8] = _share(np.bincount(owner[bare], minlength=count), words, MORE_WORDS)
    out[words == 0] = 0
    return out


def _table(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and one double for each of FEATURES, over whole texts."""
    ranges = kind_ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ranges)
        for part in slices(batches, "text"):
            rows = statistics(texts_of(part, "text"), table)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(column) for column in rows.T]], ["doc_id", *FEATURES]
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, ", ".join(["doc_id long", *[f"{name} double" for name in FEATURES]]))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 when divided by 4."""
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(value.cast("string")) % 4 == HELD_OUT, F.lit(False))


@dataclass
class Discriminant:
    """Log prior, mean, inverse Cholesky factor and log determinant of each class; None if not learnt."""

    classes: list[tuple[float, np.ndarray, np.ndarray, float]] | None
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        logs = []
        for log_prior, mean, factor, log_det in self.classes:
            z = (x - mean) @ factor.T
            logs.append(log_prior - 0.5 * (log_det + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From each class's number of rows, sums and sums of products (classes 0 and 1)."""
    total = counts.sum()
    prior = float(counts[1] / total) if total else 0.5
    if counts.min() < 2:
        return Discriminant(None, prior)
    means = sums / counts[:, None]
    scatter = [p - n * np.outer(m, m) for p, n, m in zip(products, counts, means)]
    pooled = sum(scatter) / (total - 2)
    ridge = RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
    classes = []
    for k in (0, 1):
        own = scatter[k] / (counts[k] - 1)
        covariance = (1 - POOLED) * own + POOLED * pooled + ridge
        lower = np.linalg.cholesky(covariance)
        factor = np.linalg.inv(lower)
        classes.append(
            (float(np.log(counts[k] / total)), means[k], factor, float(2 * np.log(np.diag(lower)).sum()))
        )
    return Discriminant(classes, prior)


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit to the labelled rows of ``stats`` that are not held out.

    Labels are 0 or 1; a document with both, or with another value alone, teaches nothing. One
    aggregation brings sums of fixed size, whatever the number of rows.
    """
    clear = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
    )
    taught = stats.join(clear, F.col("doc_id") == F.col("label_id"))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        taught.groupBy("quality")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(name).alias(f"s{i}") for i, name in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in rows:
        k = int(row["quality"])
        counts[k] = row["n"]
        sums[k] = [row[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[k, i, j] = products[k, j, i] = row[f"p{i}_{j}"]
    return fit(counts, sums, products)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    The score is the probability of label 1 under the two fitted normal densities. It depends on the
    text alone; equal texts have equal scores. NULL and empty texts have all statistics zero. With fewer
    than two rows of a label every score is the share of label 1 (0.5 without labels). NULL ids and repeated
    rows are kept; other columns are not read.
    """
    stats = stored(text_statistics(docs, id_col, text_col), "statistics", compact=True)
    model = learn(stats, labels)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.column_stack([column.to_numpy() for column in columns])))

    scored = stats.select("doc_id", held_out().alias("held_out"), score(*FEATURES).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    Scores are those of ``score_quality``. The texts are read twice, to learn and to judge, and never shuffled.
    """
    model = learn(text_statistics(docs, id_col, text_col), labels)
    ranges, place = kind_ranges(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ranges)
        for part in slices(batches, text_col):
            scores = model.scores(statistics(texts_of(part, part.schema.names[place]), table))
            yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
