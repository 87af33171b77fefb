"""Vector columns as blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector)`` with vectors of doubles that can be compared.

    Left out: vectors that are NULL, empty, all zero or hold NULL or non-finite components, and rows with a NULL id.
    Vectors of one length can be compared, see ``by_width``.
    """
    given = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return given.where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", finite)
        & F.exists("vector", lambda x: x != 0.0)
    )


def by_width(good: DataFrame) -> list[DataFrame]:
    """The vectors of each length by themselves, shortest first; none of an empty table."""
    sizes = sorted(row[0] for row in good.select(F.size("vector")).distinct().collect())
    return [good.where(F.size("vector") == size) for size in sizes]


def packed(rows: list | np.ndarray) -> bytes:
    """Vectors of doubles, row by row."""
    return np.ascontiguousarray(np.vstack(rows), dtype=np.float64).tobytes() if len(rows) else b""


def unpacked(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64).reshape(rows, -1)
