"""Connected components of an edge table: minimum node per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import stored

STAR = "hi long, lo long"


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the same components as the edges (u, v)."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(new, ends, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars of a partition's edges; holds at most one edge per node seen so far."""
    hi = lo = np.empty(0, dtype=np.int64)
    for batch in batches:
        hi, lo = star_forest(
            np.concatenate([hi, batch["hi"].to_numpy()]), np.concatenate([lo, batch["lo"].to_numpy()])
        )
    yield pd.DataFrame({"hi": hi, "lo": lo})


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` of every node that is not the smallest of its component.

    Edges are first contracted inside their partitions. Rounds of two star steps follow: every node
    hangs its smaller neighbours, and then itself, below the smallest of them; the number of rounds
    grows with the logarithm of the longest chain. Each round is written to the shared folder. Loops and repeated
    edges do no harm, edges with a NULL end are ignored, an empty table gives no row.
    """
    ordered = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"))
    # greatest() skips NULL, and would make such an edge a loop, which goes too
    pairs = stored(ordered.where("hi > lo").mapInPandas(_contract, STAR), "stars")
    state = None
    while (now := _state(pairs)) != state:
        state = now
        pairs = stored(_round(pairs), "stars")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(pairs: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo").bitwiseAND(0xFFFFFFFF)
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _round(pairs: DataFrame) -> DataFrame:
    lowest = pairs.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("low"))
    large = pairs.join(lowest, F.col("lo") == F.col("at"), "left").select(
        "hi", F.coalesce("low", "lo").alias("lo")
    )
    small = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("low"))
    hung = large.join(small, F.col("hi") == F.col("at")).where(F.col("lo") > F.col("low"))
    both = hung.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionByName(
        small.select(F.col("at").alias("hi"), F.col("low").alias("lo"))
    )
    return both.distinct()
