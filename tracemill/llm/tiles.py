"""Vectors of high cosine: PCA-ordered tiles, compared leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.components import components, star_forest
from tracemill.llm.vectors import by_width, packed, unpacked, usable
from tracemill.session import stored

THRESHOLD = 0.9
TILE_ROWS = 8192
STRIP_ROWS = 256
# From so many pairs of tiles on, a task takes squares of them, of this side at most.
PAIRS = 1024
LONGEST_SIDE = 8
# Shares of the dimensions after which pairs that cannot reach the threshold are given up.
STAGES = (0.25, 0.5)
# Beyond this share of a strip, a full product is cheaper than picked pairs.
DENSE = 0.02
# Rounding of sums of at most some thousand products of unit vectors stays far below.
MARGIN = 1e-9
TILE = "tile long, n long, low double, high double, ids binary, sizes binary, vectors binary"
LINKS = "u long, v long, n long"


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of a partition's unit vectors, as (place, value) rows."""
    total = None
    for batch in batches:
        x = np.vstack(batch["vector"].to_numpy()) if len(batch) else np.empty((0, 0))
        if len(x):
            x = x / np.linalg.norm(x, axis=1)[:, None]
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})


def principal_axes(classes: DataFrame) -> np.ndarray:
    """Columns: axes of the unit vectors, by falling share of their squared length."""
    sums = classes.select("vector").mapInPandas(_moments, "place long, value double")
    rows = sums.groupBy("place").agg(F.sum("value").alias("value")).collect()  # the square of the width
    width = int(round(len(rows) ** 0.5))
    matrix = np.zeros(width * width)
    for row in rows:
        matrix[row["place"]] = row["value"]
    matrix = matrix.reshape(width, width)
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1]


def _tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition, sorted by their leading component, in tiles."""
    waiting: list[pd.DataFrame] = []

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["rep"].to_numpy(dtype=np.int64)
        return pd.DataFrame(
            {
                "tile": [int(ids[0])],  # every id is in one tile only
                "n": [len(ids)],
                "low": [rows["lead"].min()],
                "high": [rows["lead"].max()],
                "ids": [ids.tobytes()],
                "sizes": [rows["size"].to_numpy(dtype=np.int64).tobytes()],
                "vectors": [packed(rows["vector"].to_numpy())],
            }
        )

    for batch in batches:
        waiting.append(batch)
        while sum(map(len, waiting)) >= TILE_ROWS:
            rows = pd.concat(waiting, ignore_index=True)
            yield tile(rows[:TILE_ROWS])
            waiting = [rows[TILE_ROWS:]]
    if sum(map(len, waiting)):
        yield tile(pd.concat(waiting, ignore_index=True))


class Side:
    """A tile in the principal axes, with the norms that are left after each stage."""

    def __init__(self, row: pd.Series, axes: np.ndarray, cuts: list[int]):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.vectors = unpacked(row["vectors"], len(self.ids))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.turned = (self.vectors / self.norms[:, None]) @ axes
        squares = self.turned * self.turned
        self.left = [np.sqrt(squares[:, cut:].sum(axis=1)) for cut in cuts]


def linked(a: Side, b: Side, rows: slice, cuts: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` (within ``rows``) and ``b`` of all pairs whose cosine reaches ``threshold``."""
    first = cuts[0]
    product = a.turned[rows, :first] @ b.turned[:, :first].T
    bound = np.multiply.outer(a.left[0][rows], b.left[0])
    bound += product
    i, j = np.nonzero(bound >= threshold - MARGIN)
    i += rows.start
    if len(i) > DENSE * product.size:
        cosine = (a.vectors[rows] @ b.vectors.T) / np.multiply.outer(a.norms[rows], b.norms)
        near, j = np.nonzero(cosine >= threshold - MARGIN)
        i = near + rows.start
    else:
        product = product[i - rows.start, j]
        for stage in range(1, len(cuts)):
            part = slice(cuts[stage - 1], cuts[stage])
            product = product + np.einsum("nd,nd->n", a.turned[i, part], b.turned[j, part])
            open_ = product + a.left[stage][i] * b.left[stage][j] >= threshold - MARGIN
            i, j, product = i[open_], j[open_], product[open_]
    exact = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 65536):
        some = slice(at, at + 65536)
        dots = (a.vectors[i[some]] * b.vectors[j[some]]).sum(axis=1)
        exact[some] = dots / (a.norms[i[some]] * b.norms[j[some]]) >= threshold
    return i[exact], j[exact]


def _compare(axes: np.ndarray, threshold: float):
    cuts = sorted({max(1, int(len(axes) * share)) for share in STAGES})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in left.iterrows():
            a = Side(one, axes, cuts)
            for _, two in right.iterrows():
                if one["place"] <= two["place"] <= one["last"]:
                    out += compare(one, two, a)
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        frame = pd.DataFrame(dict(zip(("u", "v", "n"), columns)))
        return frame.astype({"u": "int64", "v": "Int64", "n": "int64"})

    def compare(one: pd.Series, two: pd.Series, a: Side) -> list:
        same = one["tile"] == two["tile"]
        b = a if same else Side(two, axes, cuts)
        counts_a, counts_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        node = root = np.empty(0, np.int64)
        for at in range(0, len(a.ids), STRIP_ROWS):
            i, j = linked(a, b, slice(at, min(at + STRIP_ROWS, len(a.ids))), cuts, threshold)
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(counts_a, i, b.sizes[j])
            np.add.at(counts_b, j, a.sizes[i])
            if len(i):  # links are counted, and a spanning forest of them goes on
                node, root = star_forest(
                    np.concatenate([node, a.ids[i]]), np.concatenate([root, b.ids[j]])
                )
        if same:
            counts_a = counts_a + counts_b
        out = [(node, root, np.zeros(len(node), np.int64))]
        for side, counts in ((a, counts_a),) if same else ((a, counts_a), (b, counts_b)):
            some = counts > 0
            # a loop (u, u) carries the count
            out.append((side.ids[some], side.ids[some], counts[some]))
        return out

    return run


def tile_reach(tiles: DataFrame, threshold: float) -> list[tuple[int, int, int, int]]:
    """``(tile, place, first, last)``: places of the tiles, by their lowest leading component, and between which
    places others can hold a link with one. Unit vectors with that cosine are close in every component.

    One row for each tile of thousands of vectors comes to the driver.
    """
    gap = max(0.0, 2 - 2 * threshold) ** 0.5 + MARGIN
    rows = sorted((r["low"], r["high"], r["tile"]) for r in tiles.select("low", "high", "tile").collect())
    lows = np.array([low for low, _, _ in rows])
    # Made to rise, so that the tiles that reach a place are a run as well.
    last = np.maximum.accumulate(np.searchsorted(lows, [high + gap for _, high, _ in rows], side="right") - 1)
    first = np.searchsorted(last, np.arange(len(rows)))
    return [(row[2], k, int(first[k]), int(last[k])) for k, row in enumerate(rows)]


def _named(given: DataFrame, threshold: float) -> DataFrame:
    """``(vector, n_links, component_id)`` of the distinct vectors of one length."""
    spark = given.sparkSession
    # 0.0 and -0.0 are one value to a grouping
    classes = stored(
        given.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes"
    )
    total = classes.count()
    axes = principal_axes(classes)
    lead = sum(
        (F.element_at("vector", k + 1) * float(x) for k, x in enumerate(axes[:, 0])), F.lit(0.0)
    ) / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    ordered = classes.withColumn("lead", lead).repartitionByRange(-(-total // TILE_ROWS), "lead", "rep")
    tiles = stored(ordered.sortWithinPartitions("lead", "rep").mapInPandas(_tiled, TILE), "tiles")
    reached = tile_reach(tiles, threshold)
    reach = spark.createDataFrame(reached, "at long, place long, first long, last long")
    placed = tiles.join(reach, F.col("tile") == F.col("at")).drop("at")
    # Each pair of tiles in reach once, the lower place on the left. A tile travels once for each square it is in.
    pairs = sum(last - place + 1 for _, place, _, last in reached)
    side = max(1, min(LONGEST_SIDE, isqrt(pairs // PAIRS)))
    at = lambda name: F.floor(F.col(name) / side)
    left = placed.withColumns({"one": at("place"), "two": F.explode(F.sequence(at("place"), at("last")))})
    right = placed.withColumns({"one": F.explode(F.sequence(at("first"), at("place"))), "two": at("place")})
    right = right.toDF(*right.columns)  # columns of its own, to stand beside the left
    met = left.groupBy("one", "two").cogroup(right.groupBy("one", "two"))
    links = stored(met.applyInPandas(_compare(axes, threshold), LINKS), "links")
    forest = components(links.where("u != v"))
    counts = links.where("u = v").groupBy(F.col("u").alias("at")).agg(F.sum("n").alias("links"))
    return (
        classes.join(counts, F.col("rep") == F.col("at"), "left")
        .join(forest, F.col("rep") == F.col("node"), "left")
        .select(
            "vector",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )


def embedding_groups(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Equal vectors are one class from the start, in which all are linked. Classes are turned into their principal
    axes, sorted by the first and cut into tiles; a pair of tiles is one task, or a square of up to 8 x 8 pairs where there
    are very many. Each task counts the links of
    its rows and passes on a spanning forest, so a cluster of any density costs no more than its rows.
    Rows that ``usable`` leaves out have no links and stand alone. Repeated rows of one id are rows
    like any other. Vectors of different lengths are never linked; each length has tiles of its own. An empty table
    gives no row.
    """
    given = usable(vectors, id_col, vector_col)
    parts = by_width(given)
    if not parts:
        everyone = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
        return everyone.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    named = reduce(DataFrame.unionByName, [_named(part, threshold) for part in parts])
    # Rows of a class that very many vectors share are split by the adaptive skew join.
    keyed = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    return keyed.join(named, "vector", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
