"""Nearest neighbours by inner product: a vantage-point tree in every shard."""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.vectors import by_width, packed, unpacked, usable
from tracemill.session import stored

K = 20
# A branch goes if FACTOR times its least possible distance is over the K-th distance so far. With 1 the
# triangle inequality holds and the search is exact.
FACTOR = 5.0
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF = 64
# From so many pairs of a shard and a block on, a task takes squares of them, of this side at most.
PAIRS = 1024
LONGEST_SIDE = 16
# Vectors kept beyond K until scores are worked out again in one fixed order of summation.
SLACK = 12
TREE = "shard long, n long, vectors binary, ids binary, id_ends binary, nodes binary"
FOUND = "query_id long, vec_id long, score double"
SHUFFLER = 0x5EED


class Tree:
    """Distinct vectors in tree order and nodes (first, end, inner, outer, four distance bounds); leaves: inner -1.

    Inner products become distances by one more component that gives all vectors the same length.
    """

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray):
        self.vectors, self.nodes = vectors, nodes
        squares = (vectors * vectors).sum(axis=1)
        self.square = squares.max(initial=0.0)
        self.extra = np.sqrt(np.maximum(self.square - squares, 0.0))

    @staticmethod
    def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Tree order of the rows, and the nodes."""
        tree = Tree(vectors, np.empty((0, 8)))
        long = np.column_stack([vectors, tree.extra])
        order, nodes = np.arange(len(vectors)), []
        work = [(0, len(vectors), -1, 0)]
        while work:
            first, end, parent, side = work.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            node = [first, end, -1, -1, 0.0, 0.0, 0.0, 0.0]
            if end - first > leaf:
                part = order[first:end]
                away = np.sqrt(((long[part] - long[part[0]]) ** 2).sum(axis=1))
                by = np.argsort(away[1:], kind="stable") + 1  # the vantage point stays first
                order[first + 1 : end] = part[by]
                away = away[by]
                middle = len(away) // 2  # by count, so equal distances still part
                node[4:] = [away[0], away[middle - 1], away[middle], away[-1]]
                work += [(first + 1 + middle, end, len(nodes), 1), (first + 1, first + 1 + middle, len(nodes), 0)]
            nodes.append(node)
        return order, np.array(nodes, dtype=np.float64).reshape(-1, 8)

    def search(self, queries: np.ndarray, keep: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: none) and inner products of the ``keep`` best vectors of every query, best first."""
        best = np.full((len(queries), keep), -1)
        score = np.full((len(queries), keep), -np.inf)
        base = (queries * queries).sum(axis=1) + self.square
        everyone = np.arange(len(queries))

        def distance(who: np.ndarray, product: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base[who] - 2 * product, 0.0))

        def offer(who: np.ndarray, first: int, end: int) -> None:
            products = queries[who] @ self.vectors[first:end].T
            better = products.max(axis=1) > score[who, -1]
            rows = who[better]
            if len(rows):
                places = np.broadcast_to(np.arange(first, end), (len(rows), end - first))
                scores = np.concatenate([score[rows], products[better]], axis=1)
                places = np.concatenate([best[rows], places], axis=1)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                score[rows] = np.take_along_axis(scores, top, axis=1)
                best[rows] = np.take_along_axis(places, top, axis=1)

        def sides(who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            away = distance(who, queries[who] @ self.vectors[int(node[0])])
            inner = np.maximum(np.maximum(node[4] - away, away - node[5]), 0.0)
            outer = np.maximum(np.maximum(node[6] - away, away - node[7]), 0.0)
            return inner, outer

        # The nearest leaf of each query first: that makes the bounds tight for the walk.
        seen: dict[int, np.ndarray] = {}
        work = [(0, everyone)] if len(self.nodes) else []
        while work:
            at, who = work.pop()
            node = self.nodes[at]
            if node[2] < 0:
                offer(who, int(node[0]), int(node[1]))
                seen[at] = who
                continue
            inner, outer = sides(who, node)
            near = inner <= outer
            work += [(int(at), part) for at, part in ((node[2], who[near]), (node[3], who[~near])) if len(part)]
        work = [(0, everyone, np.zeros(len(queries)))] if len(self.nodes) else []
        while work:
            at, who, low = work.pop()
            node = self.nodes[at]
            open_ = (low * factor <= distance(who, score[who, -1])) | np.isinf(score[who, -1])
            if node[2] < 0 and at in seen:
                open_ &= ~np.isin(who, seen[at])
            who, low = who[open_], low[open_]
            if not len(who):
                continue
            if node[2] < 0:
                offer(who, int(node[0]), int(node[1]))
                continue
            offer(who, int(node[0]), int(node[0]) + 1)
            inner, outer = sides(who, node)
            work += [(int(node[3]), who, np.maximum(low, outer)), (int(node[2]), who, np.maximum(low, inner))]
        return best, score


def _plant(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        ids = group["vec_id"].to_numpy()
        distinct, index = np.unique(np.vstack(group["vector"].to_numpy()), axis=0, return_inverse=True)
        index = index.ravel()
        # Of equal vectors, no answer can hold more than the k + 1 smallest ids (one may be the query).
        by = np.argsort(index, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(index[by], index[by])
        kept = by[rank <= k]
        mixed = np.random.default_rng(SHUFFLER).permutation(len(distinct))
        order, nodes = Tree.build(distinct[mixed])
        order = mixed[order]
        members = [ids[kept[a:b]] for a, b in _runs(index[kept], len(distinct))]
        lists = [members[i] for i in order]
        return pd.DataFrame(
            {
                "shard": [group["shard"].iloc[0]],
                "n": [len(distinct)],
                "vectors": [packed(distinct[order])],
                "ids": [np.concatenate(lists).astype(np.int64).tobytes()],
                "id_ends": [np.cumsum([len(x) for x in lists]).astype(np.int64).tobytes()],
                "nodes": [nodes.tobytes()],
            }
        )

    return run


def _runs(sorted_index: np.ndarray, count: int) -> list[tuple[int, int]]:
    edges = np.searchsorted(sorted_index, np.arange(count + 1))
    return list(zip(edges[:-1], edges[1:]))


def _walk(k: int, factor: float):
    def run(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in trees.itertuples():
            vectors = unpacked(tree.vectors, tree.n)
            planted = Tree(vectors, np.frombuffer(tree.nodes, dtype=np.float64).reshape(-1, 8))
            ids, ends = np.frombuffer(tree.ids, np.int64), np.frombuffer(tree.id_ends, np.int64)
            for block in blocks.itertuples():
                names = np.frombuffer(block.ids, np.int64)
                queries = unpacked(block.vectors, len(names))
                best, _ = planted.search(queries, k + 1 + SLACK, factor)
                row, column = np.nonzero(best >= 0)
                place = best[row, column]
                score = (queries[row] * vectors[place]).sum(axis=1)  # one order of summation for all
                begin = ends[place] - np.diff(np.concatenate([[0], ends]))[place]
                sizes = ends[place] - begin
                each = np.repeat(np.arange(len(place)), sizes)
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(each))
                found = pd.DataFrame({"query_id": names[row[each]], "vec_id": ids[at], "score": score[each]})
                found = found[found["query_id"] != found["vec_id"]]
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(found.groupby("query_id", sort=False).head(k))
        if not out:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        # Of all trees of the task, no query needs more than its best.
        found = pd.concat(out, ignore_index=True)
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(k)

    return run


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "block": [group["block"].iloc[0]],
            "ids": [group["vec_id"].to_numpy(dtype=np.int64).tobytes()],
            "vectors": [packed(group["vector"].to_numpy())],
        }
    )


def plant(vectors: DataFrame, k: int = K) -> tuple[DataFrame, int]:
    """One tree for every shard of about SHARD_ROWS vectors, stored; and the number of shards.

    Shards go by a hash of the id, so copies of one vector are spread over all of them.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return stored(placed.groupBy("shard").applyInPandas(_plant(k), TREE), "trees"), shards


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of every query row.

    ``queries``: a condition on ``vec_id``. Every other row is a candidate, with equal vectors among them;
    ties go to the smaller id. Blocks of queries meet every shard; a task has one block and one shard, or, where there are
    very many, up to 16 of each, so that a tree travels to 16 blocks at once and memory stays bounded. Rows that ``usable``
    leaves out neither ask nor answer. Rows with the id of the query are its own. A query id asks once; of several
    vectors with that id the smallest asks. Repeated candidate rows are candidates each, so an id may have several
    ranks. No usable row gives no result. Only vectors of the query's length are candidates; each length has trees of
    its own.
    """
    given = usable(vectors, id_col, vector_col)
    found = [_nearest(part, queries, k, factor) for part in by_width(given) or [given]]
    met = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _nearest(given: DataFrame, queries: Column, k: int, factor: float) -> DataFrame:
    """The best ``k`` of every shard for every query, all vectors of one length."""
    trees, shards = plant(given, k)
    asked = given.where(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    packs = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packs = packs.groupBy("block").applyInPandas(_gathered, "block long, ids binary, vectors binary")
    side = max(1, min(LONGEST_SIDE, isqrt(shards * blocks // PAIRS)))
    group = lambda name: F.floor(F.col(name) / side)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // side).cast("long")))
    sent = trees.withColumns({"at": group("shard"), "to": every(blocks)})
    asking = packs.withColumns({"at": every(shards), "to": group("block")})
    return sent.groupBy("at", "to").cogroup(asking.groupBy("at", "to")).applyInPandas(_walk(k, factor), FOUND)
