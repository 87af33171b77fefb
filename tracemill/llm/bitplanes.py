"""Centroid clustering of integer vectors by bit planes: dot products are weighted counts of common bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import stored

# A plane has one bit of each component, so it is one unsigned 64-bit number.
WIDTH = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
# Squared distances of vectors within this fit a 64-bit number.
LARGEST = 2**27
BLOCK = 4096
ASSIGNED = "vec_id long, cluster int, distance long"


def planes_of(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` planes of each row of 64 integers in two's complement: (rows, count) of unsigned 64-bit numbers."""
    bits = values[:, None, :] >> np.arange(count)[None, :, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(count: int) -> np.ndarray:
    """What a bit of each plane is worth; the last one is the sign."""
    worth = np.left_shift(np.int64(1), np.arange(count))
    worth[-1] = -worth[-1]
    return worth


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of all vectors of ``a`` (n, planes) with all of ``b`` (m, planes), as (n, m)."""
    worth = weights(a.shape[1])
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for p in range(a.shape[1]):
        for q in range(b.shape[1]):
            out += worth[p] * worth[q] * np.bitwise_count(a[:, p, None] & b[None, :, q])
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Exact squared lengths, from the bits that two planes of a vector have in common."""
    worth = weights(a.shape[1])
    common = np.bitwise_count(a[:, :, None] & a[:, None, :]).astype(np.int64)
    return np.einsum("npq,p,q->n", common, worth, worth)


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, both in planes; of equally near ones the first."""
    apart = squares(centroids)[None, :] - 2 * dots(vectors, centroids)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(vectors)), best] + squares(vectors)


def component_sums(vectors: np.ndarray) -> np.ndarray:
    """Sums of the 64 components of some vectors, from the bits set in each plane."""
    bits = np.unpackbits(vectors[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return weights(vectors.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            blob = b"".join(part.column("planes").to_pylist())
            yield part.column("vec_id"), np.frombuffer(blob, dtype="<u8").reshape(-1, count)


def _pack(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column("values").flatten().to_numpy().reshape(-1, WIDTH)
                rows = [row.tobytes() for row in planes_of(values, count).astype("<u8")]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(rows, pa.binary())], ["vec_id", "planes"])

    return run


def _summed(centroids: np.ndarray):
    """Per task: (cluster, n, sums), from which new centroids follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(centroids), WIDTH), dtype=np.int64)
        sizes = np.zeros(len(centroids), dtype=np.int64)
        for _, vectors in _blocks(batches, centroids.shape[1]):
            cluster, _ = nearest_centroid(vectors, centroids)
            for k in np.unique(cluster):
                mine = vectors[cluster == k]
                sums[k] += component_sums(mine)
                sizes[k] += len(mine)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(sizes[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, centroids.shape[1]):
            cluster, distance = nearest_centroid(vectors, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return run


def _moved(packed: DataFrame, centroids: np.ndarray, count: int) -> np.ndarray:
    """Centroids after one round. The driver sees 64 sums for each, whatever the number of vectors."""
    parts = packed.mapInArrow(_summed(planes_of(centroids, count)), "cluster int, n long, sums array<long>")
    # As decimals, so that no number of vectors is too large for a sum.
    exact = F.sum(F.col("value").cast("decimal(20,0)"))
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value"))
    moved = centroids.copy()
    for row in flat.groupBy("cluster", "at").agg(F.sum("n").alias("n"), exact.alias("total")).collect():
        moved[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return moved


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that takes part.

    Vectors have 64 components, none NULL or non-finite; a component x counts as the whole number floor(scale * x).
    Those with a number of 2^27 or more in size are left out too, as their squared distances need not fit 64 bits.
    Centroids start as the vectors with the smallest SHA-256 of ``seed:vec_id`` (of repeated ids, those with smaller components;
    NULL ids come last), as many as there are; ``rounds`` times each becomes the floored mean of the vectors
    nearest to it, of equally near ones the first, and stays where it is without vectors. Repeated rows are vectors each,
    other columns are not read, an empty table gives no row.

    Bit planes are packed once and stored; every round is one scan of them that brings back 64 sums for each centroid.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = given.where((F.size("vector") == WIDTH) & F.forall("vector", finite)).select(
        "vec_id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("whole")
    )
    small = whole.where(F.forall("whole", lambda x: F.abs(x) < LARGEST))
    kept = stored(small.select("vec_id", F.col("whole").cast("array<long>").alias("values")), "integers", compact=True)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "values").limit(centroids).select("values").collect()
    at = np.array([row["values"] for row in first], dtype=np.int64).reshape(-1, WIDTH)
    size = kept.select(F.greatest(F.max(F.array_max("values")), -F.min(F.array_min("values")))).first()[0]
    # Room for the largest number either way, and the sign.
    count = int(size or 0).bit_length() + 1
    packed = stored(kept.mapInArrow(_pack(count), "vec_id long, planes binary"), "planes", compact=True)
    for _ in range(rounds):
        at = _moved(packed, at, count)
    if not len(at):
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    found = stored(packed.mapInArrow(_assigned(planes_of(at, count)), ASSIGNED), "assigned", compact=True)
    sums = {row[0]: row[1] for row in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.tolist()]
    # One row for each centroid.
    facts = spark.createDataFrame(
        [(k, sums.get(k, 0), sum(sums.values()), digest) for k, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
