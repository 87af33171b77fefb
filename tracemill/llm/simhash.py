"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.llm.components import components
from tracemill.session import stored

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 8192
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit ``hashes``, as a signed number; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a UTF-8 text, 64 majority bits over the hashes of all shingles, repeats included; 0 without words."""
    words = text.translate(LOWER).split()  # splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    runs = [words[i:] for i in range(min(shingle, len(words)))]
    count = len(runs[-1])
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, map(b" ".join, zip(*runs)), repeat(SEED)), np.uint64, count
    )
    return majority(hashes)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_id, fp)`` of every row; a NULL text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = [fingerprint(text, shingle) for text in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"]
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, fp long")


def _ball(fp: Column, radius: int) -> Column:
    """All variants of ``fp`` within ``radius`` bits, as an array of fixed size."""
    flips = [
        reduce(lambda a, b: a | b, (1 << bit for bit in bits), 0)
        for size in range(radius + 1)
        for bits in combinations(range(64), size)
    ]
    signed = [flip - 2**64 if flip >= 2**63 else flip for flip in flips]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in signed]), lambda flip: fp.bitwiseXOR(flip))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: edges that connect all distinct fingerprints within ``radius`` bits.

    Every distinct fingerprint emits its variants within half the radius. Two fingerprints at most
    ``radius`` bits apart meet at a variant, and all that meet at one are at most ``radius`` apart, so
    each is linked with the smallest there and no pairs are listed. A variant has at most as
    many fingerprints as a ball has members (65 for radius 2), whatever the data.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    met = prints.select("fp").distinct().select("fp", F.explode(_ball(F.col("fp"), radius // 2)).alias("at"))
    low = F.min("fp").over(Window.partitionBy("at"))
    pairs = met.withColumn("low", low).where("fp > low").select("low", "fp").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius).select(
        F.col("low").alias("u"), F.col("fp").alias("v")
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    Equal fingerprints are one class from the start, so a group of any size costs one row. A row with
    a NULL id keeps its row; its component is named by the smallest other id, NULL if there is none.
    Empty and NULL texts have fingerprint 0. Repeated rows stay repeated; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash", compact=True)
    forest = components(links(prints, radius))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(forest, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
