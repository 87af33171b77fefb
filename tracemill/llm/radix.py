"""Exact duplicates by distributed MSD radix partitioning: texts are told apart by successive bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.session import stored

# Bytes of the first digit; each further digit is GROWTH times as long as the one before, up to LONGEST.
FIRST = 32
GROWTH = 8
LONGEST = 1 << 22
ENTRY = "size long, head binary, ids array<long>, text binary"
SETTLED = ["ids", "keep_id", "group_size", "keeper", "text_sha256"]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a slice as one entry with the ids of its rows."""
    for part in slices(batches, "text"):
        rows: dict[bytes, list] = {}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
            rows.setdefault(text, []).append(doc_id)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([len(text) for text in rows], pa.int64()),
                pa.array([text[:FIRST] for text in rows], pa.binary()),
                pa.array(rows.values(), pa.list_(pa.int64())),
                pa.array(rows, pa.binary()),
            ],
            ["size", "head", "ids", "text"],
        )


def _first_split(given: DataFrame) -> DataFrame:
    """Groups by length and first digit, numbered by ``name``; of a group of one row also its id and digest."""
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = given.select(
        "doc_id",
        F.octet_length(bytes_).cast("long").alias("size"),
        F.substring(bytes_, 1, FIRST).alias("head"),
        F.sha2(bytes_, 256).alias("text_sha256"),
    )
    groups = rows.groupBy("size", "head").agg(
        F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256")
    )
    return stored(groups.withColumn("name", F.monotonically_increasing_id()), "first-digits", compact=True)


def _split(entries: DataFrame, width: int) -> DataFrame:
    """Entries after one more digit of ``width`` bytes, stored; ``open`` ones are not told apart yet.

    A group of one entry, or one whose texts end here, is settled: its keeper is the largest id. Groups are counted with
    partial sums; each has one row, so however many entries join it, Spark can split them among tasks.
    """
    cut = entries.select(
        "name", "entry", "ids", "text_sha256", "left", F.substring("rest", 1, width).alias("digit"),
        F.expr(f"substring(rest, {width + 1})").alias("rest"), (F.col("left") <= width).alias("ended"),
    )
    top = F.max(F.struct(F.array_max("ids").alias("id"), F.col("entry"))).alias("top")
    groups = stored(
        cut.groupBy("name", "digit")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("ids")).cast("long").alias("group_size"), top)
        .select(
            F.col("name").alias("old"), F.col("digit").alias("its_digit"), "entries", "group_size", "top",
            F.monotonically_increasing_id().alias("new"),
        ),
        "digits",
        compact=True,
    )
    met = cut.join(groups, (F.col("name") == F.col("old")) & (F.col("digit") == F.col("its_digit")))
    open_ = (F.col("entries") > 1) & ~F.col("ended")
    return stored(
        met.select(
            F.col("new").alias("name"),
            "entry",
            "ids",
            "text_sha256",
            F.col("top.id").alias("keep_id"),
            "group_size",
            (F.col("entry") == F.col("top.entry")).alias("keeper"),
            open_.alias("open"),
            (F.col("left") - width).alias("left"),
            F.when(open_, F.col("rest")).alias("rest"),
        ),
        "entries",
    )


def _members(settled: DataFrame) -> DataFrame:
    """A row for each document; of the rows of the keeping entry the first with the largest id stays."""
    place = F.when(F.col("keep_id").isNull(), 0).otherwise(F.array_position("ids", F.col("keep_id")) - 1)
    each = settled.select(*SETTLED, place.alias("place"), F.posexplode("ids").alias("at", "doc_id"))
    return each.select(
        "doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("at") == F.col("place"))).alias("kept"), "text_sha256"
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``; equal texts are one group.

    Texts are equal if all their bytes are; no digest decides. They are first split by length and their first 32 bytes,
    for which only these travel. Groups of a single row are settled. What is left is split by the next 256 bytes,
    then by 2,048 and so on, until a group is single or its texts end; each round moves the digit of what is still open.
    Equal texts of a slice are one entry before anything moves, so a text of very many copies sends one entry per slice.

    A NULL text is empty. The row with the largest id stays; of several with that id and text one of them. Rows with a
    NULL id come before all ids; a group that has no other keeps one of them, its ``keep_id`` is NULL. Repeated rows stay
    repeated, other columns are not read, an empty table gives no row.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = _first_split(given)
    single = first.where("rows = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    shared = first.where("rows > 1").select(F.col("size").alias("its_size"), F.col("head").alias("its_head"), "name")
    entries = given.mapInArrow(_collapse, ENTRY)
    met = entries.join(shared, (F.col("size") == F.col("its_size")) & (F.col("head") == F.col("its_head")))
    entries = stored(
        met.select(
            "name",
            F.monotonically_increasing_id().alias("entry"),
            "ids",
            F.sha2("text", 256).alias("text_sha256"),
            F.greatest(F.col("size") - FIRST, F.lit(0)).alias("left"),
            F.expr(f"substring(text, {FIRST + 1})").alias("rest"),
        ),
        "entries",
    )
    result, width = single, FIRST
    while True:
        width = min(width * GROWTH, LONGEST)
        entries = _split(entries, width)
        result = result.unionByName(_members(entries.where("NOT open")))
        entries = entries.where("open")
        if entries.isEmpty():
            return result
