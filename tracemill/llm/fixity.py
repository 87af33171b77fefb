"""Fixity of web archives: Merkle trees over records and their offsets, compared from the root down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import stored

FANOUT = 16
# Records a file holds at most, as long as keys are distinct.
FILE_RECORDS = 4096
# Copies of a key that one node covers, and nodes over copies that the next one covers; three levels of them.
COPY_RANGE = 4096
COPY_LEVELS = 2
# Digits of the digest that divide the copies of a key.
CELL_DIGITS = 3


def _quotient(number: Column, by: int) -> Column:
    """Whole-number division rounding down, exact for all 64-bit numbers."""
    div = lambda x: F.call_function("div", x, F.lit(by).cast("long"))
    return F.when(number >= 0, div(number)).otherwise(div(number + 1) - 1)


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """``(record_key, record)``: a WARC response record of every page, as bytes.

    NULL urls and bodies are empty. Rows without a key are left out, as they have no place in a file.
    """
    body = F.encode(F.coalesce(body_col, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url_col, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    keyed = pages.select(F.col(id_col).cast("long").alias("record_key"), record.alias("record"))
    return keyed.where("record_key IS NOT NULL")


def offsets(records: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``(file, record_key, copy, offset, length, digest)`` of every record of one replica.

    Files hold runs of ``file_records`` keys, in key order; records of one key follow each other by digest,
    numbered by ``copy``. The bytes themselves are hashed where they lie and do not move. Records are placed inside
    cells of a key and the first digits of the digest, and cells inside their file, so that the copies of one key
    are ordered by many tasks.
    """
    hashed = records.select(
        _quotient(F.col("record_key"), file_records).alias("file"),
        "record_key",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
    )
    cell = ["file", "record_key", "cell"]
    spread = hashed.withColumn("cell", F.left("digest", F.lit(CELL_DIGITS)))
    upto = Window.partitionBy(*cell).orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    inside = spread.withColumns(
        {"inner": F.sum("length").over(upto) - F.col("length"), "place": F.row_number().over(upto) - 1}
    )
    sizes = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("record_key", "cell").rowsBetween(Window.unboundedPreceding, 0)
    shifts = sizes.select(
        *cell,
        (F.sum("bytes").over(before("file")) - F.col("bytes")).alias("bytes_before"),
        (F.sum("n").over(before("file", "record_key")) - F.col("n")).alias("copies_before"),
    )
    return inside.join(shifts, cell).select(
        "file",
        "record_key",
        (F.col("copies_before") + F.col("place")).alias("copy"),
        (F.col("bytes_before") + F.col("inner")).alias("offset"),
        "length",
        "digest",
    )


@dataclass
class Trees:
    """Levels of the Merkle trees of one replica, leaves first: (node, start, end, hash)."""

    leaves: DataFrame
    levels: Sequence[DataFrame]


def _joined(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of ``nodes``: ordered children, the byte range they cover, and the hash over both."""
    child = F.struct("node", "start", "end", "hash")
    grouped = nodes.groupBy(_quotient(F.col("node"), fanout).alias("parent")).agg(
        F.sort_array(F.collect_list(child)).alias("children"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
    )
    # Ranges count from the start of the node: what a record does to the offsets after it stays in its branch.
    text = F.array_join(
        F.transform(
            "children",
            lambda c: F.concat_ws(":", c["node"], c["start"] - F.col("start"), c["end"] - F.col("start"), c["hash"]),
        ),
        ",",
    )
    return grouped.select(F.col("parent").alias("node"), "start", "end", F.sha2(text, 256).alias("hash"))


def _ranged(nodes: DataFrame, parent: Column) -> DataFrame:
    """Parents of nodes over the copies of a key, as ``_joined`` has them over keys."""
    children = F.sort_array(F.collect_list(F.struct("at", "start", "end", "hash")))
    grouped = nodes.groupBy("record_key", parent.alias("parent")).agg(
        children.alias("children"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    text = F.array_join(
        F.transform("children", lambda c: F.concat_ws(":", c["start"] - F.col("start"), c["end"] - F.col("start"), c["hash"])), ","
    )
    return grouped.select("record_key", F.col("parent").alias("at"), "start", "end", F.sha2(text, 256).alias("hash"))


def trees(records: DataFrame, depth: int, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> Trees:
    """Leaves, nodes over records and ``depth`` levels above, each stored.

    The place of a leaf is its key, so a record that is missing changes its own branch only. A leaf covers all
    copies of a key, by a tree of its own over ranges of copies: a node hashes what it covers in order, with byte
    ranges counted from its start. No row holds more than a range of them.
    """
    leaves = stored(offsets(records, file_records), "leaves")
    level = leaves.select(
        "record_key", F.col("copy").alias("at"), F.col("offset").alias("start"),
        (F.col("offset") + F.col("length")).alias("end"), F.col("digest").alias("hash"),
    )
    for _ in range(COPY_LEVELS):
        level = _ranged(level, _quotient(F.col("at"), COPY_RANGE))
    level = _ranged(level, F.lit(0).cast("long"))
    levels = [stored(level.select(F.col("record_key").alias("node"), "start", "end", "hash"), "nodes")]
    for _ in range(depth):
        levels.append(stored(_joined(levels[-1], fanout), "nodes"))
    return Trees(leaves, levels)


def _depth(records: DataFrame, fanout: int) -> int:
    """Levels until all keys are below one node; negative and other keys are below two at most."""
    low, high = records.agg(F.min("record_key"), F.max("record_key")).first()
    reach = max(abs(int(low or 0)), abs(int(high or 0))) + 1
    depth = 0
    while fanout**depth < reach:
        depth += 1
    return depth


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """Nodes that are not the same on both sides, or on one side only."""
    left = one.select("node", F.col("hash").alias("hash_1"))
    right = two.select("node", F.col("hash").alias("hash_2"))
    both = left.join(right, "node", "full")
    return both.where(~F.col("hash_1").eqNullSafe(F.col("hash_2"))).select("node")


def audit(
    first: DataFrame, second: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS
) -> DataFrame:
    """Records in which two replicas differ: ``(record_key, file, offset, length, digest, offset_2, length_2, digest_2,
    status)``.

    ``first``, ``second``: (record_key, record). Roots are compared, then the children of nodes that differ, down to
    the records. ``status``: ``changed`` (other bytes), ``missing`` (not in the second), ``extra`` (only
    there). Records that merely lie at another offset, as one before them is shorter, are sound. Two empty replicas
    agree; copies of a key are compared in order.
    """
    depth = max(_depth(first, fanout), _depth(second, fanout))
    one, two = trees(first, depth, fanout, file_records), trees(second, depth, fanout, file_records)
    open_ = _differing(one.levels[depth], two.levels[depth])
    for level in reversed(range(depth)):
        below = lambda nodes: nodes.join(
            open_.select(F.col("node").alias("above")), _quotient(F.col("node"), fanout) == F.col("above"), "left_semi"
        )
        open_ = stored(_differing(below(one.levels[level]), below(two.levels[level])), "open")
    mine = one.leaves.join(open_, F.col("record_key") == F.col("node"), "left_semi")
    theirs = two.leaves.join(open_, F.col("record_key") == F.col("node"), "left_semi").select(
        "record_key",
        "copy",
        F.col("file").alias("file_2"),
        *[F.col(name).alias(f"{name}_2") for name in ("offset", "length", "digest")],
    )
    met = mine.join(theirs, ["record_key", "copy"], "full")
    status = F.when(F.col("digest_2").isNull(), "missing").when(F.col("digest").isNull(), "extra")
    status = status.when(F.col("digest") != F.col("digest_2"), "changed")
    return met.select(
        "record_key",
        F.coalesce("file", "file_2").alias("file"),
        *["offset", "length", "digest", "offset_2", "length_2", "digest_2"],
        status.alias("status"),
    ).where("status IS NOT NULL")


def damaged(pages: DataFrame, every: int = 97) -> DataFrame:
    """Pages with faults for trials: those whose id leaves 1, 2 or 3 when divided by ``every`` have a
    character of the body replaced, lose its last character, or are lost."""
    size = F.char_length("html")
    rest = F.coalesce(F.pmod("page_id", F.lit(every)), F.lit(0))
    half = F.floor(size / 2).cast("int")
    flipped = F.concat(F.left("html", half), F.lit("~"), F.substring("html", half + 2, size))
    body = F.when(rest == 1, flipped).when(rest == 2, F.left("html", size - 1)).otherwise(F.col("html"))
    return pages.where(rest != 3).withColumn("html", body)
