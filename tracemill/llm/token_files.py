"""Token counts of documents in flat token files without an index.

A token file is a stream of little-endian 16-bit ids in which an end-of-document id follows every document. It
is read as blocks of equal size, which know nothing of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.llm.vocabulary import encoder
from tracemill.session import stored

VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 50256  # free in the rank file
BLOCK_TOKENS = 1 << 18
WIDTH = np.dtype("<u2")
PARTS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64()))])
SCANNED = "file string, block long, n long, n_ends long, last_end long, gaps array<long>"


def write_token_files(
    docs: DataFrame,
    path: str = "",
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(blocks, manifest)`` of the token files of ``docs``, one file for each partition.

    ``blocks``: file, block, tokens; blocks are cut after ``block_tokens`` ids wherever that is. ``manifest``: file,
    ordinal, doc_id, the order in which a file's documents were written. Both come from one stored table. A NULL text
    is an empty document. ``end_id`` must not be an id of the vocabulary.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, size, first = TaskContext.get().partitionId(), 0, 0, 0
        encode = encoder(path).encode_to_numpy
        waiting: list[np.ndarray] = []

        def rows(blocks: list[tuple[int, bytes]], ids: list) -> pa.RecordBatch:
            data = [(file, number, tokens, None) for number, tokens in blocks]
            data += [(file, first, None, ids)] if ids else []
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*data), PARTS)] if data else [pa.array([], f.type) for f in PARTS],
                schema=PARTS,
            )

        for part in slices(batches, "text"):
            for text in texts_of(part, "text"):
                waiting.append(np.append(encode(text.decode(), disallowed_special=()), end_id).astype(WIDTH))
                size += len(waiting[-1])
            full = []
            if size >= block_tokens:
                stream = np.concatenate(waiting)
                count = size // block_tokens
                cut = stream[: count * block_tokens].reshape(count, -1)
                full = [(block + k, row.tobytes()) for k, row in enumerate(cut)]
                block += count
                waiting = [stream[count * block_tokens :]]
                size = len(waiting[0])
            ids = part.column("doc_id").to_pylist()
            yield rows(full, ids)
            first += len(ids)
        if size:
            yield rows([(block, np.concatenate(waiting).tobytes())], [])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    written = stored(given.mapInArrow(run, "file long, block long, tokens binary, ids array<long>"), "token-files")
    blocks = written.where("tokens IS NOT NULL").select(F.col("file").cast("string").alias("file"), "block", "tokens")
    listed = written.where("ids IS NOT NULL").select(
        F.col("file").cast("string").alias("file"), F.col("block").alias("first"), F.posexplode("ids").alias("at", "doc_id")
    )
    return blocks, listed.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, block, tokens)`` of raw token files below ``path``, each below two gigabytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = block_tokens * WIDTH.itemsize
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                for k, at in enumerate(range(0, len(content), step)):
                    yield pd.DataFrame({"file": [file], "block": [k], "tokens": [content[at : at + step]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "file string, block long, tokens binary")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Separators of each block by itself: their number, the last one's place, tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            out: dict[str, list] = {"n": [], "n_ends": [], "last_end": [], "gaps": []}
            for tokens in batch.column("tokens").to_pylist():
                ids = np.frombuffer(tokens, dtype=WIDTH)
                ends = np.flatnonzero(ids == end_id)
                out["n"].append(len(ids))
                out["n_ends"].append(len(ends))
                out["last_end"].append(int(ends[-1]) if len(ends) else None)
                out["gaps"].append(np.diff(ends, prepend=-1) - 1)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(column, kind) for column, kind in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), *arrays], ["file", "block", *out]
            )

    return blocks.select("file", "block", "tokens").mapInArrow(run, SCANNED)


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``(file, ordinal, n_tokens, ended)`` of every document of the files, in order from 0.

    A prefix scan over the blocks of a file carries the documents before each block, and the tokens since the last
    separator; only the first document that ends in a block needs them. Tokens after a file's last
    separator are a document with ``ended`` false. An empty file has none, two separators in a row an empty document.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.coalesce(F.sum("n").over(before), F.lit(0))
    scanned = scan_blocks(blocks, end_id).withColumn("start", sizes)
    last = F.last(F.col("start") + F.col("last_end"), ignorenulls=True).over(before)
    carried = scanned.withColumns(
        {
            "ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
            "carry": F.col("start") - F.coalesce(last + 1, F.lit(0)),
            "is_last": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(),
        }
    )
    tail = F.col("n") - F.coalesce(F.col("last_end") + 1, -F.col("carry"))
    open_ = F.when(F.col("is_last") & (tail > 0), F.array(tail)).otherwise(F.array().cast("array<bigint>"))
    each = carried.select(
        "file", "ordinal", "carry", "n_ends", F.posexplode(F.concat("gaps", open_)).alias("at", "gap")
    )
    first = (F.col("at") == 0) & (F.col("n_ends") > 0)
    return each.select(
        "file",
        (F.col("ordinal") + F.col("at")).alias("ordinal"),
        (F.col("gap") + F.when(first, F.col("carry")).otherwise(0)).alias("n_tokens"),
        (F.col("at") < F.col("n_ends")).alias("ended"),
    )


def document_tokens(docs: DataFrame, path: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row, counted in the token files of ``docs``, separators not counted.

    NULL and empty texts have none. NULL ids and repeated rows are kept; other columns are not read.
    """
    blocks, manifest = write_token_files(docs, path, id_col=id_col, text_col=text_col)
    return manifest.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
