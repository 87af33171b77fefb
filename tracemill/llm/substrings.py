"""Removal of word windows that a document with a smaller id has too."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import SLICE_BYTES, slices, texts_of
from tracemill.llm.windows import window_hashes, word_hashes

# A window is this many words.
WIDTH = 13
# Text whose windows meet in one group, on average; the number of groups follows from all text.
CHARS_A_BUCKET = 6_000_000
FOUND = "doc_id long, hash long"
SENT = pa.schema(
    [("bucket", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("found", pa.bool_())]
)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane: sorted ones then compress well in the shuffle."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _found(ids: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": ids, "hash": hashes.view(np.int64)})


def _smallest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by (hash, id): hashes, ids, whether first of its hash, smallest id of the hash."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return hashes, ids, first, ids[np.flatnonzero(first)][np.cumsum(first) - 1]


def _ship(width: int, buckets: int):
    """Window hashes of a batch by bucket: each hash once per flush, with its smallest document.

    The other documents of a flush with the hash are settled on the spot (``found``), so a window of
    very many documents sends one entry per flush and not one per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pandas(flush(ids, texts_of(part, "text")), SENT, preserve_index=False)

    def flush(ids: np.ndarray, texts: list[bytes]) -> pd.DataFrame:
        windows, owner = window_hashes(*word_hashes(texts), width)
        hashes, docs, first, low = _smallest(windows, ids[owner])
        later = docs > low
        sent, senders = hashes[first], docs[first]
        bucket = (sent.astype(np.float64) * (buckets / 2.0**64)).astype(np.int64).clip(0, buckets - 1)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(sent)] if len(sent) else [0]
        rows = [
            (int(bucket[a]), _planes(sent[a:b]), _planes(senders[a:b]), False)
            for a, b in zip(cuts, cuts[1:])
        ]
        if later.any():
            # Any bucket will do; one that differs from flush to flush spreads them.
            known = np.unique(np.stack([docs[later].view(np.uint64), hashes[later]]), axis=1)
            rows.append((int(known[1][0] % np.uint64(buckets)), known[1].tobytes(), known[0].tobytes(), True))
        return pd.DataFrame(rows, columns=["bucket", "hashes", "ids", "found"])

    return run


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of one bucket whose hash has a smaller document in another flush."""
    known, open_ = group[group["found"]], group[~group["found"]]
    out = [
        _found(np.frombuffer(ids, dtype=np.int64), np.frombuffer(hashes, dtype=np.uint64))
        for ids, hashes in zip(known["ids"], known["hashes"])
    ]
    if len(open_):
        hashes = np.concatenate([_values(x) for x in open_["hashes"]])
        ids = np.concatenate([_values(x) for x in open_["ids"]]).view(np.int64)
        hashes, ids, _, low = _smallest(hashes, ids)
        out.append(_found(ids[ids > low], hashes[ids > low]))
    return pd.concat(out, ignore_index=True)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, hash)``: windows of a document that start in a document with a smaller id too.

    ``docs``: doc_id long, text string. Every window of ``width`` words is hashed. A hash of 64 bits comes from
    the words alone, so it finds its windows again in the text.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // CHARS_A_BUCKET))
    sent = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _ship(width, buckets), "bucket long, hashes binary, ids binary, found boolean"
    )
    return sent.groupBy("bucket").applyInPandas(_settle, FOUND)


def removed_words(text: bytes, flagged: np.ndarray, width: int) -> np.ndarray:
    """Which words a window with a flagged hash covers."""
    words, counts = word_hashes([text])
    windows, _ = window_hashes(words, counts, width)
    hits = np.flatnonzero(np.isin(windows, flagged))
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, hits, 1)
    np.add.at(depth, hits + width, -1)
    return np.cumsum(depth[:-1]) > 0


def _intervals(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _strip(width: int, as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in slices(batches, "packed", SLICE_BYTES // 4):
            columns: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
            flagged = part.column("flagged")
            hashes, ends = flagged.values.to_numpy(), flagged.offsets.to_numpy()
            for k, packed in enumerate(part.column("packed")):
                text = unpack.decompress(packed.as_py()) if packed.is_valid else b""
                words = text.split()  # splits at \x20 and \x09-\x0D only
                mask = np.zeros(len(words), dtype=bool)
                if flagged[k].is_valid:
                    own = hashes[ends[k] : ends[k + 1]].view(np.uint64)
                    mask = removed_words(text, own, width)
                    words = [word for word, gone in zip(words, mask.tolist()) if not gone]
                columns["n_words"].append(len(mask))
                columns["n_removed"].append(int(mask.sum()))
                columns["kept"].append(text if as_is and not mask.any() else b" ".join(words))
                columns["removed"].append(_intervals(mask))
            kept = pa.array(columns["kept"], pa.binary()).cast(pa.string())
            cuts = pa.array(columns["removed"], pa.list_(pa.list_(pa.int32())))
            given = [name for name in part.schema.names if name not in ("packed", "flagged")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(name) for name in given],
                    pa.array(columns["n_words"], pa.int64()),
                    pa.array(columns["n_removed"], pa.int64()),
                    kept,
                    cuts,
                ],
                [*given, *columns],
            )

    return run


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda text: None if text is None else pack.compress(text.encode()))


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    extra: Sequence[str] = (),
    as_is: bool = False,
) -> DataFrame:
    """``doc_id``, the ``extra`` columns, ``n_words``, ``n_removed``, ``kept`` and ``removed``.

    ``removed`` lists the maximal runs [first, end) of removed words, ``kept`` has the others, joined by
    a blank; with ``as_is`` a text that loses nothing keeps its own white space. A NULL text has no words
    and comes out empty. A row with a NULL id gives no windows to others and keeps all its words. Rows of
    one id are one document. Texts shorter than a window lose nothing. Other columns of ``docs`` are
    not read; extra ones keep their values, and names of the result come first.
    """
    taken = {"doc_id", "n_words", "n_removed", "kept", "removed"}
    extra = [name for name in extra if name not in taken]
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *extra
    )
    flagged = (
        repeated_windows(given.select("doc_id", F.col("__text").alias("text")), width)
        .groupBy("doc_id")
        .agg(F.collect_list("hash").alias("flagged"))
    )
    # Texts cross the network compressed, next to the hashes found for them.
    packed = given.withColumn("packed", _packed("__text")).drop("__text")
    met = packed.join(flagged, "doc_id", "left")
    types = {field.name: field.dataType.simpleString() for field in given.schema.fields}
    schema = ", ".join(
        [
            "doc_id long",
            *[f"`{name}` {types[name]}" for name in extra],
            "n_words long, n_removed long, kept string, removed array<array<int>>",
        ]
    )
    return met.select("doc_id", *extra, "packed", "flagged").mapInArrow(_strip(width, as_is), schema)
