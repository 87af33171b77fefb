"""Byte-level BPE: encoding to ids with token offsets, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.llm.pretokens import boundaries, class_ranges, class_table, classes
from tracemill.llm.vocabulary import ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.int64(2**40)
# Words up to this many bytes are merged side by side, longer ones with a heap.
SHORT_WORD = 32
CHUNK = 1 << 18
# A full cache is emptied; its size bounds memory only.
CACHE_WORDS = 200_000


class Merger:
    """Merges the bytes of words by rank, lowest first, leftmost on ties."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.cache: dict[bytes, bytes] = {}
        self.byte_ids = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (vocabulary[token[:k]] << 32 | vocabulary[token[k:]], rank)
            for token, rank in vocabulary.items()
            for k in range(1, len(token))
            if token[:k] in vocabulary and token[k:] in vocabulary
        ]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.keys, self.merged = np.append(table[:, 0], NONE << 20), np.append(table[:, 1], NONE)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set(words).difference(self.cache)
        by_width: dict[int, list[bytes]] = {}
        for word in new:
            if word in self.vocabulary:
                self.cache[word] = self.vocabulary[word].to_bytes(4, "little")
            elif len(word) > SHORT_WORD:
                self.cache[word] = np.array(self._long(word), dtype="<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(word) - 1).bit_length(), []).append(word)
        for width, group in by_width.items():
            self.cache.update(zip(group, self._short(group, width)))
        return [self.cache[word] for word in words]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def _short(self, group: list[bytes], width: int) -> Iterable[bytes]:
        """All words at once, one merge of each per round."""
        lengths = np.array([len(word) for word in group])
        raw = np.frombuffer(b"".join([word.ljust(width, b"\0") for word in group]), dtype=np.uint8)
        inside = np.arange(width) < lengths[:, None]
        ids = np.where(inside, self.byte_ids[raw].reshape(-1, width), -1)
        done = np.full_like(ids, -1)
        rank = np.full_like(ids, NONE)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(group))
        columns = np.arange(width)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            more = best < NONE
            done[rows[~more]] = ids[~more]
            if not more.any():
                break
            rows, at, best, ids, rank = rows[more], at[more], best[more], ids[more], rank[more]
            line = np.arange(len(rows))
            ids[line, at] = best
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, source, axis=1)
            rank[:, -1] = NONE
            nxt = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1)
            rank[line, at] = self._rank(best, nxt)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], best[left])
        sizes = (done >= 0).sum(axis=1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = np.cumsum(sizes) * 4
        return [flat[b - 4 * n : b] for b, n in zip(ends.tolist(), sizes.tolist())]

    def _long(self, word: bytes) -> list[int]:
        vocabulary = self.vocabulary
        cuts = list(range(len(word) + 1))  # cuts[i]: end of the part that starts at i, after merges
        follow = [i + 1 for i in range(len(word))]
        before = [i - 1 for i in range(len(word))]
        alive = [True] * len(word)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = follow[i]
            if j < len(word):
                rank = vocabulary.get(word[i : follow[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, follow[j]))

        for i in cuts[:-1]:
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            # stale if a part has gone, or has grown since
            if not alive[i] or follow[i] >= len(word) or follow[follow[i]] != end:
                continue
            j = follow[i]
            alive[j] = False
            follow[i] = end
            if end < len(word):
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < len(word):
            out.append(vocabulary[word[i : follow[i]]])
            i = follow[i]
        return out


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about CHUNK characters, cut where a word begins in any case: at a space after a letter."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        end = text.find(" ", at + CHUNK)
        while end > 0 and not text[end - 1].isalpha():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encode_text(text: str, table: np.ndarray, merger: Merger) -> bytes:
    """Ids of one text of any length."""
    return b"".join([encode_texts([part], table, merger)[0] for part in parts(text)])


def encode_texts(texts: list[str], table: np.ndarray, merger: Merger) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(text) + 1 for text in texts])
    resets = np.cumsum(lengths) - 1
    begins = boundaries(classes(points, table, resets))
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.concatenate([[0], np.cumsum(width)])
    blob = "\0".join([*texts, ""]).encode()
    edges = place[np.append(begins, len(points))].tolist()
    # The character that ends a text is a word of its own, which is skipped.
    last = np.searchsorted(begins, resets)
    words = [blob[a:b] for a, b in zip(edges, edges[1:])]
    ids = merger.words(words)
    starts = [0, *(last[:-1] + 1).tolist()]
    return [b"".join(ids[a:b]) for a, b in zip(starts, last.tolist())]


def _token_lengths(vocabulary: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    tokens = [token for token, _ in sorted(vocabulary.items(), key=lambda item: item[1])]
    if list(range(len(tokens))) != sorted(vocabulary.values()):
        raise ValueError("ids must run from 0 without gaps")
    return tokens, np.array([len(token) for token in tokens], dtype=np.int64)


def encode(docs: DataFrame, path: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, ends)`` of every whole text.

    ``ids`` are little-endian 32-bit numbers; ``ends`` likewise, the byte of the UTF-8 text at which each
    token ends. Special tokens do not exist: their strings are ordinary text. A NULL text counts as empty
    and has no tokens. NULL ids and repeated rows are kept; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ranges = class_ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        merger, table = Merger(vocabulary), class_table(ranges)
        lengths = _token_lengths(vocabulary)[1]
        for part in slices(batches, "text", CHUNK):
            texts = [text.decode() for text in texts_of(part, "text")]
            # A slice has more than CHUNK bytes only if it is a single text.
            one = len(texts) == 1
            ids = [encode_text(texts[0], table, merger)] if one else encode_texts(texts, table, merger)
            ends = [np.cumsum(lengths[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, (ids, ends))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids", "ends"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends binary")


def decode(coded: DataFrame, path: str = "") -> DataFrame:
    """Add ``decoded``, the bytes of the ids; replaces a column of that name. No ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths = _token_lengths(ranks(path))
        arena = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for part in slices(batches, "ids", CHUNK):
            out = []
            for some, stops in zip(part.column("ids").to_pylist(), part.column("ends").to_pylist()):
                some, stops = np.frombuffer(some, "<u4"), np.frombuffer(stops, "<u4").astype(np.int64)
                size = lengths[some]
                shift = np.repeat(begin[some] - (stops - size), size)
                out.append(arena[shift + np.arange(len(shift))].tobytes())
            kept = [name for name in part.schema.names if name != "decoded"]
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, kept), pa.array(out, pa.binary())], [*kept, "decoded"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != "decoded")
    return coded.mapInArrow(run, f"{kept}, decoded binary")
