"""Rabin-Karp hashes of word windows, whole batches of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
# Odd, so invertible: dividing by a power is multiplying by a power of the inverse.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
CHUNK = 1 << 18
# Polynomials modulo 2^64 let some words of a thousand bytes collide whatever the base, so words over this have another hash.
LONG_WORD = 128


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` spread over the whole word, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each span of ``values``, from running sums."""
    up, down = powers(base, len(values)), powers(pow(base, -1, 2**64), len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, cut at white space."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        end = max(text.rfind(sep, at, at + CHUNK) for sep in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if end <= at:  # a word longer than a chunk
            ends = [i for sep in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (i := text.find(sep, at + CHUNK)) > 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def word_spans(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(blob) + 2, dtype=np.int8)
    inside[1:-1] = WORD[blob]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        blob = np.frombuffer(b"\n".join([piece for _, piece in group]) + b"\n", dtype=np.uint8)
        starts, ends = word_spans(blob)
        found = span_hashes(blob.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            found[k] = xxhash.xxh64_intdigest(blob[starts[k] : ends[k]].tobytes())
        hashes.append(found)
        borders = np.cumsum([len(piece) + 1 for _, piece in group])
        owner = np.searchsorted(borders, starts, side="right")
        np.add.at(counts, np.array([k for k, _ in group])[owner], 1)
        group.clear()

    size = 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            group.append((k, piece))
            size += len(piece)
            if size >= CHUNK:
                flush()
                size = 0
    if group:
        flush()
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one text, and the index of the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(max(0, len(words) - width + 1))
    starts = starts[owner[starts] == owner[starts + width - 1]] if len(starts) else starts
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return span_hashes(words, starts, starts + width, WORD_BASE), owner[starts]
