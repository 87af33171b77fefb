"""Word boundaries of a byte-level BPE by an automaton over character classes, without a regex.

The rules: a contraction ('s 't 're 've 'm 'll 'd) where a word may begin; runs of letters, of numbers, or of
other marks, each with one space before it; white space, of which a last space goes to the run after it
and another last character stands alone.
"""

from __future__ import annotations

import numpy as np
import tiktoken

# Character classes. The last four depend on what follows.
LETTER, NUMBER, OTHER, SPACE, RESET, LAST_BLANK, LAST_SPACE, SHORT, LONG = range(9)
# States: what the token that holds the last character may take next.
FRESH, WORD, DIGITS, MARKS, WHITE, BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
BLOCK = 64
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def class_ranges() -> list[tuple[int, int, int]]:
    """``(first, last, class)`` of letters, numbers and white space, as the tiktoken library has them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    singles = {bytes([b]): b for b in range(256)}
    ranges = []
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        # What the pattern leaves out is dropped, so the bytes that come back are the members.
        members = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        text = bytes(members.encode_ordinary(everything)).decode()
        found = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        cuts = np.flatnonzero(np.diff(found) > 1)
        firsts, lasts = found[np.concatenate([[0], cuts + 1])], found[np.concatenate([cuts, [-1]])]
        ranges += [(int(a), int(b), kind) for a, b in zip(firsts, lasts)]
    return ranges


def class_table(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[class, state]``: the next state; ``begins[class, state]``: whether a token begins."""
    step = np.empty((9, STATES), dtype=np.uint8)
    begins = np.ones((9, STATES), dtype=bool)
    for kind, state in ((LETTER, WORD), (NUMBER, DIGITS), (OTHER, MARKS)):
        step[kind] = state
        begins[kind, [state, BLANK]] = False
    step[LETTER, [ONE_LEFT, TWO_LEFT]] = FRESH, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    step[SPACE] = WHITE
    begins[SPACE, WHITE] = False
    step[LAST_BLANK] = FRESH
    step[LAST_SPACE] = BLANK
    step[RESET] = FRESH
    for kind, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # an apostrophe inside marks is a mark
        step[kind] = state
        step[kind, [MARKS, BLANK]] = MARKS
        begins[kind, [MARKS, BLANK]] = False
    return step, begins


STEP, BEGINS = _automaton()


def classes(points: np.ndarray, table: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Class of each code point; ``resets``: positions that end a text."""
    kinds = table[points]
    kinds[resets] = RESET
    after = np.append(kinds[1:], RESET)
    last = (kinds == SPACE) & (after != SPACE) & (after != RESET)
    kinds[last] = np.where(points[last] == 32, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero(points == 39)
    at = at[kinds[at] == OTHER]
    padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
    one, two = padded[at + 1], padded[at + 2]
    for text in CONTRACTIONS:
        hit = one == ord(text[0])
        if len(text) == 2:
            hit = hit & (two == ord(text[1]))
        kinds[at[hit]] = SHORT if len(text) == 1 else LONG
    return kinds


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where tokens begin.

    A character maps states to states, and such maps compose associatively. So blocks of characters are composed
    side by side, the blocks' maps are scanned, and then all blocks run at once from known states.
    """
    count = len(kinds)
    blocks = -(-count // BLOCK)
    padded = np.full(blocks * BLOCK, RESET, dtype=np.uint8)
    padded[:count] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    flat_step, flat_begins = STEP.ravel(), BEGINS.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:
        maps = flat_step[column[:, None] + maps]
    state = _starts(maps)
    begins = np.empty((BLOCK, blocks), dtype=bool)
    for k, column in enumerate(columns):
        at = column + state
        begins[k] = flat_begins[at]
        state = flat_step[at]
    return np.flatnonzero(begins.T.ravel()[:count])


def _starts(maps: np.ndarray) -> np.ndarray:
    """State before each block: scan of the blocks' maps by doubling."""
    scanned, width = maps, 1
    while width < len(maps):
        later = np.take_along_axis(scanned[width:], scanned[:-width].astype(np.intp), axis=1)
        scanned = np.concatenate([scanned[:width], later])
        width *= 2
    return np.concatenate([[np.uint8(FRESH)], scanned[:-1, FRESH]]).astype(np.uint8)
