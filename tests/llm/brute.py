"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def shingle_set(text: str | None, count: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + count]) for i in range(max(1, len(words) - count + 1))} if words else set()


def similar(a: set, b: set) -> bool:
    return a == b or len(a & b) / len(a | b) >= 0.8


def groups(items: list, linked) -> dict:
    """Smallest item that each one reaches."""
    reach = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(items):
            for b in items[:i]:
                if linked(a, b) and reach[a] != reach[b]:
                    reach[a] = reach[b] = min(reach[a], reach[b])
                    changed = True
    return reach


def cut(docs: list[tuple[int | None, str | None]], width: int = 13) -> list[tuple]:
    """(doc_id, words, removed, kept) of every row."""
    words = [(i, WORD.findall(text or "")) for i, text in docs]
    first: dict[tuple, int] = {}
    for i, row in words:
        for k in range(len(row) - width + 1):
            if i is not None:
                key = tuple(row[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, row in words:
        gone = [False] * len(row)
        for k in range(len(row) - width + 1):
            if i is not None and first[tuple(row[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(row), sum(gone), " ".join(w for w, g in zip(row, gone) if not g)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and max(map(int, m[0].split("."))) <= 255
                or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                found.append((kind, m.start(), m.end()))
    return found
