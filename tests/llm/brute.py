"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def removed_bytes(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[bytes, bytearray]]:
    """By id the text's bytes and which of them go."""
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = (raw, gone)
    return out


def left_bytes(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, bytes]:
    return {i: bytes(b for b, g in zip(raw, gone, strict=True) if not g) for i, (raw, gone) in removed_bytes(rows, length).items()}


def suffix_dedup(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    kept, out = left_bytes(rows, length), {}
    for i, (raw, gone) in removed_bytes(rows, length).items():
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept[i]).hexdigest())
    return out


def shingles(t: str | None, n: int = 5) -> frozenset:
    words = WORD.findall(lower_ascii(t or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def ngram_join(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
