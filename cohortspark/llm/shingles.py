"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_P, _POWERS = 0x5851F42D4C957F2D, []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; kept in each worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = 1 << max(20, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.array([1], U).repeat(m) * U(p) ** (np.arange(m) > 0).astype(U), dtype=U) for p in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word (runs of bytes other than 0x20 and 0x09-0x0D, A-Z as a-z)."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    low = buf + ((buf >= 65) & (buf <= 90)).view(np.uint8) * np.uint8(32)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(gap.view(np.int8)))
    start, end = edge[::2] + 1, edge[1::2] + 1  # the first and the last byte are gaps
    up, down = powers(len(buf) + 1)
    sums = np.cumsum(low.astype(U) * up[: len(buf)])
    h = mix((sums[end - 1] - sums[start - 1]) * down[start] + (end - start).astype(U))
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(bounds, start, "right") - 1


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; one shingle of all words if there are fewer."""
    h, text = word_hashes(texts)
    n = np.bincount(text, minlength=len(texts))
    parts, owners = [], []
    acc = np.full(len(h), words, U)
    for k in range(words):
        acc = mix(acc[: max(0, len(h) - k)] * U(0x9E3779B97F4A7C15) + h[k:])
    whole = text[: len(acc)] == text[words - 1 : words - 1 + len(acc)] if len(acc) else np.zeros(0, bool)
    parts.append(acc[whole])
    owners.append(text[: len(acc)][whole])
    first = np.cumsum(n) - n
    for k in range(1, words):
        few = np.flatnonzero(n == k)
        acc = np.full(len(few), k, U)
        for j in range(k):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + h[first[few] + j])
        parts.append(acc)
        owners.append(few)
    every, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((every, owner))
    every, owner = every[order], owner[order]
    keep = np.ones(len(every), bool)
    keep[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
    every, owner = every[keep], owner[keep]
    return np.split(every, np.searchsorted(owner, np.arange(1, len(texts))))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two whole numbers; 0 the empty one."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else bytes(16)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def in_batches(texts: Iterator, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Arrow texts as bytes (null: empty), a few MB at a time; a longer one is alone."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t.as_py() or "").encode()
        if held and n + len(raw) > most:
            yield at, held
            at, held, n = i, [], 0
        held.append(raw)
        n += len(raw)
    if held:
        yield at, held
