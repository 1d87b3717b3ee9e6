"""Byte-pair encoding of many texts at once, in arrays.

Texts are split by character classes, words told apart by 128 bits of hash, and
words not met before merged together, those of one length as the rows of a matrix.
The result is that of the tokenizers library and of ``bpe.BytePairCoder``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Collection

import numpy as np

from cohortspark.llm.bpe import BytePairCoder, coder

#: Rank of a pair that is never merged.
NONE = np.int32(2**31 - 1)
#: Words of more bytes than this are merged one by one.
LONG = 64
#: Words that are remembered at most, at some 40 bytes each; beyond that those not met again since the last time are forgotten.
REMEMBERED = 300_000
#: Characters of the texts that are encoded together; a longer text is alone.
AT_ONCE = 500_000
#: Classes of characters: others, letters, numbers, white space, and what stands between two texts.
OTHER, LETTER, NUMBER, SPACE, BETWEEN = range(5)
#: White space as Unicode defines it. Fixed values.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

U = np.uint64


def character_classes() -> np.ndarray:
    """The class of each code point, and of one beyond all."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return np.append(table, np.uint8(BETWEEN))


def word_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words start, by the split pattern of ``bpe.SPLIT``: runs of one class, with one space before them; of other white space what a word follows the last character is a word of its own; some endings after an apostrophe."""
    start = np.ones(len(code), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.flatnonzero(start)
    after = np.append(first[1:], len(code))  # where each run ends
    spaces = (kind[first] == SPACE) & (kind[np.minimum(after, len(code) - 1)] != BETWEEN)
    last = after[spaces] - 1
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    lone = first[(code[first] == 39) & (after - first == 1)]  # an apostrophe between others than its like, no space before it
    lone = lone[start[lone] & (kind[lone + 1] == LETTER)]
    a, b = code[lone + 1], code[np.minimum(lone + 2, len(code) - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    for at, n in ((lone[one], 2), (lone[two & ~one], 3)):
        start[at + 1] = False
        rest = at + n
        start[rest[kind[rest] == LETTER]] = True
    return start


def hashed(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each stretch of bytes, from the eight bytes at every place."""
    a, b = size.astype(U) * U(0x9E3779B97F4A7C15), size.astype(U) + U(1)
    open_ = np.arange(len(at))
    depth = 0
    while len(open_):
        left = np.minimum(size[open_] - depth, 8)
        key = words[at[open_] + depth]
        short = left < 8
        key[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        x = (a[open_] ^ key) * U(0xBF58476D1CE4E5B9)
        a[open_] = x ^ (x >> U(29))
        y = (b[open_] + key) * U(0xD6E8FEB86659FD93)
        b[open_] = y ^ (y >> U(32))
        depth += 8
        open_ = open_[size[open_] > depth]
    return a, b


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of many stretches, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class ManyWords:
    """Encoder of one tokenizer file; what it remembers of words is bounded."""

    def __init__(self, own: BytePairCoder) -> None:
        self.coder = own
        self.kinds = character_classes()
        self.first = np.array(own.first, np.int64)
        pairs = np.array([(a << 32 | b, rank, made) for (a, b), (rank, made) in own.merges.items()], np.int64).reshape(-1, 3)
        self.keys, self.ranks = pairs[pairs[:, 0].argsort()][:, :2].T.copy()
        self.made = np.zeros(int(pairs[:, 1].max(initial=0)) + 1, np.int64)
        self.made[pairs[:, 1]] = pairs[:, 2]
        self.of_bytes = self.rank_of(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.a, self.b = np.zeros(0, U), np.zeros(0, U)  # words known, in order of ``a``
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # their ids in ``flat``
        self.met = np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def merged(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and their ids, of words of one length (a row of bytes each): in every round each word's first pair of least rank becomes one symbol."""
        out = []
        symbols, own = self.first[words], np.arange(len(words))
        rank = self.of_bytes[words[:, :-1], words[:, 1:]]
        while len(own) and rank.shape[1]:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(own)), at]
            still = least != NONE
            if not still.all():
                out.append((own[~still], symbols[~still]))
                symbols, rank, own, at, least = symbols[still], rank[still], own[still], at[still], least[still]
            row, n = np.arange(len(own)), symbols.shape[1]
            made = self.made[least]
            symbols[row, at] = made
            keep = np.ones(symbols.shape, bool)
            keep[row, at + 1] = False
            symbols = symbols[keep].reshape(len(own), n - 1)
            rank = rank[keep[:, 1:]].reshape(len(own), n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            rank[before, at[before] - 1] = self.rank_of(symbols[before, at[before] - 1], made[before])
            rank[after, at[after]] = self.rank_of(made[after], symbols[after, at[after] + 1])
        out.append((own, symbols))
        return out

    def ids_of(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of bytes, end to end, and how many each has."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            some = np.flatnonzero(size == n)
            if n > LONG:
                for i in some.tolist():
                    parts.append((np.array([i]), np.array([self.coder.merge(raw[at[i] : at[i] + n].tobytes().decode())])))
            else:
                parts += [(some[own], ids) for own, ids in self.merged(raw[at[some][:, None] + np.arange(n)])]
        counts = np.zeros(len(at), np.int64)
        for own, ids in parts:
            counts[own] = ids.shape[1]
        begin = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for own, ids in parts:
            flat[begin[own][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts

    def look_up(self, a: np.ndarray, b: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and number of ids of distinct words; those not known are learned."""
        if len(self.a) > REMEMBERED:
            keep = self.met
            self.flat = self.flat[ranges(self.at[keep], self.size[keep])]
            self.a, self.b, self.size = self.a[keep], self.b[keep], self.size[keep]
            self.at = np.cumsum(self.size) - self.size
            self.met = np.zeros(len(self.a), bool)
        place = np.minimum(np.searchsorted(self.a, a), max(len(self.a) - 1, 0))
        known = (self.a[place] == a) & (self.b[place] == b) if len(self.a) else np.zeros(len(a), bool)
        self.met[place[known]] = True
        begin, counts = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        begin[known], counts[known] = self.at[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            flat, own = self.ids_of(raw, at[new], size[new])
            begin[new], counts[new] = len(self.flat) + np.cumsum(own) - own, own
            self.flat = np.concatenate([self.flat, flat])
            order = np.argsort(joined := np.concatenate([self.a, a[new]]), kind="stable")
            self.a, self.b = joined[order], np.concatenate([self.b, b[new]])[order]
            self.at, self.size = np.concatenate([self.at, begin[new]])[order], np.concatenate([self.size, own])[order]
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])[order]
        return begin, counts

    def together(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text = np.repeat(np.arange(len(texts)), sizes)
        code = np.full(len(chars) + len(texts) + 1, 0x110000, np.uint32)
        place = np.arange(len(chars)) + text + 1
        code[place] = chars
        kind = self.kinds[code]
        width = np.zeros(len(code) + 1, np.int64)
        width[place] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        byte = np.cumsum(width) - width  # where each character's bytes begin
        start = np.flatnonzero(word_starts(code, kind))
        end = np.append(start[1:], len(code))
        word = kind[start] != BETWEEN
        start, end = start[word], end[word]
        if not len(start):
            return [np.zeros(0, np.uint32) for _ in texts]
        raw = np.frombuffer(whole.encode() + bytes(8), np.uint8)
        at, size = byte[start], byte[end] - byte[start]
        a, b = hashed(np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,)), at, size)
        order = np.argsort(a)
        a, b = a[order], b[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        begin, counts = self.look_up(a[first], b[first], raw, at[order[first]], size[order[first]])
        ids = self.flat[ranges(begin[group], counts[group])]
        owner = np.cumsum(kind == BETWEEN)[start] - 1
        bounds = np.cumsum(np.bincount(owner, counts[group], minlength=len(texts)).astype(np.int64))
        return np.split(ids, bounds[:-1])

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """As ``encode``, with names of special tokens as plain text."""
        return self.encode(texts, special=())

    def encode(self, texts: list[str], special: Collection[str] | None = None) -> list[np.ndarray]:
        """Ids of every text, as unsigned 32-bit numbers."""
        special = self.coder.special if special is None else special
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                out[i] = np.array(self.coder.encode(text), np.uint32)
                continue
            if held and chars + len(text) > AT_ONCE:
                for k, ids in zip(held, self.together([texts[k] for k in held]), strict=True):
                    out[k] = ids
                held, chars = [], 0
            held.append(i)
            chars += len(text)
        if held:
            for k, ids in zip(held, self.together([texts[k] for k in held]), strict=True):
                out[k] = ids
        return out


_WORDS: dict[int, ManyWords] = {}


def many_words(spec: str) -> ManyWords:
    """The worker's one for this tokenizer file; its memory, bounded, serves later tasks too."""
    own = coder(spec)
    if id(own) not in _WORDS:
        _WORDS.clear()
        _WORDS[id(own)] = ManyWords(own)
    return _WORDS[id(own)]
