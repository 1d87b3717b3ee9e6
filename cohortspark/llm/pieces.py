"""Encoding and decoding with merge-type piece models (BPE with byte fallback).

A sequence of pieces is what merging gives if and only if merging the text of each
two neighbours gives back these two: the first merge that crossed a boundary of the
sequence would be the best of the two pieces around it as well. So the encoder takes
the longest piece at a place (an Aho-Corasick automaton over reversed pieces, run from
the end of a word, knows it for every place), keeps it if it goes with the piece before
it, else takes the next shorter one, and goes back where none is left; places from
which nothing led to the end are marked in a bit field and never entered again. Pairs
are judged by merging their text, once for each pair.

Texts are cut beforehand between characters that no piece holds side by side. Words
not met before are encoded together, in arrays; every one steps, fails and goes back by
itself.

Defined results: a null text counts as empty and has the begin and end ids only; a
character without a piece becomes the pieces of its bytes; names of control pieces in a
text are plain text; equal texts have equal ids; very long texts are encoded whole; a
null id is an id like others, and repeated rows have equal results; an empty table gives
an empty result; columns that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.llm._common import give_back, keyed
from cohortspark.llm._merge import AT_ONCE, LONG, U, ManyWords, hashed, ranges

#: What stands for a space inside pieces. Fixed value.
SPACE = "▁"
#: Kinds of pieces in a model file. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Pairs whose verdict a worker remembers, at 9 bytes each; beyond that it forgets all.
PAIRS = 4_000_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield key >> 3, raw[at : at + n]
            at += n


class PieceCoder:
    """Encoder and decoder of one model file, a word at a time; made once in each worker."""

    def __init__(self, spec: bytes) -> None:
        pieces, trainer, norm = [], {}, {}
        for field, value in fields(spec):
            if field == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(fields(value))
            elif field == 3:
                norm = dict(fields(value))
        kinds = {kind for _, _, kind in pieces}
        plain = not norm.get(2) and norm.get(3, 1) and not norm.get(4, 1) and norm.get(5, 1)  # no rules, a space before, none removed, spaces escaped
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not plain or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("not a merge-type model with byte fallback and plain normalization")
        self.n = len(pieces)
        self.texts = [p for p, _, _ in pieces]
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.bytes_of = [b"" if kind == CONTROL else bytes([int(p[1:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.byte_id = [0] * 256
        for i in np.flatnonzero(self.is_byte).tolist():
            self.byte_id[self.bytes_of[i][0]] = i
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.cost = {i: -pieces[i][1] for i in self.id_of.values()}
        letters = sorted({c for p in self.id_of for c in p})
        if not {*letters, SPACE} <= self.id_of.keys():
            raise ValueError("a character of a piece is no piece by itself")
        self.index = {c: k for k, c in enumerate(letters, 1)}  # 0: characters without a piece
        self.size = np.array([len(p) if p in self.id_of else 0 for p in self.texts], np.int64)
        #: Pieces that merging their own text gives; no other is ever in a result.
        self.whole = {p: i for p, i in self.id_of.items() if len(p) == 1 or self.merge(p) == [i]}
        shorter = (next((self.whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), -1) if p in self.whole else -1 for p in self.texts)
        self.shorter = np.fromiter(shorter, np.int64, self.n)
        self.grow()

    def merge(self, word: str) -> list[int]:
        """Ids of a word of known characters, by merges in order of score, then of place."""
        find, cost = self.id_of.get, self.cost
        symbols = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(cost[made], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (made := find(a + b)) is not None]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (made := find(a + b + symbols[k])) is not None:
                    heappush(queue, (cost[made], i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (made := find(symbols[h] + a + b)) is not None:
                heappush(queue, (cost[made], h, symbols[h], a + b))
        return [self.id_of[s] for s in symbols if s]

    def grow(self) -> None:
        """The automaton over reversed pieces: ``step`` by node and character, ``fail`` to the longest proper end of a node that is a node, ``longest`` piece that ends at a node."""
        step: dict[tuple[int, int], int] = {}
        longest, order = [-1], []
        for p, i in self.whole.items():
            node = 0
            for c in reversed(p):
                key = (node, self.index[c])
                if key not in step:
                    step[key] = len(longest)
                    longest.append(-1)
                node = step[key]
            longest[node] = i
        children: list[list[tuple[int, int]]] = [[] for _ in longest]
        for (node, c), child in step.items():
            children[node].append((c, child))
        fail = [0] * len(longest)
        order = [0]
        for node in order:
            for c, child in children[node]:
                back = fail[node]
                while node and back and (back, c) not in step:
                    back = fail[back]
                fail[child] = step.get((back, c), 0) if node else 0
                if longest[child] < 0:
                    longest[child] = longest[fail[child]]
                order.append(child)
        self.step, self.fail, self.longest = step, fail, longest

    def compatible(self, left: int, right: int) -> bool:
        return self.merge(self.texts[left] + self.texts[right]) == [left, right]

    def backtrack(self, word: str, goes_with) -> list[int]:
        """Ids of a word of known characters."""
        n, node = len(word), 0
        at = [0] * n
        step, fail, size, shorter = self.step, self.fail, self.size, self.shorter
        for p in range(n - 1, -1, -1):
            c = self.index[word[p]]
            while node and (node, c) not in step:
                node = fail[node]
            node = step.get((node, c), 0)
            at[p] = self.longest[node]
        ids: list[int] = []
        dead = bytearray(n // 8 + 1)
        p, next_ = 0, at[0] if n else -1
        while p < n:
            end = p + int(size[next_])
            if not dead[end >> 3] >> (end & 7) & 1 and (not ids or goes_with(ids[-1], next_)):
                ids.append(next_)
                p = end
                if p < n:
                    next_ = at[p]
                continue
            next_ = int(shorter[next_])
            while next_ < 0:
                dead[p >> 3] |= 1 << (p & 7)
                last = ids.pop()
                p -= int(size[last])
                next_ = int(shorter[last])
        return ids

    def decode(self, ids: list[int]) -> str:
        """The texts of pieces joined, without the space that encoding puts before a text."""
        shown = [i for i in ids if self.bytes_of[i]]
        raw = b"".join([self.bytes_of[i] for i in shown])
        if shown and not self.is_byte[shown[0]] and self.texts[shown[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class ManyPieces(ManyWords):
    """Encoder of one model file for many texts at once; what it remembers of words and pairs is bounded."""

    def __init__(self, own: PieceCoder) -> None:
        self.coder = own
        self.letters = len(own.index) + 1
        self.index = np.zeros(0x110000 + 1, np.uint16)
        for c, k in own.index.items():
            self.index[ord(c)] = k
        beside = np.zeros((self.letters, self.letters), bool)
        for p in own.id_of:
            k = [own.index[c] for c in p]
            beside[k[:-1], k[1:]] = True
        self.beside = beside.ravel()
        keys = np.array([(node * self.letters + c, child) for (node, c), child in own.step.items()], np.int64).reshape(-1, 2)
        self.steps, self.children = keys[keys[:, 0].argsort()].T.copy()
        self.fail, self.longest = np.array(own.fail, np.int64), np.array(own.longest, np.int64)
        self.pairs, self.goes = np.zeros(0, np.int64), np.zeros(0, bool)
        self.new: dict[int, bool] = {}
        self.a, self.b = np.zeros(0, U), np.zeros(0, U)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)
        own_bytes = own.bytes_of
        self.width = np.array([len(b) for b in own_bytes], np.int64)
        self.text_at = np.cumsum(self.width) - self.width
        self.text = np.frombuffer(b"".join(own_bytes), np.uint8)

    def verdict(self, pair: int) -> bool:
        found = self.new.get(pair)
        if found is None:
            found = self.new[pair] = self.coder.compatible(*divmod(pair, self.coder.n))
        return found

    def goes_with(self, left: int, right: int) -> bool:
        pair = left * self.coder.n + right
        at = int(np.searchsorted(self.pairs, pair))
        return bool(self.goes[at]) if at < len(self.pairs) and self.pairs[at] == pair else self.verdict(pair)

    def all_go(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``goes_with`` of many pairs."""
        pair = left * self.coder.n + right
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            found, known = self.goes[at], self.pairs[at] == pair
            if known.all():
                return found
        else:
            found, known = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
        odd, back = np.unique(pair[~known], return_inverse=True)
        found[~known] = np.fromiter(map(self.verdict, odd.tolist()), bool, len(odd))[back]
        return found

    def keep_pairs(self) -> None:
        if self.new:
            pairs = np.concatenate([self.pairs, np.fromiter(self.new, np.int64, len(self.new))])
            goes = np.concatenate([self.goes, np.fromiter(self.new.values(), bool, len(self.new))])
            order = pairs.argsort()
            self.pairs, self.goes, self.new = pairs[order], goes[order], {}
            if len(self.pairs) > PAIRS:
                self.pairs, self.goes = self.pairs[:0], self.goes[:0]

    def longest_at(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The longest piece at each place of words (a row of character numbers each), longer words first."""
        out = np.full(words.shape, -1, np.int64)
        node = np.zeros(len(words), np.int64)
        for back in range(words.shape[1]):
            n = int(np.searchsorted(-size, -back, side="left"))  # rows longer than ``back``
            row = np.arange(n)
            col = size[:n] - 1 - back
            c, open_ = words[row, col].astype(np.int64), row
            while len(open_):
                key = node[open_] * self.letters + c[open_]
                at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                hit = self.steps[at] == key
                node[open_[hit]] = self.children[at[hit]]
                open_ = open_[~hit]
                top = node[open_] == 0
                node[open_] = self.fail[node[open_]]
                open_ = open_[~top]
            out[row, col] = self.longest[node[:n]]
        return out

    def backtracked(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a row each, filled up) and their number, of words in order of falling length."""
        own, n = self.coder, len(words)
        at = self.longest_at(words, size)
        ids = np.zeros(words.shape, np.int64)
        count, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        dead = np.zeros((n, words.shape[1] + 1), bool)
        next_ = at[:, 0].copy()
        row = np.arange(n)
        while len(row):
            piece = next_[row]
            end = place[row] + own.size[piece]
            good = ~dead[row, end]
            judged = np.flatnonzero(good & (count[row] > 0))
            r = row[judged]
            good[judged] = self.all_go(ids[r, count[r] - 1], piece[judged])
            r = row[good]
            ids[r, count[r]] = piece[good]
            count[r] += 1
            place[r] = end[good]
            more = end[good] < size[r]
            next_[r[more]] = at[r[more], end[good][more]]
            r = row[~good]
            next_[r] = own.shorter[piece[~good]]
            stuck = r[next_[r] < 0]
            while len(stuck):
                dead[stuck, place[stuck]] = True
                count[stuck] -= 1
                last = ids[stuck, count[stuck]]
                place[stuck] -= own.size[last]
                next_[stuck] = own.shorter[last]
                stuck = stuck[next_[stuck] < 0]
            row = row[place[row] < size[row]]
        return ids, count

    def ids_of(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of 2-byte character numbers, end to end, and how many each has."""
        chars = raw.view("<u2")
        at, size = at // 2, size // 2
        counts = np.zeros(len(at), np.int64)
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(-size[short], kind="stable")]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(short):
            n = size[short]
            place = np.arange(int(n[0]))
            words = chars[np.minimum(at[short][:, None] + place, len(chars) - 1)]
            ids, counts[short] = self.backtracked(words, n)
            parts.append((short, ids))
        letters = list(self.coder.index)
        long_ = [(i, self.coder.backtrack("".join([letters[k - 1] for k in chars[at[i] : at[i] + size[i]].tolist()]), self.goes_with)) for i in np.flatnonzero(size > LONG).tolist()]
        for i, ids in long_:
            counts[i] = len(ids)
        begin = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for rows, ids in parts:
            filled = np.arange(ids.shape[1]) < counts[rows][:, None]
            flat[(begin[rows][:, None] + np.arange(ids.shape[1]))[filled]] = ids[filled]
        for i, ids in long_:
            flat[begin[i] : begin[i] + len(ids)] = ids
        self.keep_pairs()
        return flat, counts

    def together(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join([SPACE + t if t else "" for t in texts]).replace(" ", SPACE)
        sizes = np.array([len(t) + bool(t) for t in texts], np.int64)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(code):
            return [np.zeros(0, np.uint32) for _ in texts]
        char = self.index[code]
        cut = np.ones(len(char), bool)
        cut[1:] = ~self.beside[char[:-1].astype(np.int64) * self.letters + char[1:]]
        ends = np.cumsum(sizes)
        cut[ends[:-1][ends[:-1] < len(char)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(char)))
        known = char[start] > 0
        begin, counts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if known.any():
            raw = np.frombuffer(char.astype("<u2").tobytes() + bytes(8), np.uint8)
            at, n = 2 * start[known], 2 * size[known]
            a, b = hashed(np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,)), at, n)
            order = np.argsort(a)
            a, b = a[order], b[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(first) - 1
            own, own_counts = self.look_up(a[first], b[first], raw, at[order[first]], n[order[first]])
            begin[known], counts[known] = own[group], own_counts[group]
        odd, back = np.unique(code[start[~known]], return_inverse=True)
        bytes_ = [[self.coder.byte_id[x] for x in chr(c).encode()] for c in odd.tolist()]
        widths = np.array([len(x) for x in bytes_], np.int64)
        begin[~known] = (len(self.flat) + np.cumsum(widths) - widths)[back]
        counts[~known] = widths[back]
        ids = np.concatenate([self.flat, np.array([x for b in bytes_ for x in b], np.uint32)])[ranges(begin, counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = before[np.searchsorted(start, ends[:-1])]
        return np.split(ids, bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as unsigned 32-bit numbers, without begin and end."""
        out: list[np.ndarray] = []
        held: list[str] = []
        chars = 0
        for text in texts:
            if held and chars + len(text) > AT_ONCE:
                out += self.together(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        return out + self.together(held) if held else out

    def decode(self, ids: np.ndarray) -> str:
        """As ``PieceCoder.decode``."""
        ids = ids[self.width[ids] > 0]
        raw = self.text[ranges(self.text_at[ids], self.width[ids])].tobytes()
        if len(ids) and not self.coder.is_byte[ids[0]] and self.coder.texts[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_MODELS: dict[str, ManyPieces] = {}


def many_pieces(spec: bytes) -> ManyPieces:
    """The worker's one for this model file; its memory, bounded, serves later tasks too."""
    key = hashlib.md5(spec).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = ManyPieces(PieceCoder(spec))
    return _MODELS[key]


def model_spec(path: str) -> bytes:
    """The model file, read on the driver: a fixed 0.5 MB, sent to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def piece_encode(docs: DataFrame, model_path: str, with_ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` array<int>: the pieces of every whole text, between begin and end if ``with_ends``."""
    spec = docs.sparkSession.sparkContext.broadcast(model_spec(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = many_pieces(spec.value)
        own = model.coder
        ends = ([own.begin], [own.end]) if with_ends else ([], [])
        for batch in batches:
            ids = [[*ends[0], *x.tolist(), *ends[1]] for x in model.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        give_back()

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def piece_decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text``: the texts of the pieces joined; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(model_spec(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = many_pieces(spec.value)
        for batch in batches:
            texts = [model.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
        give_back()

    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text string")


def piece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encode with begin and end ids, then decode, in one pass that keeps only digests."""
    spec = docs.sparkSession.sparkContext.broadcast(model_spec(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = many_pieces(spec.value)
        begin, end = (np.array([x], "<u4") for x in (model.coder.begin, model.coder.end))
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(batch), 512):
                counts, sums, decoded = [], [], []
                for own in model.encode([t or "" for t in texts.slice(at, 512).to_pylist()]):
                    ids = np.concatenate([begin, own.astype("<u4"), end])
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
