"""Byte-level BPE encoding and decoding.

Words of a text (by the tokenizer's split pattern) are merged with a priority
queue of merge ranks over a doubly linked symbol list; entries of the queue
that a later merge made stale are skipped when they surface. Decoding
concatenates the bytes of the vocabulary strings.

Defined results: a null text counts as empty and has no ids; a special token
written out in a text becomes its own id, as the tokenizer's defaults do; equal
texts have equal ids; very long texts are encoded whole; a null id is an id like
others, and repeated rows have equal results; an empty table gives an empty result;
columns that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.llm._common import keyed

#: The split pattern of byte-level tokenizers of this family; white space as Unicode defines it. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Chunks a worker remembers, at some 250 bytes each; beyond that it forgets all and starts again, so memory is bounded.
REMEMBERED = 1_600_000


class Spans(Exception):
    """Tokens of this text may span its spaces."""


def at_spaces(text: str) -> list[str]:
    """``text`` split at its spaces.

    A token starts at every space that no white space follows, or that none
    precedes. So only runs of spaces, and a chunk that starts with other white
    space, need the split pattern over the whole text.
    """
    chunks = text.split(" ")
    if "" in chunks:
        raise Spans
    return chunks


class Chunks(dict):
    """What ``make`` gives for `` chunk`` (a space, then text without spaces), by chunk."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if chunk[0].isspace():
            raise Spans
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[chunk] = self.make(" " + chunk)
        return found


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    own = set(shown)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BytePairCoder:
    """Encoder and decoder of one tokenizer file; made once in each worker."""

    def __init__(self, spec: str) -> None:
        import regex

        model = json.loads(spec)
        split, options = model.get("pre_tokenizer") or {}, model["model"]
        if model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or options.get("ignore_merges") or options.get("dropout"):
            raise ValueError("not a byte-level tokenizer with the usual split pattern and plain merges")
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.split = regex.compile(SPLIT).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Chunks(self.by_pattern)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        symbols = list(map(self.first.__getitem__, word.encode()))
        n, find = len(symbols), self.merges.get
        queue = [(*found, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := find(pair))]
        if not queue:
            return tuple(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            _, made, i, (left, right) = heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := find(pair := (made, symbols[k])):
                    heappush(queue, (*found, i, pair))
            h = before[i]
            if h >= 0 and (found := find(pair := (symbols[h], made))):
                heappush(queue, (*found, h, pair))
        return tuple([s for s in symbols if s >= 0])

    def by_pattern(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.merge, self.split(text))))

    def encode_ordinary(self, text: str) -> list[int]:
        try:
            chunks = at_spaces(text)
            return list(chain(self.by_pattern(chunks[0]), chain.from_iterable(map(self.known.__getitem__, chunks[1:]))))
        except Spans:
            return list(self.by_pattern(text))

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.encode_ordinary(text)
        parts = self.at_special.split(text)
        return list(chain.from_iterable([self.special[p]] if i % 2 else self.encode_ordinary(p) for i, p in enumerate(parts)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, BytePairCoder] = {}


def coder(spec: str) -> BytePairCoder:
    """The worker's coder for this tokenizer file, kept between tasks."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairCoder(spec)
    return _CODERS[key]


def tokenizer_spec(path: str) -> str:
    """The tokenizer file, read on the driver: a fixed 1.5 MB, sent to the executors as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` array<int>: the tokens of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text``: the vocabulary strings of ``ids`` joined; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text string")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encode, then decode, in one pass that keeps only digests."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        shown = {i: str(i) for i in bpe.bytes_of}.__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, sums, texts = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                sums.append(sha(",".join(map(shown, ids))))
                texts.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
