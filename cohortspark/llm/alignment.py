"""Alignment of the tokens of two tokenizers.

Byte offsets where tokens of both end ("cuts") divide a text into groups. They are
found by divide and conquer: of every interval the cut nearest to its middle is looked
for, by bisection of the other tokenizer's ends, in windows that double; both halves go
on by themselves, and an interval without a cut inside is a group. The intervals of many
texts take each step together. A token of the one tokenizer and one of the other are linked where they share
a group.

Links are counted twice over: by task, where documents in strips share a dictionary
of the id pairs they link, then over all strips. What comes back to a strip is the
count of each pair it holds, so a pair that every document holds is one row for each
strip, not for each document, and the most frequent ones are joined by broadcast.

Defined results: null and empty texts, and texts whose bytes the tokens of either do
not give back, have zeros and an empty digest; very long texts are aligned whole;
repeated rows and ids count as documents of their own; a null id is an id like others;
an empty table gives an empty result; columns that are not named are never read, so
extra ones cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back, join_by_key, keyed, materialize
from cohortspark.llm._merge import many_words, ranges
from cohortspark.llm.bpe import tokenizer_spec
from cohortspark.llm.pieces import many_pieces, model_spec

#: Characters of the documents that share a dictionary of pairs; a longer text has its own.
STRIP = 4_000_000
#: Characters aligned in one go; a longer text is alone.
AT_ONCE = 500_000
#: Groups of more links than this have equal ids summed up before they are linked.
LARGE = 256


def shared_ends(ends: np.ndarray, others: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ends`` are cuts, and how many of ``others`` lie up to each cut.

    Both ascend over many texts; ``last`` has the place in ``ends`` of each text's last end,
    which is a cut. Texts have one token at least.
    """
    cut = np.zeros(len(ends), bool)
    upto = np.zeros(len(ends), np.int64)
    cut[last], upto[last] = True, np.searchsorted(others, ends[last]) + 1
    low, high = np.concatenate([[0], last[:-1] + 1]), last  # inner ends of each interval: low up to, not with, high
    radius = 0
    open_ = low < high
    low, high = low[open_], high[open_]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    while len(low):
        middle = (low + high - 1) // 2
        first, after = np.maximum(low, middle - radius), np.minimum(high, middle + radius + 1)
        width = after - first
        probe = ranges(first, width)
        at = np.searchsorted(others, ends[probe])
        hit = others[np.minimum(at, len(others) - 1)] == ends[probe]
        owner = np.repeat(np.arange(len(low)), width)[hit]
        probe, at = probe[hit], at[hit]
        near = np.lexsort((np.abs(probe - middle[owner]), owner)) if radius else slice(None)
        owner, probe, at = owner[near], probe[near], at[near]
        best = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        owner, probe, at = owner[best], probe[best], at[best]
        cut[probe], upto[probe] = True, at + 1
        found = np.zeros(len(low), bool)
        found[owner] = True
        halves = np.concatenate([low[owner], probe + 1]), np.concatenate([probe, high[owner]])
        some = halves[0] < halves[1]
        if some.any():
            waiting.append((halves[0][some], halves[1][some]))
        left = ~found & (width < high - low)  # not all of it looked at yet
        low, high, radius = low[left], high[left], 2 * radius + 1
        if not len(low) and waiting:
            low, high = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(low)
            low, high, radius, waiting = low[order], high[order], 0, []
    return cut, upto


class Aligner:
    """Two encoders and what is needed of their vocabularies; made once in each worker."""

    def __init__(self, first: str, second: bytes) -> None:
        self.words, self.pieces = many_words(first), many_pieces(second)
        bytes_a, bytes_b = self.words.coder.bytes_of, self.pieces.coder.bytes_of
        self.n_a, self.n_b = max(bytes_a) + 1, len(bytes_b)
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("pairs of ids do not fit 32 bits")
        own = [bytes_a.get(i, b"") for i in range(self.n_a)]
        self.width_a = np.array([len(x) for x in own], np.int64)
        self.text_a, self.at_a = np.frombuffer(b"".join(own), np.uint8), np.cumsum(self.width_a) - self.width_a
        self.width_b, self.text_b, self.at_b = self.pieces.width, self.pieces.text, self.pieces.text_at
        digits = np.zeros((max(self.n_a, self.n_b), 8), np.uint8)  # of each id, then a separator
        for i in range(len(digits)):
            shown = str(i).encode()
            digits[i, 7 - len(shown) : 7] = list(shown)
        digits[:, 7] = ord(",")
        self.digits = digits.view(np.uint64).ravel()
        self.shown = np.count_nonzero(digits, axis=1)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both; none for texts that are empty or not given back by their tokens."""
        a = self.words.encode_plain([" " + t for t in texts])
        b = self.pieces.encode(texts)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        good = self.given_back(a, raw, self.width_a, self.at_a, self.text_a) & self.given_back(b, raw, self.width_b, self.at_b, self.text_b)
        for i in np.flatnonzero(~good).tolist():
            a[i] = b[i] = np.zeros(0, np.uint32)
        return a, b

    @staticmethod
    def given_back(ids: list[np.ndarray], raw: list[bytes], width: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which texts are not empty and equal the bytes of their tokens."""
        want = np.array([len(x) for x in raw], np.int64)
        have = np.array([int(width[x].sum()) for x in ids], np.int64)
        good = np.flatnonzero((want == have) & (want > 0))
        out = np.zeros(len(raw), bool)
        if len(good):
            flat = np.concatenate([ids[i] for i in good.tolist()])
            same = text[ranges(at[flat], width[flat])] == np.frombuffer(b"".join([raw[i] for i in good.tolist()]), np.uint8)
            out[good] = np.logical_and.reduceat(same, np.cumsum(want[good]) - want[good])
        return out

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text ``n_a, n_b, n_groups, n_links, groups`` (its digest) and ``n_pairs``; end to end ``pairs`` (a * ``self.n_b`` + b, ascending in each text) and ``links``."""
        a, b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in own], np.int64) for own in (a, b))
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        doc = np.flatnonzero(n_a)
        out = {"n_a": n_a, "n_b": n_b, "groups": [""] * len(texts)}
        for name in ("n_groups", "n_links", "n_pairs"):
            out[name] = np.zeros(len(texts), np.int64)
        if not len(doc):
            return out | {"pairs": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)}
        last_a = np.cumsum(n_a[doc]) - 1
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])  # both give the same bytes, so the texts' bounds agree
        cut, upto = shared_ends(ends_a, ends_b, last_a)
        to_a = np.flatnonzero(cut) + 1
        to_b = upto[cut]
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        p, q = to_a - from_a, to_b - from_b
        group_doc = np.searchsorted(last_a, to_a - 1)
        out["n_groups"][doc] = np.bincount(group_doc, minlength=len(doc))
        out["n_links"][doc] = np.add.reduceat(p * q, np.searchsorted(group_doc, np.arange(len(doc))))

        group_a, group_b = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)
        shown = np.empty(len(a) + len(b), np.uint64)
        shown[np.arange(len(a)) + from_b[group_a]] = self.digits[a]
        shown[np.arange(len(b)) + to_a[group_b]] = self.digits[b]
        letters = shown.view(np.uint8).reshape(-1, 8)
        letters[to_a - 1 + from_b, 7] = ord("|")
        letters[to_a + to_b - 1, 7] = ord(";")
        is_last = np.concatenate([group_doc[1:] != group_doc[:-1], [True]])
        stop = (to_a + to_b)[is_last]
        letters[stop - 1, 7] = 0
        bound = (np.cumsum(self.shown[a])[to_a - 1] + np.cumsum(self.shown[b])[to_b - 1])[is_last] - np.arange(1, len(doc) + 1)
        flat = letters.ravel()
        flat = flat[flat > 0].tobytes()
        for i, low, high in zip(doc.tolist(), np.concatenate([[0], bound[:-1]]).tolist(), bound.tolist(), strict=True):
            out["groups"][i] = hashlib.sha256(flat[low:high]).hexdigest()

        n = p * q
        small = n <= LARGE
        own = np.repeat(np.flatnonzero(small), n[small])
        inner = ranges(np.zeros(int(small.sum()), np.int64), n[small])
        left, right = a[from_a[own] + inner // q[own]], b[from_b[own] + inner % q[own]]
        key = group_doc[own] << 32 | left * self.n_b + right
        links = np.ones(len(key), np.int64)
        large_keys, large_links = [], []
        for g in np.flatnonzero(~small).tolist():
            x, times_x = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
            y, times_y = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
            large_keys.append((group_doc[g] << 32 | x[:, None] * self.n_b + y).ravel())
            large_links.append((times_x[:, None] * times_y).ravel())
        if large_keys:
            key, links = np.concatenate([key, *large_keys]), np.concatenate([links, *large_links])
            order = np.argsort(key)
            key, links = key[order], links[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            links = np.add.reduceat(links, first)
        else:
            key = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            links = np.diff(np.append(first, len(key)))
        key = key[first]
        out["n_pairs"][doc] = np.bincount(key >> 32, minlength=len(doc))
        return out | {"pairs": key & 0xFFFFFFFF, "links": links}


_ALIGNERS: dict[str, Aligner] = {}


def aligner(first: str, second: bytes) -> Aligner:
    key = hashlib.md5(first.encode() + second).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(first, second)
    return _ALIGNERS[key]


def pieces_of(texts: list[str], chars: int) -> Iterator[slice]:
    """Stretches of texts with about as many characters each."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 and more in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def aligned_strips(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each strip of documents: what belongs to each document as arrays, ``pairs`` and in how many documents each is (``holders``), and as packed numbers of ``kinds`` the places in ``pairs`` (``index``) and ``links`` of document after document."""
    context = docs.sparkSession.sparkContext
    specs = context.broadcast((tokenizer_spec(first_path), model_spec(second_path)))
    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def strip(number: int, ids: list, parts: list[dict]) -> pa.RecordBatch:
        pairs = np.concatenate([x["pairs"] for x in parts])
        held, index, holders = np.unique(pairs, return_inverse=True, return_counts=True)
        index, links = narrow(index), narrow(np.concatenate([x["links"] for x in parts]))
        columns: dict[str, pa.Array] = {"strip": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64())}
        whole = pa.concat_arrays(ids)
        columns["doc_id"] = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        for name in (*NUMBERS, "n_pairs"):
            columns[name] = pa.array([np.concatenate([x[name] for x in parts])], pa.list_(pa.int64()))
        columns["groups_sha256"] = pa.array([[g for x in parts for g in x["groups"]]], pa.list_(pa.string()))
        columns |= {"pairs": pa.array([held.astype(np.int64)], pa.list_(pa.int64())), "holders": pa.array([holders], pa.list_(pa.int64()))}
        columns |= {"kinds": pa.array([f"{index.dtype.str} {links.dtype.str}"]), "index": pa.array([index.tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*specs.value)
        number = held = 0
        ids, parts = [], []
        for batch in batches:
            for at in range(0, len(batch), 512):
                texts = [t or "" for t in batch.column(1).slice(at, 512).to_pylist()]
                for part in pieces_of(texts, AT_ONCE):
                    n = sum(map(len, texts[part]))
                    if held and held + n > STRIP:
                        yield strip(number, ids, parts)
                        number, held, ids, parts = number + 1, 0, [], []
                        give_back()
                    ids.append(batch.column(0).slice(at + part.start, part.stop - part.start))
                    found = own.align(texts[part])
                    parts.append(found | {"pairs": found["pairs"].astype(np.uint32), "links": narrow(found["links"])})
                    held += n
        if parts:
            yield strip(number, ids, parts)
        give_back()

    schema = f"strip bigint, doc_id array<{kind}>, {', '.join(f'{n} array<bigint>' for n in (*NUMBERS, 'n_pairs'))}, groups_sha256 array<string>, pairs array<bigint>, holders array<bigint>, kinds string, index binary, links binary"
    return source.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: see the module, and ``pair_counts`` for the counts."""
    kind = keyed(docs, id_col, text_col).schema["doc_id"].dataType.simpleString()
    strips = materialize(aligned_strips(docs, first_path, second_path, id_col, text_col))
    entries = held_pairs(strips)
    counts = materialize(pair_counts(entries, vocabulary_size(second_path)))
    rows = entries.select(F.col("strip").alias("of"), "pair")
    replies = join_by_key(rows, counts.select("pair", "n_docs", "best"), "pair", counts.select("pair", F.col("n_strips").alias("n")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
        row = {name: left.column(name).combine_chunks() for name in left.column_names}
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        count, best = right.column("n_docs").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        numbers = {name: row[name].flatten().to_numpy() for name in (*NUMBERS, "n_pairs")}
        kinds = row["kinds"][0].as_py().split()
        index, links = (np.frombuffer(row[name][0].as_buffer(), kind) for name, kind in zip(("index", "links"), kinds, strict=True))
        links = links.astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(numbers["n_pairs"])])
        for name, value in (("n_best", links * best[index] if len(index) else links), ("count_sum", links * count[index] if len(index) else links)):
            sums = np.concatenate([[0], np.cumsum(value)])
            numbers[name] = sums[upto[1:]] - sums[upto[:-1]]
        columns = [row["doc_id"].flatten(), *(pa.array(numbers[n], pa.int64()) for n in names[1:-1]), row["groups_sha256"].flatten()]
        return pa.Table.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    payload = strips.drop("pairs", "holders")
    return payload.groupBy("strip").cogroup(replies.groupBy("of")).applyInArrow(run, schema)


def held_pairs(strips: DataFrame) -> DataFrame:
    """``strip, pair, n_docs``: a row for each pair that documents of a strip hold."""
    both = F.explode(F.arrays_zip("pairs", "holders"))
    return strips.select("strip", both.alias("x")).select("strip", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n_docs"))


def pair_counts(entries: DataFrame, n_b: int) -> DataFrame:
    """``pair, n_docs, n_strips, best``: in how many documents each pair of ids is linked, and whether no pair of the same first id is in more. First ids are as many as one vocabulary has, so what is highest for each is small enough for a broadcast."""
    counts = entries.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_strips")).withColumn("a", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("pair", "n_docs", "n_strips", (F.col("n_docs") == F.col("most")).alias("best"))


def vocabulary_size(path: str) -> int:
    from cohortspark.llm.pieces import fields

    return sum(1 for field, _ in fields(model_spec(path)) if field == 1)
