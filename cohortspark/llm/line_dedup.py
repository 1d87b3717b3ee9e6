"""Fuzzy line deduplication by MinHash.

Lines, compared in lower case and with single spaces, are sets of hashed character
shingles. ``BANDS`` bands of ``ROWS`` minimal hashes find candidates (99.5 % of
pairs at the threshold of 0.75, 99.96 % at 0.8); lines that hang together through
bands form a block, in which all pairs are verified exactly, with what is already
joined skipped. Components of verified links keep one line: the first, by document
id, then place.

Lines are equal if 128 bits of hash are. Candidates go by 64 of these; different
lines that agree in those are told apart by their text and are in no block. A task
adds up what its own lines share before anything is dealt out, so a line that a
third of all documents hold is one entry from each task; where places meet their
line's first one, the few lines with a share of all places go by broadcast.

Defined results: a null text is empty; lines without a character other than white
space are never removed; a line shorter than a shingle is one shingle; a text all of
whose lines go is empty; very long texts and lines are processed whole; rows with
equal ids are put in order by a hash of their texts, null ids first; repeated rows
have equal results; an empty table gives an empty result; columns that are not
named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back, join_by_key, materialize, row_key
from cohortspark.llm._links import DEALT, block_components, bucket_bits, by_bucket, components, deal_rows, dealt_rows, ready_rows

SHINGLE = 8
BANDS, ROWS = 20, 5
#: Characters of the lines in a part of a block, and lines a task gathers before it deals their bands out.
PART, GATHERED = 4_000_000, 60_000
#: Characters hashed at once: few enough for the processor's cache, and enough that calls do not count.
STRIP = 65_536
NO_ID = -(1 << 63)
#: Odd multipliers of the shingles' hashes.
MIXERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)
GAP = re.compile(r"[\x20\x09-\x0D]+")
#: What a line with other gaps than single spaces holds.
ODD = ("  ", "\t", "\v", "\f", "\r")

U = np.uint64
_TWO = struct.Struct("<qq")


def seeds() -> np.ndarray:
    """An odd multiplier for each hash function, by a rule: products modulo 2**32 put the hashes of shingles in an order of their own."""
    return np.frombuffer(hashlib.shake_128(b"line minhash").digest(4 * BANDS * ROWS), "<u4") | np.uint32(1)


_MULTIPLY = seeds()


def norms(text: str) -> list[str]:
    """The lines of a text as they are compared."""
    lines = text.lower().split("\n")
    if any(gap in text for gap in ODD):
        return [GAP.sub(" ", x).strip(" ") if any(gap in x for gap in ODD) else x.strip(" ") for x in lines]
    return [x.strip(" ") for x in lines]


def digest(line: str) -> bytes:
    """128 bits that stand for a line."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def names(line: str) -> tuple[int, int]:
    """``digest`` as two whole numbers."""
    return _TWO.unpack(digest(line))


def many_names(held: dict[bytes, str]) -> np.ndarray:
    """``names`` of lines by digest, a row each."""
    return np.frombuffer(b"".join(held), np.dtype(np.int64).newbyteorder(_TWO.format[0])).astype(np.int64).reshape(-1, 2)


def shingles_of(lines: list[str], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 or 32 bits of the character shingles of some lines, end to end and not yet sets, and where each line's begin."""
    half = 4 * np.dtype(kind).itemsize
    mixers = [kind(x & (1 << 2 * half) - 1 | 1) for x in MIXERS]
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    sizes = np.array([len(x) for x in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    h = (code + kind(1)) * mixers[0]
    h ^= h >> kind(half)
    done = 1
    while done < SHINGLE:  # of twice as many characters each time
        pair = h[:-done] * mixers[done.bit_length()]
        pair += h[done:]
        h = pair ^ (pair >> kind(half - 3))
        done *= 2
    h *= mixers[-1]
    h ^= h >> kind(half)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False  # shingles across two lines
    counts = sizes - SHINGLE + 1
    return h[inside], np.cumsum(counts) - counts


def bands(lines: list[str]) -> np.ndarray:
    """By line, BANDS hashes of 64 bits. Lines of about STRIP characters go through all hash functions together; a longer line is alone, a strip at a time."""
    low, begin = shingles_of(lines, np.uint32)
    least = np.full((BANDS * ROWS, len(lines)), 0xFFFFFFFF, np.uint32)
    cuts = [(0, len(low))] if len(lines) > 1 else [(a, min(a + STRIP, len(low))) for a in range(0, len(low), STRIP)]
    for a, b in cuts:
        strip = low[a:b]
        v, part = np.empty_like(strip), np.empty(len(lines), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(strip, _MULTIPLY[k], out=v)
            np.minimum.reduceat(v, begin, out=part)
            np.minimum(least[k], part, out=least[k])
    rows = least.reshape(BANDS, ROWS, len(lines))
    out = np.repeat(np.arange(1, BANDS + 1, dtype=U)[:, None], len(lines), 1)
    for r in range(ROWS):
        out = (out ^ rows[:, r]) * U(0xD6E8FEB86659FD93)
        out ^= out >> U(31)
    return out.T


def some_at_once(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of lines of STRIP characters at most; a longer line is alone."""
    a = chars = 0
    for i, line in enumerate(lines):
        if i > a and chars + len(line) > STRIP:
            yield a, i
            a, chars = i, 0
        chars += max(len(line), SHINGLE)
    if a < len(lines):
        yield a, len(lines)


def some_lines(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[dict[bytes, str]]:
    """Lines of a task by their 128-bit name, each once, about ``most`` at a time; the texts are in column ``text``."""
    held: dict[bytes, str] = {}
    for batch in batches:
        for value in batch.column(text):
            for line in norms(value.as_py() or ""):
                if line:
                    held[digest(line)] = line
            if len(held) >= most:
                yield held
                held = {}
    if held:
        yield held


def band_entries(bits: int):
    """mapInArrow over ``text``: DEALT entries (band, line). Of lines of the task that share a band only the first is dealt out; the others' edges to it follow ready-made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in some_lines(batches, 0, GATHERED):
            lids, lines = many_names(held)[:, 0], list(held.values())
            held.clear()
            h = np.empty((len(lines), BANDS), U)
            for a, b in some_at_once(lines):
                h[a:b] = bands(lines[a:b])
            h = h.ravel()
            width = U(int(len(h)).bit_length())
            place = np.sort((h >> width << width) | np.arange(len(h), dtype=U))  # by hash; the place in its low bits
            place = (place & ((U(1) << width) - U(1))).astype(np.int64)
            h, item = h[place], lids[place // BANDS]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            lead = item[first][np.cumsum(first) - 1]
            yield from ready_rows(item[~first], lead[~first])
            yield from deal_rows(h[first], item[first], bits)
        give_back()

    return run


def band_edges(table: pa.Table) -> pa.Table:
    """``a, b``: every line of a bucket and one that shares a band with it, the same for all that share it."""
    if table.column("bucket")[0].as_py() < 0:
        a, b = (np.concatenate([np.frombuffer(x, "<i8") for x in table.column(k).to_pylist()]) for k in ("items", "hashes"))
        return pa.table({"a": a, "b": b})
    h, item = dealt_rows(table)
    order = np.argsort(h)
    h, item = h[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low = np.repeat(np.minimum.reduceat(item, first), np.diff(np.append(first, len(item))))
    keep = item != low
    return pa.table({"a": item[keep], "b": low[keep]})


def sets_of(table: pa.Table) -> list[np.ndarray]:
    h, begin = shingles_of(table.column("norm").to_pylist())
    return [np.unique(x) for x in np.split(h, begin[1:])]


def verified(sets: list[np.ndarray], percent: int, joined: list[int]) -> list[int]:
    """By set, the first of those it hangs together with by exact Jaccard similarity.

    In order of size, each set meets those after it that are small enough to be alike:
    its shingles are marked, and the marks in all of these counted in one sweep. Where
    all of these hang together with it already, there is nothing to find.
    """
    n = len(sets)
    group = np.array(joined)
    if n > 1:
        size = np.array([len(s) for s in sets])
        order = np.argsort(size, kind="stable")
        size = size[order]
        flat = np.concatenate([sets[i] for i in order])
        values, flat = np.unique(flat, return_inverse=True)
        start = np.append(np.cumsum(size) - size, len(flat))
        last = np.searchsorted(size, size * 100 // percent, "right")
        own, mark = group[order], np.zeros(len(values), bool)
        for i in range(n - 1):
            a, b = i + 1, int(last[i])
            if a >= b or (own[a:b] == own[i]).all():
                continue
            mark[flat[start[i] : start[a]]] = True
            both = np.add.reduceat(mark[flat[start[a] : start[b]]], start[a:b] - start[a], dtype=np.int64)
            mark[flat[start[i] : start[a]]] = False
            alike = np.flatnonzero(100 * both >= percent * (size[i] + size[a:b] - both)) + a
            for x in set(own[alike].tolist()) - {own[i]}:
                own[own == x] = own[i]
        group[order] = own
    first = np.full(n, n)
    np.minimum.at(first, group, np.arange(n))
    return first[group].tolist()


def texts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` to ``lid, more, norm``."""
    for held in some_lines(batches, 0, GATHERED // 10):
        own = many_names(held)
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(list(held.values()), pa.string())], ["lid", "more", "norm"])


def places_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rid, ord, text`` to ``lid, more, rid, ord, pos``: every line that is not blank."""
    for batch in batches:
        row, lid, more, pos = [], [], [], []
        for i, value in enumerate(batch.column(2)):
            for p, line in enumerate(norms(value.as_py() or "")):
                if line:
                    a, b = names(line)
                    row.append(i)
                    lid.append(a)
                    more.append(b)
                    pos.append(p)
        of = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(more, pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(pos, pa.int32())], ["lid", "more", "rid", "ord", "pos"])


def line_classes(texts: DataFrame, n_bytes: int, part_size: int = PART) -> DataFrame:
    """``lid, more, root`` of the lines of ``text`` that some other line is like; a line is named by both numbers. Blocks are found by the first number alone; where different lines share it, the second names them inside."""
    entries = texts.select("text").mapInArrow(band_entries(bucket_bits(n_bytes, 6_000_000)), DEALT)
    blocks = components(by_bucket(entries, band_edges, "a long, b long").where("a <> b"))
    lines = texts.select("text").mapInArrow(texts_of_lines, "lid long, more long, norm string")
    found = lines.join(blocks.select(F.col("node").alias("lid"), F.col("root").alias("block")).hint("shuffle_hash"), "lid").groupBy("lid", "block").agg(F.collect_set(F.struct("more", "norm")).alias("own"))
    node = F.when(F.size("own") == 1, F.col("lid"))
    found = found.select("lid", "block", node.alias("node"), F.explode("own").alias("line")).select(F.coalesce("node", "line.more").alias("node"), "lid", "line.more", "line.norm", "block", F.length("line.norm").cast("long").alias("weight"))
    found = materialize(found)
    classes = block_components(found.select("node", "norm", "block", "weight"), "node", "norm", sets_of, verified, part_size)
    return found.select("node", "lid", "more").join(classes, "node").select("lid", "more", "root")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), part_size: int = PART) -> DataFrame:
    """``doc_id, text`` (what is left), ``n_lines, n_removed``, and the columns of ``keep``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *keep)
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base = base.withColumn("rid", row_key(base, "doc_id", "text"))
    classes = line_classes(base, n_bytes, part_size)
    places = materialize(base.select("rid", F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), "text").mapInArrow(places_of_lines, "lid long, more long, rid long, ord long, pos int"))

    lines = places.groupBy("lid", "more").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "rid", "pos")).alias("first"))
    lines = materialize(lines.join(classes, ["lid", "more"], "left").where("n > 1 or root is not null").select("lid", "more", "n", "first", "root"))
    near = lines.where("root is not null")
    roots = near.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines"))
    firsts = join_by_key(near.select("root", "lid", "more", "n"), roots.where("n > 1").select("root", "first"), "root", roots.select("root", F.col("lines").alias("n")))
    firsts = firsts.unionByName(lines.where("root is null and n > 1").select("root", "lid", "more", "n", "first"))
    firsts = firsts.select(F.struct("lid", "more").alias("line"), "n", "first")
    at = F.struct("ord", "rid", "pos")
    gone = join_by_key(places.select(F.struct("lid", "more").alias("line"), at.alias("at")), firsts.select("line", "first"), "line", firsts.select("line", "n"))
    gone = gone.where("at <> first").groupBy("at.rid").agg(F.collect_set("at.pos").alias("gone"))
    found = base.join(gone.hint("shuffle_hash"), "rid", "left")
    split = F.split("text", "\n")
    left = F.filter(split, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return found.select("doc_id", text.alias("text"), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), *keep)
