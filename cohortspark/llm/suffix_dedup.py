"""Exact substring deduplication with suffix sorting.

A byte of a text goes if a string of ``min_length`` bytes that covers it also
starts in a document with a smaller id; strings are judged on the input and never
cross documents.

1. Of exact copies of a text only the one with the smallest id is looked at
   further; the others are covered from end to end.
2. Every string of ``min_length`` bytes has a minimizer, the smallest hash of the
   ``GRAM``-byte strings inside it. Strings that are equal have the same one at
   the same place, so only strings whose minimizer occurs in two texts are sorted.
3. Those strings meet by the hash of their minimizer, a bucket is one task's work.
   There the suffixes are put in order by deep-shallow sorting: multikey quicksort,
   eight bytes a key, to a shallow depth; the groups that still have long common
   prefixes by blind tries, which branch off a pivot's path at the first byte that
   differs. Neighbours that agree in all bytes are one string, and belong to the
   smallest id among them.
   Strings around a minimizer that very many texts hold are summed up by Spark
   first (smallest id by string), so that each different string is sorted once.
4. What was found goes back to the texts and is cut out.

Defined results: a null text is empty, with nothing removed; a text shorter than
``min_length`` bytes stays whole; very long texts are processed whole; a null id
counts as smaller than all others; rows with the same id never remove parts of each
other, and repeated rows have equal results; an empty table gives an empty result;
columns that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import HEAVY_KEYS, give_back, join_by_key, materialize, row_key
from cohortspark.llm._links import DEALT, bucket_bits, by_bucket, deal, dealt, gathered, group_of, in_groups

MIN_LENGTH = 50
#: Bytes of the strings that minimizers are chosen from.
GRAM = 24
#: Depth of the multikey quicksort in words of eight bytes.
SHALLOW_WORDS = 2
#: Texts in one task, and entries in one bucket, from which a minimizer is summed up first.
HOT_IN_TASK, HOT = 4096, 50_000
#: Bytes of text for each bucket of minimizers.
BUCKET_BYTES = 1_500_000
#: Minimizers a task gathers before it deals them out.
GATHERED = 400_000
#: Texts that are cut at once.
AT_ONCE = 500
#: Bytes of a minimizer's hash that stay beside its bucket.
WIDTH = 4
#: Rows, which no text has, that mark a minimizer as hot.
MARKS = (-(1 << 63), -(1 << 63) + 1)
#: Least id: that of rows without one.
NO_ID = -(1 << 63)

U = np.uint64


# --- strings and minimizers of a batch of texts


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number in the machine's order; ``buf`` has seven bytes to spare."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), 0, (1,)).copy()


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = pick(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1])
    return out


class Texts:
    """Some texts end to end, their hashes and windows; ``start`` and ``size`` by text."""

    def __init__(self, texts: list[bytes], min_length: int) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.buf = np.frombuffer(b"".join(texts) + bytes(min_length + 40), np.uint8)
        n, width = int(self.size.sum()), min_length - GRAM + 1
        w = words_at(self.buf)[: n + 32]
        h = (w[: n + min_length] * U(0x9E3779B97F4A7C15))[:n] + (w[8 : n + 8] * U(0xC2B2AE3D27D4EB4F))
        h ^= h >> U(29)
        h += w[16 : n + 16] * U(0x165667B19E3779F9)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(31)
        self.h = h
        self.text = np.repeat(np.arange(len(texts)), self.size)
        left = self.size[self.text] - (np.arange(n) - self.start[self.text])  # bytes to the end of the text
        self.window = left >= min_length  # a string starts here
        if n < width:
            self.low = np.zeros(0, U)
            self.chosen = np.zeros(n, bool)
            return
        self.low = sliding(h, width, np.minimum)  # by window: its smallest hash
        valid = np.where(self.window[: len(self.low)], self.low, U(0))
        edge = np.zeros(width - 1, U)
        self.chosen = sliding(np.concatenate([edge, valid, edge]), width, np.maximum)[:n] == h
        self.chosen &= h != 0


def spread(h: np.ndarray) -> np.ndarray:
    """Minimizers are small hashes; so that buckets are even, they are made uniform again."""
    return h * U(0xBF58476D1CE4E5B9)


def batches_of(batch: pa.RecordBatch, most: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of column 1 as bytes, a few MB at a time; a longer one is alone."""
    at, held, n = 0, [], 0
    for i, t in enumerate(batch.column(1).cast(pa.binary())):
        raw = t.as_py() or b""
        if held and n + len(raw) > most:
            yield at, held
            at, held, n = i, [], 0
        held.append(raw)
        n += len(raw)
    if held:
        yield at, held


# --- step 2: which minimizers two texts share


def minimizers(batch: pa.RecordBatch, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rid = batch.column(0).to_numpy()
    for at, texts in batches_of(batch):
        t = Texts(texts, min_length)
        place = np.flatnonzero(t.chosen)
        yield spread(t.h[place]), rid[at + t.text[place]]


def entries_of(min_length: int, bits: int, hot_in_task: int):
    """mapInArrow over ``rid, text``: DEALT entries; a minimizer that very many texts of the task hold, as two marks and, beside them, its own entries ready-made (a bucket below 0, the true one in ``payload``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, rid in gathered((x for b in batches for x in minimizers(b, min_length)), GATHERED):
            order, group, distinct = in_groups(h, rid)
            hot = (distinct > hot_in_task)[group]
            h, rid = h[order], rid[order]
            if hot.any():
                marks = h[np.concatenate([[True], h[1:] != h[:-1]]) & hot]
                for b in deal(h[hot], rid[hot], bits, WIDTH):
                    true = b.column(0).to_pylist()
                    own = [group_of((x << 40) + int(np.frombuffer(i, "<i8").sum())) for x, i in zip(true, b.column(2).to_pylist(), strict=True)]  # a group of its own, wherever that is
                    yield b.set_column(0, "bucket", pa.array(own, pa.int32())).set_column(5, "payload", pa.array([x.to_bytes(4, "little") for x in true], pa.binary()))
                h, rid = np.concatenate([h[~hot], marks, marks]), np.concatenate([rid[~hot], *(np.full(len(marks), m) for m in MARKS)])
            yield from deal(h, rid, bits, WIDTH)
        give_back()

    return run


FLAGGED = "rid long, minimizer long, hot boolean"


def shared_minimizers(hot_from: int):
    def run(table: pa.Table) -> pa.Table:
        """Minimizers of a bucket, by text, that two texts or more hold; all those of a group that a task has found to be hot."""
        h, rid = dealt(table, WIDTH)
        if table.column("bucket")[0].as_py() < 0:
            true = np.array([int.from_bytes(x, "little") for x in table.column("payload").to_pylist()], np.int64)
            full = (np.repeat(true, table.column("n").to_numpy()) << 8 * WIDTH) + h.astype(np.int64)
            return pa.table({"rid": rid, "minimizer": full, "hot": np.ones(len(rid), bool)})
        order, group, distinct = in_groups(h, rid)
        rid, full = rid[order], (table.column("bucket")[0].as_py() << 8 * WIDTH) + h[order].astype(np.int64)
        marked = rid <= MARKS[1]
        n = len(distinct)
        hot = (np.bincount(group, marked, minlength=n) > 0) | (np.bincount(group, minlength=n) > hot_from)
        keep = (distinct > 1)[group] & ~marked
        keep[1:] &= (rid[1:] != rid[:-1]) | (group[1:] != group[:-1])
        return pa.table({"rid": rid[keep], "minimizer": full[keep], "hot": hot[group][keep]})

    return run


# --- step 3: the strings around shared minimizers, and their order

PIECE = "bucket int, rid long, ord long, start int, n int, bytes binary"


def pieces_of(min_length: int, bits: int, hot: bool):
    """mapInArrow over ``rid, text, ord, shared``: the strings whose first minimizer is one of those shared, as a stretch of text; if ``hot``, one by one, with no bucket yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = min_length - GRAM + 1
        for batch in batches:
            rid, ords = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at, texts in batches_of(batch):
                t = Texts(texts, min_length)
                of = batch.column(3).slice(at, len(texts))
                owner = np.repeat(np.arange(len(texts)), np.array([len(x) for x in of], np.int64)).astype(U)
                wanted = of.flatten().to_numpy().astype(U) + owner * U(0x9E3779B97F4A7C15)  # text and minimizer as one number; one that meets another by chance is only sorted in vain
                # by window, its first minimizer: the first chosen place from its start on with its smallest hash
                chosen = np.flatnonzero(t.chosen)
                own = (spread(t.h[chosen]) >> U(64 - bits - 8 * WIDTH)) + t.text[chosen].astype(U) * U(0x9E3779B97F4A7C15)
                flagged = np.isin(own, wanted)
                p = np.flatnonzero(t.window)
                if not len(p) or not len(chosen):
                    continue
                k = np.searchsorted(chosen, p)
                todo = np.arange(len(p))
                while len(todo):
                    wrong = t.h[chosen[np.minimum(k[todo], len(chosen) - 1)]] != t.low[p[todo]]
                    todo = todo[wrong]
                    k[todo] += 1
                ok = flagged[k]
                p, m = p[ok], chosen[k[ok]]
                if not len(p):
                    continue
                new = np.ones(len(p), bool) if hot else np.concatenate([[True], (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(p)))
                a, m = p[first], m[first]
                text = t.text[a]
                bucket = (spread(t.h[m]) >> U(64 - bits)).astype(np.int32)
                raw = t.buf.tobytes()
                for x in range(0, len(a), 10_000):
                    s = slice(x, x + 10_000)
                    strings = [raw[i : i + j + min_length - 1] for i, j in zip(a[s].tolist(), n[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(rid[at + text[s]]), pa.array(ords[at + text[s]]), pa.array((a[s] - t.start[text[s]]).astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(strings, pa.binary())], ["bucket", "rid", "ord", "start", "n", "bytes"])
        give_back()

    return run


def key_at(words: np.ndarray, at: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Bytes ``depth`` to ``depth + 8`` of the strings, big end first, without those from ``length`` on."""
    key = words[at + depth].byteswap()
    return key if depth + 8 <= length else key & U((~0 << 8 * (depth + 8 - length)) & (1 << 64) - 1)


def deep_shallow(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``length``-byte strings that start at ``at``, and in that order whether each differs from the one before."""
    words = words_at(buf)
    order = np.arange(len(at))
    new = np.zeros(len(at), bool)
    new[:1] = True
    if not len(at):
        return order, new
    shallow = min(SHALLOW_WORDS * 8, length)
    for depth in range(0, shallow, 8):  # multikey quicksort, a word at a time, of groups that are still together
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero((np.bincount(group) > 1)[group])
        if not len(open_):
            return order, new
        key = key_at(words, at[order[open_]], depth, length)
        by = np.lexsort((key, group[open_])) if depth else np.argsort(key, kind="stable")
        order[open_], key, g = order[open_][by], key[by], group[open_]
        new[open_[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])
    # blind tries: a group branches off its pivot's path at (depth of the first byte that differs, that byte)
    group = np.cumsum(new) - 1
    open_ = np.flatnonzero((np.bincount(group) > 1)[group]) if shallow < length else np.zeros(0, np.int64)
    while len(open_):
        g = group[open_]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        pivot = at[order[open_[first]]][np.cumsum(first) - 1]
        own = at[order[open_]]
        depth, byte, side = np.full(len(own), length), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        todo = np.arange(len(own))
        for d in range(shallow, length, 8):
            x, y = key_at(words, own[todo], d, length), key_at(words, pivot[todo], d, length)
            differ = np.flatnonzero(x != y)
            if len(differ):
                z, i = (x ^ y)[differ], todo[differ]
                lead = np.zeros(len(z), np.int64)
                for k in range(1, 8):
                    lead += z < (U(1) << U(64 - 8 * k))
                depth[i] = d + lead
                byte[i] = (x[differ] >> (U(56) - U(8) * lead.astype(U))).astype(np.int64) & 255
                side[i] = np.where(x[differ] < y[differ], -1, 1)
                todo = np.delete(todo, differ)
            if not len(todo):
                break
        # smaller than the pivot: the earlier it leaves the path, the smaller; larger: the other way round
        place = np.where(side < 0, depth - length, np.where(side > 0, 2 * length - depth, 0))
        by = np.lexsort((byte, place, g))
        order[open_], place, byte = order[open_][by], place[by], byte[by]
        same = np.concatenate([[False], (g[1:] == g[:-1]) & (place[1:] == place[:-1]) & (byte[1:] == byte[:-1])])
        new[open_] |= ~same
        group = np.cumsum(new) - 1
        again = place != 0  # those equal to the pivot are done
        sizes = np.bincount(group)
        open_ = open_[again & (sizes[group[open_]] > 1)]
    return order, new


def owners(table: pa.Table, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings in the pieces of ``table`` (``ord, n, bytes``): the piece, the place in it, the smallest id that holds the string, and the string's number in order."""
    raw = table.column("bytes").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    buf = np.concatenate([data, np.zeros(min_length + 16, np.uint8)])
    n = table.column("n").to_numpy().astype(np.int64)
    piece = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    order, new = deep_shallow(buf, offsets[piece] + inside, min_length)
    low, rank = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
    if len(piece):
        first = np.flatnonzero(new)
        rank[order] = np.cumsum(new) - 1
        low[order] = np.repeat(np.minimum.reduceat(table.column("ord").to_numpy()[piece][order], first), np.diff(np.append(first, len(piece))))
    return piece, inside, low, rank


SPAN = "rid long, a int, b int"


def spans_of(min_length: int):
    def run(table: pa.Table) -> pa.Table:
        """Stretches of a text, from ``a`` to before ``b``, that its strings owned by a smaller id cover."""
        piece, inside, low, _ = owners(table, min_length)
        gone = low < table.column("ord").to_numpy()[piece]
        piece, place = piece[gone], inside[gone] + table.column("start").to_numpy()[piece[gone]]
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)]) if len(piece) else np.zeros(0, bool)
        last = np.append(new[1:], True) if len(piece) else new
        return pa.table({"rid": table.column("rid").to_numpy()[piece[new]], "a": place[new].astype(np.int32), "b": (place[last] + min_length).astype(np.int32)})

    return run


def owners_of(min_length: int):
    def run(table: pa.Table) -> pa.Table:
        """Each different string once, with the smallest id that holds it and how often it stands."""
        piece, _, low, rank = owners(table, min_length)
        _, first = np.unique(rank, return_index=True)
        times = np.bincount(rank, table.column("times").to_numpy()[piece], minlength=len(first)).astype(np.int64)
        return pa.table({"bytes": table.column("bytes").combine_chunks().take(pa.array(piece[first])), "owner": low[first], "times": times})

    return run


def once_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ord, bytes`` to ``ord, bytes, times``: equal strings of a task as one, at most ``GATHERED`` rows at a time, so that a string of very many texts is dealt out a few times for each task."""
    held: list[pa.RecordBatch] = []
    n = 0

    def summed() -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by("bytes").aggregate([("ord", "min"), ("ord", "count")])
        yield from found.select(["ord_min", "bytes", "ord_count"]).rename_columns(["ord", "bytes", "times"]).to_batches(10_000)

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= GATHERED:
            yield from summed()
            held, n = [], 0
    if n:
        yield from summed()


# --- step 4


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(min_length: int, keep: tuple[str, ...], forms: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``doc_id, text, copy, spans`` to the result."""
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, len(b), AT_ONCE)):
            kept, runs, sizes = [], [], []
            for text, copy, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py()
                gone = [(0, len(raw))] if copy.as_py() and len(raw) >= min_length else merged([(s["a"], s["b"]) for s in spans.as_py() or ()])
                at, parts = 0, []
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                runs.append([{"start": a, "end": b} for a, b in gone])
                sizes.append(len(raw))
            left = [pa.array(kept, pa.binary()) if f == "kept" else pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) for f in forms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), *left, *batch.columns[4:]], ["doc_id", "n_bytes", "spans", *forms, *keep])
        give_back()

    return run


def suffix_dedup(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hot_in_task: int = HOT_IN_TASK, hot: int = HOT, forms: tuple[str, ...] = ("kept", "text")) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, text``, and the columns of ``keep``: the maximal removed stretches (array of start and end, in bytes), and the remaining bytes of every text, as they are and without those of characters cut in two (of these two only ``forms``, in that order). Ids are whole numbers."""
    if min_length < GRAM + 8:
        raise ValueError(f"min_length must be at least {GRAM + 8}")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *keep)
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(n_bytes, BUCKET_BYTES)
    order = F.coalesce("doc_id", F.lit(NO_ID))
    rid = row_key(base, "doc_id", "text")
    texts = base.select(rid.alias("rid"), "doc_id", "text", *keep).repartition("rid")  # dealt out once; all joins with the texts read this exchange
    info = materialize(base.select(rid.alias("rid"), order.alias("ord"), F.unhex(F.sha2("text", 256)).alias("sha")).distinct())
    firsts = info.groupBy("sha").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = join_by_key(info, firsts.select("sha", "first"), "sha", firsts.select("sha", "n")).where("ord > first").select("rid", F.lit(True).alias("found"))
    info = info.join(copies, "rid", "left").select("rid", "ord", F.coalesce("found", F.lit(False)).alias("copy"))

    looked_at = texts.join(info.where("not copy").select("rid"), "rid").select("rid", "text", order.alias("ord"), *keep)
    flagged = by_bucket(looked_at.mapInArrow(entries_of(min_length, bits, hot_in_task), DEALT), shared_minimizers(hot), FLAGGED)
    places = flagged.groupBy("rid").agg(*(F.collect_set(F.when(F.col("hot") == warm, F.col("minimizer"))).alias(name) for warm, name in ((False, "cold"), (True, "hot"))))
    around = looked_at.join(places, "rid")

    def pieces(kind: str) -> DataFrame:
        return around.where(F.size(kind) > 0).select("rid", "text", "ord", F.col(kind).alias("shared"), *keep).mapInArrow(pieces_of(min_length, bits, kind == "hot"), PIECE)

    cold = by_bucket(pieces("cold"), spans_of(min_length), SPAN)
    single = pieces("hot").select("rid", "ord", "start", "bytes")
    once = single.select("ord", "bytes").mapInArrow(once_in_task, "ord long, bytes binary, times long").select(F.pmod(F.xxhash64("bytes"), F.lit(1 << bits)).cast("int").alias("bucket"), F.lit(1).alias("n"), "ord", "bytes", "times")
    owned = materialize(by_bucket(once, owners_of(min_length), "bytes binary, owner long, times long"))
    total = owned.agg(F.sum("times")).first()[0] or 0
    often = owned.where(F.col("times") >= max(total / HEAVY_KEYS, 8)).select("bytes", F.col("owner").alias("known"))  # HEAVY_KEYS rows at most
    told = single.join(F.broadcast(often), "bytes", "left").where("known is null or known < ord")
    told = materialize(told.select("rid", "start", "ord", F.when(F.col("known").isNull(), F.col("bytes")).alias("bytes"), "known"))
    rest = told.where("known is null").drop("known").join(owned.select("bytes", "owner"), "bytes").where("owner < ord")
    warm = told.where("known is not null").select("rid", "start").unionByName(rest.select("rid", "start"))
    warm = warm.select("rid", F.col("start").alias("a"), (F.col("start") + min_length).cast("int").alias("b"))
    spans = cold.unionByName(warm).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    found = info.select("rid", "copy").distinct().join(spans, "rid", "left")
    more = "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    return texts.join(found, "rid").select("doc_id", "text", "copy", "spans", *keep).mapInArrow(cut_out(min_length, keep, forms), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>" + "".join(f", {f} {'binary' if f == 'kept' else 'string'}" for f in forms) + more)
