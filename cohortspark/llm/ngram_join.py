"""Exact n-gram Jaccard self-join, as components of linked documents.

1. Documents with equal shingle sets are one from here on.
2. A set that links with another has at most ``n - ceil(t * n)`` shingles that no
   other set holds. Shingles are dealt out by hash, and each set gets the number
   of those that others hold too; half of the hash space is enough to rule out
   nearly every document that has no near copy, and rules out no other.
3. For what remains, shingles in order of frequency, rarest first: linked sets
   share one of their first ``n - ceil(t * n) + 1``. Sets that hang together
   through such shingles form a block.
4. In each block the sets, globally ordered, stand in a trie; a traversal shares
   partial overlaps and leaves subtrees by bounds on the remaining length. Blocks
   of more than ``BLOCK`` shingles are split: each part by itself, then every two
   parts, with what is already joined skipped.
5. Components over all links give the smallest document id that each reaches.

Defined results: null and empty texts, and those without words, have an empty set
and link with nothing; fewer than five words are one shingle; repeated rows have
equal results; a null id is never the smallest unless there is no other; an empty
table gives an empty result; very long texts are processed whole; columns that are
not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back, join_by_key, keyed, materialize, row_key
from cohortspark.llm._links import DEALT, GATHERED, PERCENT, block_components, bucket_bits, by_bucket, components, deal, dealt, group_of, in_groups
from cohortspark.llm._trie import link
from cohortspark.llm.shingles import in_batches, set_id, shingle_sets

WORDS = 5
#: Shingles in a part of a block.
BLOCK = 2_000_000
#: Share of the hash space that step 2 counts.
COUNTED = 0.5

U = np.uint64


def count_entries(bits: int):
    """mapInArrow over ``rid, text``: DEALT entries (shingle, set).

    A shingle that several sets of the task hold is dealt out once, without a set,
    and counted as shared here. In buckets below 0 stand members (``items`` rows,
    ``hashes`` sets in 128 bits, ``counts`` sizes, ``payload`` shingles in the counted
    half) and, without ``hashes``, those counts (``items`` sets, ``counts`` shared
    shingles).
    """

    def packed(items: np.ndarray, counts: np.ndarray, hashes: bytes = b"", payload: bytes = b"") -> pa.RecordBatch:
        row = (group_of(int(items.sum()) + len(items)), len(items), items.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), hashes, payload)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], ["bucket", "n", "items", "counts", "hashes", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([s for s, _ in held])
            item = np.repeat(np.array([i for _, i in held], np.int64), [len(s) for s, _ in held])
            order, group, distinct = in_groups(h, item)
            h, item = h[order], item[order]
            several = (distinct > 1)[group]
            if several.any():
                yield packed(*np.unique(item[several], return_counts=True))
            first = np.concatenate([[True], h[1:] != h[:-1]]) & several
            yield from deal(np.concatenate([h[~several], h[first]]), np.concatenate([item[~several], np.full(int(first.sum()), -1)]), bits)

        for batch in batches:
            rid = batch.column(0).to_numpy()
            ids, more, sizes, halves = np.zeros(len(rid), "<i8"), np.zeros(len(rid), "<i8"), np.zeros(len(rid), "<u4"), np.zeros(len(rid), "<u4")
            for at, texts in in_batches(batch.column(1)):
                for i, s in enumerate(shingle_sets(texts, WORDS), at):
                    half = s[: np.searchsorted(s, U(int(COUNTED * (1 << 64))))]
                    (ids[i], more[i]), sizes[i], halves[i] = set_id(s), len(s), len(half)
                    if len(half) and ids[i] not in seen:
                        seen.add(int(ids[i]))
                        held.append((half, int(ids[i])))
                        n += len(half)
                if n >= GATHERED:
                    yield from out()
                    held, n = [], 0
            yield packed(rid, sizes, ids.tobytes() + more.tobytes(), halves.tobytes())
        if n:
            yield from out()
        give_back()

    return run


COUNTS = "member boolean, rid long, sid long, more long, size long, half long, shared long"


def count_shared(table: pa.Table) -> pa.Table:
    """Members and counts as they are; for the sets of a bucket, their shingles that another set holds too."""
    arrays = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]).astype(np.int64)
    rid = more = size = half = shared = None
    if table.column("bucket")[0].as_py() >= 0:
        h, item = dealt(table)
        order, group, distinct = in_groups(h, item)
        h, item = h[order], item[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
        alone = (distinct == 1)[group] & (item[np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))][group] != -1)
        sid, shared = np.unique(item[new & ~alone & (item != -1)], return_counts=True)
    elif table.column("hashes")[0].as_py():
        rid, size, half = arrays("items", "<i8"), arrays("counts", "<u4"), arrays("payload", "<u4")
        sid, more = (np.concatenate(x) for x in zip(*(np.frombuffer(x, "<i8").reshape(2, -1) for x in table.column("hashes").to_pylist()), strict=True))
    else:
        sid, shared = arrays("items", "<i8"), arrays("counts", "<u4")
    none = np.zeros(len(sid), np.int64)
    filled = lambda x: none if x is None else x.astype(np.int64)
    return pa.table({"member": np.full(len(sid), rid is not None), "rid": filled(rid), "sid": sid, "more": filled(more), "size": filled(size), "half": filled(half), "shared": filled(shared)})


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sid, text`` to ``sid, shingles``; equal rows stand in one task and count once."""
    seen: set[int] = set()
    for batch in batches:
        sid = batch.column(0).to_pylist()
        for at, texts in in_batches(batch.column(1)):
            new = [i for i in range(len(texts)) if sid[at + i] not in seen and not seen.add(sid[at + i])]
            sets = shingle_sets([texts[i] for i in new], WORDS) if new else []
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([sid[at + i] for i in new], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "shingles"])


def must_share(size: Column) -> Column:
    """The least intersection of a set of this size with one that it links with."""
    return F.ceil(size * F.lit(PERCENT) / F.lit(100)).cast("long")


def prefix_links(sets: DataFrame) -> DataFrame:
    """``a, b``: every set with the first of those that share one of its rare shingles."""
    single = sets.select("sid", F.explode("shingles").alias("shingle"))
    common = materialize(single.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ranked = join_by_key(single, common, "shingle", common.select("shingle", F.col("df").alias("n"))).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    size = F.size("shingles").cast("long")
    n_prefix = size - must_share(size) + 1
    sized = sets.select("sid", (n_prefix - size).alias("over"))
    wanted = F.greatest(F.col("over") + F.size("ranked"), F.lit(0)).cast("int")
    prefix = materialize(ranked.join(sized, "sid").select("sid", F.explode(F.slice("ranked", F.lit(1), wanted)["shingle"]).alias("shingle")))
    first = prefix.groupBy("shingle").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_by_key(prefix, first.select("shingle", "first"), "shingle", first.select("shingle", "n"))
    return met.where("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b")).distinct()


def sets_of(table: pa.Table) -> list[np.ndarray]:
    shingles = table.column("shingles").combine_chunks()
    shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
    return [x.values.to_numpy().view(np.uint64) for x in shingles]


def placed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_size: int = BLOCK) -> DataFrame:
    """``doc_id, rid, sid, size, root``: each row with its hash, its shingle set, the number of shingles and its component."""
    base = keyed(docs, id_col, text_col)
    base = base.withColumn("rid", row_key(base))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = base.select("rid", "text").mapInArrow(count_entries(bucket_bits(n_bytes, 5_000_000)), DEALT)
    counts = by_bucket(entries, count_shared, COUNTS).groupBy("member", "rid", "sid", "more").agg(F.max("size").alias("size"), F.max("half").alias("half"), F.sum("shared").alias("shared"))
    counts = materialize(counts)

    # Sets of one name are told apart by the other 64 bits: where these differ, the name is made of both. Counts of shared shingles by the first name are then too high, which loses no set.
    members = counts.where("member").select("rid", "sid", "more", "size", "half")
    several = members.groupBy("sid").agg(F.min("more").alias("least"), F.max("more").alias("most")).where("least <> most").select("sid")
    named = members.join(several.withColumn("odd", F.lit(True)), "sid", "left").withColumn("old", F.col("sid"))
    members = named.select("rid", F.when(F.col("odd"), F.xxhash64("sid", "more")).otherwise(F.col("sid")).alias("sid"), "old", "size", "half")
    distinct = members.where("size > 0").groupBy("sid", "old").agg(F.min("rid").alias("rid"), F.max("size").alias("size"), F.max("half").alias("half"))
    left = distinct.join(counts.where("not member").select(F.col("sid").alias("old"), "shared"), "old", "left")
    alone = F.col("half") - F.coalesce("shared", F.lit(0))
    left = left.where(alone <= F.col("size") - must_share(F.col("size"))).select("rid", "sid")
    sets = materialize(base.select("rid", "text").join(left, "rid").select("sid", "text").mapInArrow(whole_sets, "sid long, shingles array<long>"))

    blocks = components(prefix_links(sets)).select(F.col("node").alias("sid"), F.col("root").alias("block"))
    inside = materialize(sets.join(blocks, "sid").select("sid", "shingles", "block", F.size("shingles").cast("long").alias("weight")))
    linked = block_components(inside, "sid", "shingles", sets_of, link, part_size)

    placed = base.select("rid", "doc_id").join(members, "rid").join(linked.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return materialize(placed.select("doc_id", "rid", "sid", "size", "root"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_size: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_equal``; ``n_equal``: documents with the same shingle set (0 if it is empty)."""
    placed = placed_rows(docs, id_col, text_col, part_size)
    equal = placed.where("size > 0").groupBy("root", "sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_equal"))
    roots = equal.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = equal.select("root", "sid", "n_equal").join(roots, "root").select("sid", "n_equal", "component_id")
    out = placed.join(classes, "sid", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"))
