"""Finding what documents share, and what hangs together, without meeting in one place.

``deal`` packs (hash, item, payload) entries of a task into one row for each
bucket of hashes, about eight bytes an entry instead of a row for each; a bucket
is small enough for one task, and the number of buckets grows with the input.
``components`` is connected components by alternating large-star and small-star
steps, each a grouped minimum and an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import join_by_key, materialize

ENTRY = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("items", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("payload", pa.binary())])
DEALT = "bucket int, n long, items binary, counts binary, hashes binary, payload binary"
Join = Callable[[list[np.ndarray], int, list[int]], list[int]]
#: Least similarity of linked sets, in hundredths.
PERCENT = 75
#: Entries a task gathers before it packs them.
GATHERED = 1_000_000
U = np.uint64


def bucket_bits(n_entries: float, each: float = 500_000) -> int:
    """Bits of the number of buckets, for ``each`` entries a bucket at most on average."""
    return int(np.clip(np.ceil(np.log2(max(n_entries / each, 1))), 5, 26))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes first, so that equal bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def deal(h: np.ndarray, item: np.ndarray, bits: int, width: int = 5) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT from entries in any order. Of a hash, the top ``bits`` bits choose the bucket and the next ``width`` bytes stay."""
    bucket = (h >> U(64 - bits)).astype(np.int64)
    order = np.lexsort((item, bucket))
    bucket, item, low = bucket[order], item[order], (h[order] >> U(64 - bits - 8 * width)) & U((1 << 8 * width) - 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    for at in range(0, len(spans), 512):
        rows = []
        for a, b in spans[at : at + 512]:
            first = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(item[a:b]))])
            rows.append((int(bucket[a]), b - a, item[first].astype("<i8").tobytes(), np.diff(np.append(first, b)).astype("<u4").tobytes(), planes(low[a:b], width), b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)


def dealt(table: pa.Table, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (``width`` bytes) and items of a bucket."""
    columns = (table.column(k).to_pylist() for k in ("n", "items", "counts", "hashes"))
    rows = [(unplanes(x, n, width), np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4"))) for n, i, c, x in zip(*columns, strict=True)]
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


def group_of(x: int) -> int:
    """A bucket below 0 for what needs none: by content, so that a task that runs again gives the same."""
    return -1 - (int(x) * 0x9E3779B97F4A7C15 >> 20 & (1 << 30) - 1)


def ready_rows(a: np.ndarray, b: np.ndarray, each: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Edges as rows of DEALT that no bucket has to sort: ``items`` and ``hashes`` are their ends."""
    if len(a):
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        for x in range(0, len(pairs), each):
            ends = np.ascontiguousarray(pairs[x : x + each].T.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((group_of(ends.sum()), ends.shape[1], ends[0].tobytes(), b"", ends[1].tobytes(), b""), ENTRY, strict=True)], schema=ENTRY)


def deal_rows(h: np.ndarray, item: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT from entries in order of their hashes, each with an item of its own."""
    bucket = (h >> U(64 - bits)).astype(np.int64)
    low = (h >> U(24 - bits)) & U((1 << 40) - 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    for at in range(0, len(spans), 512):
        rows = [(int(bucket[a]), b - a, item[a:b].astype("<i8").tobytes(), b"", planes(low[a:b], 5), b"") for a, b in spans[at : at + 512]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)


def dealt_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) and items of a bucket of ``deal_rows``."""
    columns = (table.column(k).to_pylist() for k in ("n", "items", "hashes"))
    rows = [(unplanes(x, n, 5), np.frombuffer(i, "<i8")) for n, i, x in zip(*columns, strict=True)]
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


def in_groups(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, item); in that order, the number of each entry's group of equal hashes, and by group the number of different items."""
    order = np.lexsort((item, h))
    hs, its = h[order], item[order]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
    new_item = new_h | np.concatenate([[True], its[1:] != its[:-1]]) if len(hs) else new_h
    group = np.cumsum(new_h) - 1
    return order, group, np.bincount(group, new_item, minlength=int(new_h.sum())).astype(np.int64)


def gathered(parts: Iterator[tuple[np.ndarray, ...]], most: int = GATHERED) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays joined until there are ``most`` entries."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def by_bucket(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(run, schema)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the smallest node that it reaches. Self-links keep single nodes.

    Every step is written to the shared folder; whether another is needed is all that comes to the driver.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    links = edges.where("u <> v")
    for _ in range(limit):
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break  # stars: every node but the centres has one link, to a centre
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_by_key(both, low.select("u", "m"), "u", low.select("u", "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # a hub may hold any share of the links
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(links, nodes["node"] == links["u"], "left").select("node", F.coalesce("v", "node").alias("root"))


def linked_sets(sids: list[int], sets: list[np.ndarray], known: list[int | None], join: Join) -> list[int]:
    """For each set, the id of the first it hangs together with; ``known``: an id that it is joined to already."""
    at: dict[int, int] = {}
    joined = [at.setdefault(k if k is not None else s, i) for i, (s, k) in enumerate(zip(sids, known, strict=True))]
    return [sids[i] for i in join(sets, PERCENT, joined)]


def block_components(sets: DataFrame, id_col: str, set_col: str, sets_of: Callable[[pa.Table], list[np.ndarray]], join: Join, part_size: int) -> DataFrame:
    """``node, root`` after all links inside blocks, from ``sets(id_col, set_col, block, weight)``, a written table.

    Small blocks are dealt to tasks' shares of some ``part_size`` in weight; a block
    that weighs more than that is dealt to parts. ``join`` (sets, threshold and what is
    joined already; by set, the first that it hangs together with) sees each block or
    part, then of a block with parts every two. ``sets_of`` makes the sets of some rows.
    """
    sized = materialize(sets.groupBy("block").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")))
    total = sized.agg(F.sum("weight")).first()[0] or 0
    n_shares = max(1, -(-total // part_size)) * 2
    large = sized.where(F.col("weight") > part_size).select("block", F.ceil(F.col("weight") / F.lit(part_size)).cast("int").alias("parts"))
    tasks = int(min(max(n_shares, sets.sparkSession.sparkContext.defaultParallelism), 100_000))

    def run(table: pa.Table, keys: list[str], known: str | None = None) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys]) if keys else table
        sids, found = table.column(id_col).to_pylist(), sets_of(table)
        joined = table.column(known).to_pylist() if known else [None] * len(sids)
        differ = np.zeros(max(len(sids) - 1, 0), bool)
        for k in keys:
            differ |= np.diff(table.column(k).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), len(sids)]
        firsts: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            firsts += linked_sets(sids[a:b], found[a:b], joined[a:b], join)
        return pa.table({"a": pa.array(sids, pa.int64()), "b": pa.array(firsts, pa.int64())})

    few = large.isEmpty()
    small = sets if few else sets.join(large, "block", "left_anti")
    small = small.select("block", F.pmod(F.xxhash64("block"), F.lit(n_shares)).alias("share"), id_col, set_col)
    within = small.repartition(tasks, "share").groupBy("share").applyInArrow(lambda t: run(t, ["block"]), "a long, b long")
    if few:
        return within.select(F.col("a").alias("node"), F.col("b").alias("root"))
    parted = join_by_key(sets.select("block", id_col, set_col), large, "block", sized.select("block", "n"))
    parted = parted.withColumn("part", F.pmod(F.xxhash64(id_col), "parts").cast("int"))
    apart = materialize(parted.select("block", "part", id_col, set_col).groupBy("block", "part").applyInArrow(lambda t: run(t, []), "a long, b long"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    again = parted.join(apart.select(F.col("a").alias(id_col), F.col("b").alias("joined")), id_col)
    pairs = again.select("block", "part", other, id_col, set_col, "joined").where("part <> other").withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    met = pairs.select("block", "low", "high", id_col, set_col, "joined").groupBy("block", "low", "high").applyInArrow(lambda t: run(t, [], "joined"), "a long, b long")
    return components(within.unionByName(apart).unionByName(met))
