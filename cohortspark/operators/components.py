"""Connected components: of graphs, and of the voxels of many volumes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.tables import drop_folder, join_by_key, shared_path, shared_table

#: Edge of a tile, and voxels that are labelled in one task, on average.
TILE, TASK_VOXELS = 64, 1_000_000
#: Voxels of whole series that are labelled at once.
BATCH_VOXELS = 100_000


def connected_components(nodes: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """``id, component`` (the smallest id reached) for nodes ``id`` and edges ``a, b``.

    Each round, every node takes the smallest label among its neighbours and its
    label's label, so paths halve. Rounds are written to the shared folder, and
    dropped with the next but one; hubs and large components meet by broadcast.
    """
    spark = nodes.sparkSession
    both = shared_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = shared_table(nodes.select("id", F.col("id").alias("component")))
    paths: list[str] = []
    for _ in range(limit):
        near = join_by_key(both, labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        jump = labels.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("jump"))  # the label of a component's own first node is itself
        stepped = join_by_key(labels, jump, "component", "left").join(near, "id", "left")
        least = F.least("component", "jump", "near")
        paths.append(shared_path(spark, "round"))
        stepped.select("id", least.alias("component"), (least < F.col("component")).alias("changed")).write.parquet(paths[-1])
        new = spark.read.parquet(paths[-1])
        labels = new.select("id", "component")
        if len(paths) > 1:
            drop_folder(spark, paths[-2])
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbered places the smallest one that pairs ``a, b`` lead to: larger roots are hung below smaller ones until no pair is left between two roots."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def tile_roots(voxels: DataFrame, tile: int = TILE) -> DataFrame:
    """Voxels ``series, frame, y, x`` and more, with the first voxel ``rf, ry, rx`` of what they hang together with inside their tile (six neighbours). Tiles are dealt to tasks, many small ones to one."""
    parts = max(1, -(-voxels.count() // TASK_VOXELS))
    at = [F.floor(F.col(c) / tile).cast("long") for c in ("frame", "y", "x")]
    dealt = voxels.withColumn("part", F.pmod(F.xxhash64("series", *at), F.lit(parts)))
    names = voxels.columns

    def label(table: pa.Table) -> pa.Table:
        series = table.column("series").combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        place = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("frame", "y", "x")], 1)
        block, inner = np.divmod(place, tile)
        _, of = np.unique(np.column_stack([series, block]), axis=0, return_inverse=True)
        code = ((of.ravel() * tile + inner[:, 0]) * tile + inner[:, 1]) * tile + inner[:, 2]
        cells, first, back = np.unique(code, return_index=True, return_inverse=True)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for step, axis in ((1, 2), (tile, 1), (tile * tile, 0)):
            a = np.flatnonzero(inner[first, axis] < tile - 1)
            at = np.minimum(np.searchsorted(cells, cells[a] + step), len(cells) - 1)
            hit = cells[at] == cells[a] + step
            ends.append((a[hit], at[hit]))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        root = place[first[least_reached(len(cells), a, b)]][back.ravel()]
        out = table.select(names)
        for i, name in enumerate(("rf", "ry", "rx")):
            out = out.append_column(name, pa.array(root[:, i]))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.schema.fields)
    return dealt.groupBy("part").applyInArrow(label, f"{schema}, rf long, ry long, rx long")


def series_tables(batches: Iterator[pa.RecordBatch], rows: int = BATCH_VOXELS) -> Iterator[pa.Table]:
    """Rows of whole series, some ``rows`` or more at once, of batches that have the rows of a series one after the other; an empty table where there are not enough yet."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(held)
        if len(table) < rows:
            yield table.slice(0, 0)
            continue
        code = table.column("series").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        other = np.flatnonzero(code != code[-1])
        done = int(other[-1]) + 1 if len(other) else 0
        held = [table.slice(done)]
        yield table.slice(0, done)
    if held:
        yield pa.concat_tables(held)


def by_series(voxels: DataFrame) -> DataFrame:
    """Voxels with the number of their series' voxels, ``n_``, dealt by series and one series after the other in each part; not dealt again where they are so already."""
    return voxels.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("series")))


def series_roots(voxels: DataFrame, most: int) -> DataFrame:
    """As ``tile_roots``, but over all of a series where it has ``most`` voxels at most and is not too wide for numbering its places; null for other series."""
    names = voxels.columns

    def roots(table: pa.Table) -> np.ndarray | None:
        series = table.column("series").combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        place = [table.column(c).to_numpy().astype(np.int64) for c in ("frame", "y", "x")]
        span = [int(p.max()) - int(p.min()) + 2 for p in place]  # a gap after each line
        if (int(series.max()) + 1) * span[0] * span[1] * span[2] >= 1 << 62:
            return None
        code = series
        for p, n in zip(place, span, strict=True):
            code = code * n + (p - p.min())
        cells, first, back = np.unique(code, return_index=True, return_inverse=True)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for step in (1, span[2], span[1] * span[2]):
            at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
            a = np.flatnonzero(cells[at] == cells + step)
            ends.append((a, at[a]))
        root = first[least_reached(len(cells), *(np.concatenate(x) for x in zip(*ends, strict=True)))][back.ravel()]
        return np.stack(place, 1)[root]

    def with_roots(table: pa.Table, root: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        table = table.select(names)
        for i, name in enumerate(("rf", "ry", "rx")):
            table = table.append_column(name, pa.nulls(len(table), pa.int64()) if root is None else pa.array(root[:, i]))
        return table.to_batches()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: list[pa.RecordBatch] = []

        def small() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits = pa.array(batch.column("n_").to_numpy() <= most)
                large.append(batch.filter(pa.compute.invert(fits)))
                yield batch.filter(fits)

        for table in series_tables(small()):
            if len(table):
                yield from with_roots(table, roots(table))
            for batch in large:
                yield from with_roots(pa.Table.from_batches([batch]), None)
            large.clear()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.schema.fields)
    return by_series(voxels).mapInArrow(label, f"{schema}, rf long, ry long, rx long")


def voxel_components(voxels: DataFrame, tile: int = TILE, whole: int = TASK_VOXELS) -> DataFrame:
    """Voxels ``series, frame, y, x`` and more (whole numbers but for the series; ``frame`` is the place in the volume) with ``component``, the first voxel ``frame, y, x`` of what they hang together with by six neighbours in their series.

    Series of ``whole`` voxels or fewer (and not too wide) are joined in arrays, many to a task. Larger ones
    are joined so inside tiles, and only what meets at the seams of tiles is joined over
    all tasks. A repeated voxel stays, with the same component.
    """
    root = F.struct(F.col("rf").alias("frame"), F.col("ry").alias("y"), F.col("rx").alias("x"))
    told = shared_table(series_roots(voxels, whole))
    small = told.where("rf is not null").withColumn("component", root).drop("rf", "ry", "rx")
    large = told.where("rf is null").drop("rf", "ry", "rx")
    if large.isEmpty():
        return small
    return small.unionByName(tiled_components(large, tile))


def tiled_components(voxels: DataFrame, tile: int) -> DataFrame:
    """``voxel_components`` of series of any size, by tiles and their seams."""
    parts = shared_table(tile_roots(voxels, tile))
    root = F.struct(F.col("rf").alias("frame"), F.col("ry").alias("y"), F.col("rx").alias("x"))
    id_ = F.struct("series", F.col("rf").alias("frame"), F.col("ry").alias("y"), F.col("rx").alias("x"))
    rim = F.lit(False)
    for c in ("frame", "y", "x"):
        rim = rim | (F.pmod(F.col(c), F.lit(tile)) == tile - 1) | (F.pmod(F.col(c), F.lit(tile)) == 0)
    faces = parts.where(rim).select("series", *(F.col(c).cast("long").alias(c) for c in ("frame", "y", "x")), id_.alias("id"))
    seams = None
    for axis in ("frame", "y", "x"):
        low = faces.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("id", "a")
        high = faces.where(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumnRenamed("id", "b")
        met = low.join(high, ["series", "frame", "y", "x"]).select("a", "b")
        seams = met if seams is None else seams.unionByName(met)
    seams = shared_table(seams.distinct())
    if seams.isEmpty():
        return parts.withColumn("component", root).drop("rf", "ry", "rx")
    nodes = seams.select(F.col("a").alias("id")).unionByName(seams.select(F.col("b").alias("id"))).distinct()
    found = connected_components(nodes, seams).select("id", F.col("component").alias("top"))
    top = lambda c: F.col("top")[c]
    joined = parts.withColumn("id", id_).join(found, "id", "left")
    component: Column = F.when(F.col("top").isNull(), root).otherwise(F.struct(*(top(c).alias(c) for c in ("frame", "y", "x"))))
    return joined.withColumn("component", component).drop("id", "top", "rf", "ry", "rx")
