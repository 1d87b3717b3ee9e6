"""Voxel and pixel analytics (V) on long rows ``series, frame, y, x, v`` of any number of volumes. ``frame`` is a whole number, the place in the volume."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.components import TASK_VOXELS, by_series, series_tables, voxel_components

__all__ = ["voxel_components"]

FRAME = ("series", "frame")
#: Places of volumes that are held in arrays at once.
BATCH_PLACES = 4_000_000


def rescale(value: Column, slope: Column, intercept: Column) -> Column:
    """A slope of null or 0 counts as 1, a missing intercept as 0."""
    return value * F.coalesce(F.nullif(slope, F.lit(0.0)), F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))


def frame_places(voxels: DataFrame) -> DataFrame:
    """Voxels whose ``frame`` is anything that has an order (a date, a position) with its place in the series, from 0."""
    places = voxels.select("series", "frame").distinct().withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("frame")) - 1)
    return voxels.join(places, ["series", "frame"]).drop("frame").withColumnRenamed("place", "frame")


def frame_stats(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*FRAME).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), (F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns"), F.count(F.lit(1)).alias("n"))


def window_level(value: Column, low: Column, high: Column) -> Column:
    """Grey level 0 to 255; a flat plane is 0."""
    return F.when(high > low, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - low) * 255 / (high - low))))).otherwise(F.lit(0)).cast("int")


def plane_levels(voxels: DataFrame) -> DataFrame:
    """Each frame's voxels from its own least value (0) to its own largest (255)."""
    ends = voxels.groupBy(*FRAME).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return voxels.join(ends, list(FRAME)).select(*FRAME, "y", "x", window_level(F.col("v"), F.col("low"), F.col("high")).alias("level"))


def plane_slice(voxels: DataFrame, plane: str, index: int | None = None) -> DataFrame:
    """One plane of every volume: axial (a frame), coronal (a row) or sagittal (a column); the middle of each by default, the index clamped; z runs downwards in the last two."""
    axis = {"axial": "z", "coronal": "y", "sagittal": "x"}[plane]
    placed = frame_places(voxels).withColumnRenamed("frame", "z")
    last = placed.groupBy("series").agg(F.max(axis).alias("last"), F.max("z").alias("top"))
    wanted = F.floor((F.col("last") + 1) / 2) if index is None else F.lit(index)
    cut = placed.join(last, "series").where(F.col(axis) == F.greatest(F.lit(0), F.least(wanted, F.col("last"))))
    down = F.col("y") if plane == "axial" else F.col("top") - F.col("z")
    across = F.col("y") if plane == "sagittal" else F.col("x")
    return cut.select("series", down.cast("int").alias("row"), across.cast("int").alias("column"), "v")


def volume_manifest(voxels: DataFrame) -> DataFrame:
    """Shape by series; renderable if all frames have the same."""
    frames = voxels.groupBy("series", "frame").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns"))
    return frames.groupBy("series").agg(F.count(F.lit(1)).alias("frame_count"), F.max("rows").alias("rows"), F.max("columns").alias("columns"), (F.count_distinct("rows", "columns") == 1).alias("renderable"))


def frame_threshold(voxels: DataFrame, share: float = 0.97) -> DataFrame:
    """Voxels at or above their frame's percentile; frames with fewer than two hits vanish."""
    frame = Window.partitionBy(*FRAME)
    hits = voxels.withColumn("limit", F.percentile("v", share).over(frame)).where("v >= limit")
    return hits.withColumn("hits", F.count(F.lit(1)).over(frame)).where("hits >= 2").drop("hits", "limit")


def stride_sample(voxels: DataFrame, cap: int = 1000) -> DataFrame:
    """Every ``max(1, n // cap)``-th hit of a frame in row-major order: a sampling operator."""
    frame = Window.partitionBy(*FRAME)
    ranked = voxels.withColumns({"n": F.count(F.lit(1)).over(frame), "rank": F.row_number().over(frame.orderBy("y", "x"))})
    return ranked.where((F.col("rank") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / cap)) == 0).drop("n", "rank")


def top_components(components: DataFrame, min_size: int = 3, k: int = 8) -> DataFrame:
    """Of each series the ``k`` largest components of ``min_size`` voxels or more, ties to the first voxel: a top-k report."""
    sizes = components.groupBy("series", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    order = Window.partitionBy("series").orderBy(F.desc("n"), "component")
    return sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def patient_axes() -> dict[str, Column]:
    """Geometry of a frame with what is missing filled in: origin ``ox oy oz``, row axis ``rx ry rz``, column axis ``ux uy uz`` and spacing ``sx sy``."""
    usual = {"ox": 0.0, "oy": 0.0, "oz": 0.0, "rx": 1.0, "ry": 0.0, "rz": 0.0, "ux": 0.0, "uy": 1.0, "uz": 0.0, "sx": 1.0, "sy": 1.0}
    return {k: F.coalesce(F.col(k), F.lit(v)) for k, v in usual.items()}


def patient_point(x: Column, y: Column, g: dict[str, Column]) -> dict[str, Column]:
    """``px py pz`` of column ``x`` and row ``y``."""
    return {f"p{a}": g[f"o{a}"] + g[f"r{a}"] * x * g["sy"] + g[f"u{a}"] * y * g["sx"] for a in "xyz"}


def voxel_to_patient(voxels: DataFrame, frames: DataFrame) -> DataFrame:
    """Voxels with their place in patient space, by the geometry of ``frames(series, frame, ox..., rx..., ux..., sx, sy)``; a frame without one has the usual axes at the origin."""
    placed = voxels.join(frames, list(FRAME), "left")
    return placed.select(*voxels.columns, *(c.alias(k) for k, c in patient_point(F.col("x"), F.col("y"), patient_axes()).items()))


def series_volume_objects(instances: DataFrame, keys: list[str]) -> DataFrame:
    """A ``volume`` object for each series: the box around the four corners of all its instances (``rows, columns``, geometry as in ``patient_axes``), with the measures of the box."""
    have = set(instances.columns)
    g = {k: v if k in have else v_ for (k, v), v_ in zip(patient_axes().items(), map(F.lit, (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)), strict=True)}
    width, height = F.greatest(F.coalesce("columns", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("rows", F.lit(1)), F.lit(1))
    corners = [patient_point(a, b, g) for a in (F.lit(0), width) for b in (F.lit(0), height)]
    edge = {f"{x}{i}": f(*(c[f"p{x}"] for c in corners)) for x in "xyz" for i, f in ((0, F.least), (1, F.greatest))}
    box = instances.select(*keys, *(c.alias(k) for k, c in edge.items())).groupBy(*keys).agg(F.count(F.lit(1)).alias("instance_count"), *(f(f"{x}{i}").alias(f"{x}{i}") for x in "xyz" for i, f in ((0, F.min), (1, F.max))))
    w, h, l = (F.col(f"{x}1") - F.col(f"{x}0") for x in "xyz")  # noqa: E741
    return box.withColumns({f"c{x}": (F.col(f"{x}0") + F.col(f"{x}1")) / 2 for x in "xyz"} | {"obj_type": F.lit("volume"), "volume_mm3": w * h * l, "surface_area_mm2": 2 * (w * h + w * l + h * l)})


def resample_labels(labels: DataFrame, targets: DataFrame, grids: DataFrame) -> DataFrame:
    """``series, tx, ty, tz, label``: of each series the nearest label of ``series, x, y, z, label`` at each target voxel (``tx..`` and its place ``mx..`` in mm), 0 outside and where the series has no grid.

    ``grids`` has a row for each series: ``scale`` and by axis the size, first place and step of the
    source grid and the first and last place of the target grid (``size_x, start_x, step_x, first_x,
    last_x``...). Both centres meet, and the source is scaled about its own.
    """
    at, inside = {}, F.col("scale").isNotNull()
    for x in "xyz":
        size, start, step, first, last = (F.col(f"{n}_{x}") for n in ("size", "start", "step", "first", "last"))
        centre = start + (size - 1) * step / 2
        at[f"s{x}"] = F.bround((centre + (F.col(f"m{x}") - (first + last) / 2) / F.col("scale") - start) / step, 0).cast("int")
        inside = inside & (F.col(f"s{x}") >= 0) & (F.col(f"s{x}") < size)
    found = targets.join(grids, "series", "left").withColumns(at).withColumn("inside", F.coalesce(inside, F.lit(False)))
    wanted = found.select("series", "tx", "ty", "tz", *(F.when(F.col("inside"), F.col(f"s{x}")).alias(f"s{x}") for x in "xyz"))
    known = labels.select("series", *(F.col(x).alias(f"s{x}") for x in "xyz"), "label")
    return wanted.join(known, ["series", "sx", "sy", "sz"], "left").select("series", "tx", "ty", "tz", F.coalesce("label", F.lit(0)).alias("label"))


def region_objects(components: DataFrame, geometry: DataFrame, min_size: int = 1) -> DataFrame:
    """A box and volume for each component of each series, of at least one voxel's depth; ``geometry`` has ``series, sx, sy, sz`` in mm."""
    span = {f"{c}{i}": f(F.col(name)).alias(f"{c}{i}") for c, name in (("x", "x"), ("y", "y"), ("z", "frame")) for i, f in ((0, F.min), (1, F.max))}
    found = components.groupBy("series", "component").agg(F.count(F.lit(1)).alias("voxels"), *span.values()).where(F.col("voxels") >= min_size).join(geometry, "series")
    box = found.withColumns({f"{c}{i}": F.col(f"{c}{i}") * F.col(f"s{c}") for c in "xyz" for i in (0, 1)})
    deep = F.when(F.col("z1") == F.col("z0"), F.col("z0") + F.col("sz")).otherwise(F.col("z1"))
    return box.withColumns({"z1": deep, "volume": F.col("voxels") * F.col("sx") * F.col("sy") * F.col("sz")}).drop("sx", "sy", "sz")


def classify_segment(label: Column) -> Column:
    return F.when(F.lower(label).rlike("lesion|nodule|tumor|finding"), "finding").otherwise("anatomy")


def labelmap_objects(voxels: DataFrame, segments: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 2.0)) -> DataFrame:
    """An object for each (series, segment) of voxels ``series, segment, frame_index, x, y``, named by ``segments(segment, label)`` or ``Segment n``."""
    sx, sy, sz = spacing
    found = voxels.groupBy("series", "segment").agg(F.count(F.lit(1)).alias("voxel_count"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    named = found.join(segments, "segment", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Segment "), F.col("segment").cast("string"))))
    return named.withColumns({"volume": F.col("voxel_count") * F.lit(sx * sy * sz), "obj_type": classify_segment(F.col("label"))})


def exposed_surface(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 2.0)) -> DataFrame:
    """Faces without a neighbour and their area, by ``group`` of voxels ``group, x, y, z``."""
    sx, sy, sz = spacing
    faces = [(1, 0, 0, sy * sz), (-1, 0, 0, sy * sz), (0, 1, 0, sx * sz), (0, -1, 0, sx * sz), (0, 0, 1, sx * sy), (0, 0, -1, sx * sy)]
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(float(area)).alias("area")) for a, b, c, area in faces))
    sides = voxels.select("group", F.explode(steps).alias("s"), "x", "y", "z").select("group", "s.area", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("z") + F.col("s.dz")).alias("z"))
    return sides.join(voxels, ["group", "x", "y", "z"], "left_anti").groupBy("group").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"))


def dilate(voxels: DataFrame, shape: tuple[int, int, int], times: int = 1) -> DataFrame:
    """All places of the volume ``shape`` within ``times`` steps of a voxel ``series, x, y, z``: the city-block distance, one axis after the other, so three passes for any number of steps."""
    grown = voxels.select("series", "x", "y", "z", F.lit(0).alias("d")).distinct()
    for axis, n in zip("xyz", shape, strict=True):
        left = F.lit(times) - F.col("d")
        reach = F.sequence(F.greatest(F.lit(0), F.col(axis) - left), F.least(F.lit(n - 1), F.col(axis) + left))
        moved = grown.where(F.col(axis).between(0, n - 1)).withColumn("to", F.explode(reach)).withColumn("d", (F.col("d") + F.abs(F.col("to") - F.col(axis))).cast("int"))
        others = [c for c in "xyz" if c != axis]
        grown = moved.groupBy("series", *others, F.col("to").cast("int").alias(axis)).agg(F.min("d").alias("d"))
    return grown.select("series", "x", "y", "z")


def erode(voxels: DataFrame, times: int = 1) -> DataFrame:
    """Voxels ``series, x, y, z`` all of whose places within ``times`` steps are there.

    The city-block distance to the nearest place that is missing, by two running
    minima along each axis: inside a run of voxels both ends of the run are one step from what
    is missing, and a neighbour's distance counts one step more for each step away.
    """
    held = voxels.select("series", "x", "y", "z").distinct().withColumn("d", F.lit(1 << 30))
    for axis in "xyz":
        line = Window.partitionBy("series", *(c for c in "xyz" if c != axis)).orderBy(axis)
        run = Window.partitionBy("series", *(c for c in "xyz" if c != axis), "run")
        up, down = run.orderBy(axis), run.orderBy(F.desc(axis))
        at = F.col(axis)
        held = held.withColumn("run", at - F.row_number().over(line))
        ends = F.least(at - F.min(axis).over(run) + 1, F.max(axis).over(run) - at + 1)
        held = held.withColumn("d", F.least(ends, F.min(F.col("d") - at).over(up) + at, F.min(F.col("d") + at).over(down) - at)).drop("run")
    return held.where(F.col("d") > times).select("series", "x", "y", "z")


def closing(voxels: DataFrame, shape: tuple[int, int, int], times: int = 1) -> DataFrame:
    """``step, series, x, y, z``: voxels ``dilated`` within ``shape`` and, of these, what is left ``eroded``, by as many steps. Volumes of TASK_VOXELS places or fewer are grown whole in arrays, many to a task."""
    size = math.prod(shape)
    if size > TASK_VOXELS:
        grown = dilate(voxels, shape, times)
        return grown.select(F.lit("dilated").alias("step"), "*").unionByName(erode(grown, times).select(F.lit("eroded").alias("step"), "*"))

    def stepped(held: np.ndarray, grow: bool) -> np.ndarray:
        for _ in range(times):
            edged = np.pad(held, ((0, 0), (1, 1), (1, 1), (1, 1)))
            for axis in (1, 2, 3):
                for start in (0, 2):
                    beside = edged[tuple(slice(None) if a == 0 else slice(start, start + n) if a == axis else slice(1, -1) for a, n in enumerate(held.shape))]
                    held = held | beside if grow else held & beside
        return held

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in series_tables(batches):
            series = table.column("series").combine_chunks().dictionary_encode("encode")
            names, of = series.dictionary, series.indices.to_numpy().astype(np.int64)
            place = [table.column(c).to_numpy().astype(np.int64) for c in "xyz"]
            inside = np.all([(p >= 0) & (p < n) for p, n in zip(place, shape, strict=True)], axis=0)
            some = max(1, BATCH_PLACES // size)
            for start in range(0, len(names), some):
                held = np.zeros((min(some, len(names) - start), *shape), dtype=bool)
                own = inside & (of >= start) & (of < start + some)
                held[(of[own] - start, *(p[own] for p in place))] = True
                grown = stepped(held, True)
                for step, cells in (("dilated", grown), ("eroded", stepped(grown, False))):
                    at = np.nonzero(cells)
                    out = {"step": pa.array([step]).take(pa.array(np.zeros(len(at[0]), dtype=np.int8))), "series": names.take(pa.array(at[0] + start))}
                    yield from pa.table(out | {c: pa.array(a.astype(np.int32)) for c, a in zip("xyz", at[1:], strict=True)}).to_batches()

    kind = voxels.schema["series"].dataType.simpleString()
    return by_series(voxels.select("series", "x", "y", "z")).mapInArrow(close, f"step string, series {kind}, x int, y int, z int")


def triangle_area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area by mesh, from ``mesh, vertex, x, y, z`` and ``mesh, a, b, c``."""
    for corner in "abc":
        faces = faces.join(vertices.select("mesh", F.col("vertex").alias(corner), *(F.col(x).alias(corner + x) for x in "xyz")), ["mesh", corner])
    u, w = ([F.col(f"{k}{x}") - F.col(f"a{x}") for x in "xyz"] for k in "bc")
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    return faces.groupBy("mesh").agg(F.sum(F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 2).alias("area"))


def grid_decimate(vertices: DataFrame, faces: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of a cell become their mean; faces keep their cells, without degenerate and repeated ones."""
    cellular = vertices.withColumn("cell", F.concat_ws("|", *(F.floor(F.col(x) / cell).cast("string") for x in "xyz")))
    merged = cellular.groupBy("mesh", "cell").agg(*(F.avg(x).alias(x) for x in "xyz"))
    for corner in "abc":
        faces = faces.join(cellular.select("mesh", F.col("vertex").alias(corner), F.col("cell").alias(f"{corner}_cell")), ["mesh", corner])
    kept = faces.where("a_cell <> b_cell and b_cell <> c_cell and a_cell <> c_cell").select("mesh", F.array_sort(F.array("a_cell", "b_cell", "c_cell")).alias("cells")).distinct()
    return merged, kept


def nearest_slice(objects: DataFrame, instances: DataFrame) -> DataFrame:
    """The slice nearest to each object along z, the first on ties."""
    met = objects.select("model_id", "object_id", "cz").join(instances.select(F.col("study_uid").alias("model_id"), "z").distinct(), "model_id")
    return met.groupBy("model_id", "object_id").agg(F.min_by("z", F.struct(F.abs(F.col("z") - F.col("cz")), F.col("z"))).alias("slice_z"))
