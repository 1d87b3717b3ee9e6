"""Spatial operators over boxes (G): pairs, grid joins, nearest, radius, trajectories.

Pairs meet by an equi-join on ``model_id``. Where models are large, ``grid=True``
meets them by the cells that their boxes touch, and each pair counts only in the
cell that holds the larger of the two lower corners, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import geometry as g
from cohortspark.operators.tables import shared_table

BOX = [f"{x}{i}" for x in "xyz" for i in (0, 1)]
SHAPE = ["object_id", "obj_seq", "label", "obj_type", "cx", "cy", "cz", *BOX]
NEAR_MM = 45.0
CELL = 64.0
#: Objects of a model up to which all of them meet; only in larger ones are they looked for by cell.
WHOLE = 500


def side(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects with their columns prefixed, but for ``model_id``."""
    return objects.select("model_id", *(F.col(c).alias(prefix + c) for c in SHAPE))


def pairs(objects: DataFrame) -> DataFrame:
    """Unordered pairs of a model's objects, the earlier as ``a_``."""
    return side(objects, "a_").join(side(objects, "b_"), "model_id").where("a_obj_seq < b_obj_seq")


def cell_range(p: str, x: str, pad: Column | float = 0.0, cell: float = CELL) -> Column:
    return F.sequence(F.floor((F.col(f"{p}{x}0") - pad) / cell), F.floor((F.col(f"{p}{x}1") + pad) / cell))


def grid_cells(boxes: DataFrame, p: str = "", pad: Column | float = 0.0, cell: float = CELL) -> DataFrame:
    """Every cell that a box touches, as ``gx gy gz``."""
    for x in g.AXES:
        boxes = boxes.withColumn(f"g{x}", F.explode(cell_range(p, x, pad, cell)))
    return boxes


def grid_pairs(objects: DataFrame, within: float = NEAR_MM, cell: float = CELL) -> DataFrame:
    """As ``pairs``, but only those whose boxes, padded by half of ``within``, touch; by cell."""
    half = within / 2
    a, b = grid_cells(side(objects, "a_"), "a_", half, cell), grid_cells(side(objects, "b_"), "b_", half, cell)
    home = [F.col(f"g{x}") == F.floor((F.greatest(f"a_{x}0", f"b_{x}0") - half) / cell) for x in g.AXES]
    met = a.join(b, ["model_id", "gx", "gy", "gz"]).where("a_obj_seq < b_obj_seq")
    return met.where(home[0] & home[1] & home[2]).drop("gx", "gy", "gz")


def relation() -> Column:
    """First of contains, inside, intersects, near that holds for a pair; null for none."""
    return (
        F.when(g.contains("a_", "b_"), "contains")
        .when(g.contains("b_", "a_"), "inside")
        .when(g.intersects("a_", "b_"), "intersects")
        .when(g.box_distance("a_", "b_") <= NEAR_MM, "near")
    )


def derive_relationships(objects: DataFrame, grid: bool = False) -> DataFrame:
    """Directed edges ``model_id, source_id, target_id, type, value, unit``; both directions of each pair, containment as contains and inside."""
    found = (grid_pairs(objects) if grid else pairs(objects)).withColumn("type", relation()).where("type is not null")
    opposite = F.when(F.col("type") == "contains", "inside").when(F.col("type") == "inside", "contains").otherwise(F.col("type"))
    gap = F.when(F.col("type") == "near", g.box_distance("a_", "b_"))
    ends = F.array(
        F.struct(F.col("a_object_id").alias("source_id"), F.col("b_object_id").alias("target_id"), F.col("type").alias("type")),
        F.struct(F.col("b_object_id").alias("source_id"), F.col("a_object_id").alias("target_id"), opposite.alias("type")),
    )
    edges = found.select("model_id", gap.alias("value"), F.explode(ends).alias("e"))
    return edges.select("model_id", "e.source_id", "e.target_id", "e.type", "value", F.when(F.col("value").isNotNull(), "mm").alias("unit"))


def box_query(objects: DataFrame, boxes: DataFrame, refine: bool = True, cell: float = CELL) -> DataFrame:
    """``query_id, model_id, object_id`` of objects that share a cell with a query box (``query_id, model_id, q_x0...``), or, if ``refine``, that meet it."""
    met = grid_cells(side(objects, "o_"), "o_", cell=cell).join(grid_cells(boxes, "q_", cell=cell), ["model_id", "gx", "gy", "gz"])
    if refine:
        met = met.where(g.intersects("o_", "q_"))
    return met.select("query_id", "model_id", F.col("o_object_id").alias("object_id")).distinct()


def ordered_pairs(objects: DataFrame) -> DataFrame:
    return side(objects, "a_").join(side(objects, "b_"), "model_id").where("a_obj_seq <> b_obj_seq")


def close_pairs(objects: DataFrame, within: float) -> DataFrame:
    """Pairs in both orders whose boxes are at most ``within`` apart, met by the cells of a grid: work that grows with a large model's objects and not with their square."""
    met = grid_pairs(objects, within, max(CELL, within)).where(g.box_distance("a_", "b_") <= within)
    swap = [F.col(("b_" if c.startswith("a_") else "a_") + c[2:]).alias(c) if c != "model_id" else F.col(c) for c in met.columns]
    return met.unionByName(met.select(*swap))


def ranked_near(met: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("model_id", "a_obj_seq").orderBy("gap", "b_obj_seq")
    found = met.where(~g.contains("b_", "a_")).withColumn("gap", g.box_distance("a_", "b_")).withColumn("rank", F.row_number().over(rank))
    return found.where(F.col("rank") <= k).select("model_id", F.col("a_object_id").alias("object_id"), F.col("b_object_id").alias("near_id"), "rank", "gap")


def nearest(objects: DataFrame, k: int = 5, grid: bool = False) -> DataFrame:
    """The ``k`` nearest other objects of each, without those that contain it; ties in order of the model.

    Pairs are those of a model; where models are large, ``grid`` looks in growing rings
    instead: objects with ``k`` others within the ring are settled, and the ring of the
    rest doubles until it holds the whole scene.
    """
    if not grid:
        return ranked_near(ordered_pairs(objects), k)
    span = objects.agg(*(F.max(f"{x}1") - F.min(f"{x}0") for x in "xyz")).first()
    widest = sum((v or 0.0) ** 2 for v in span) ** 0.5
    ring, left, out = CELL, objects.select("model_id", "object_id"), None
    while True:
        found = ranked_near(close_pairs(objects, ring), k).join(left, ["model_id", "object_id"], "left_semi")
        if ring < widest:
            full = found.groupBy("model_id", "object_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("model_id", "object_id")
            found = shared_table(found.join(full, ["model_id", "object_id"], "left_semi"))
        out = found if out is None else out.unionByName(found)
        if ring >= widest:
            return out
        left = shared_table(left.join(found.select("model_id", "object_id").distinct(), ["model_id", "object_id"], "left_anti"))
        if left.isEmpty():
            return out
        ring *= 2


def within_radius(objects: DataFrame, radius: float, grid: bool = False) -> DataFrame:
    """Other objects up to ``radius`` away, containers left out. All of them: no cap before the filter. ``grid`` meets pairs by cells, for large models."""
    met = close_pairs(objects, radius) if grid else ordered_pairs(objects).where(g.box_distance("a_", "b_") <= radius)
    found = met.where(~g.contains("b_", "a_"))
    return found.select("model_id", F.col("a_object_id").alias("object_id"), F.col("b_object_id").alias("near_id"), g.box_distance("a_", "b_").alias("gap"))


def by_size(objects: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Objects of models of WHOLE objects or fewer, and those of larger models, if there are any. In the former work by pairs is WHOLE times the objects at most, and needs no rows for cells."""
    large = objects.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("model_id")
    if large.isEmpty():
        return objects, None
    return objects.join(large, "model_id", "left_anti"), objects.join(large, "model_id", "left_semi")


def candidates(objects: DataFrame, radius: float | None = None, cell: float = CELL) -> DataFrame:
    """Objects in the cells of each object's box, padded by ``radius`` or one cell; where that is the object alone, all of its model. Cells of small models are compared, only those of large ones are rows; nothing of a small model is dealt out again."""
    pad = cell if radius is None else radius
    ends = lambda p, x, by: (F.floor((F.col(f"{p}{x}0") - by) / cell), F.floor((F.col(f"{p}{x}1") + by) / cell))

    def with_lone(own: DataFrame, near: DataFrame) -> DataFrame:
        pairs_ = near.select("model_id", "a_object_id", "b_object_id").distinct().withColumn("own", F.lit(False))
        every = pairs_.unionByName(own.select("model_id", F.col("object_id").alias("a_object_id"), F.lit(None).cast("string").alias("b_object_id"), F.lit(True).alias("own")))
        counted = every.withColumn("n", F.count_if(~F.col("own")).over(Window.partitionBy("model_id", "a_object_id")))
        lone = counted.where("own and n <= 1").select("model_id", "a_object_id").join(own.select("model_id", F.col("object_id").alias("b_object_id")), "model_id")
        return counted.where("not own and n > 1").select("model_id", "a_object_id", "b_object_id").unionByName(lone)

    small, large = by_size(objects)
    met = side(small, "a_").join(side(small, "b_"), "model_id")
    for x in g.AXES:
        a, b = ends("a_", x, pad), ends("b_", x, 0.0)
        for end in (*a, *b):  # what has no box has no cells
            met = met.where(end.isNotNull())
        met = met.where((F.least(*a) <= F.greatest(*b)) & (F.greatest(*a) >= F.least(*b)))
    found = with_lone(small, met)
    if large is None:
        return found
    cells = grid_cells(side(large, "a_"), "a_", pad, cell).join(grid_cells(side(large, "b_"), "b_", 0.0, cell), ["model_id", "gx", "gy", "gz"])
    return found.unionByName(with_lone(large, cells))


def measure_between(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distance, gap, containment both ways and overlap for pairs ``model_id, a_object_id, b_object_id``."""
    met = wanted.join(side(objects, "a_"), ["model_id", "a_object_id"]).join(side(objects, "b_"), ["model_id", "b_object_id"])
    return met.select("model_id", "a_object_id", "b_object_id", g.distance("a_", "b_").alias("distance"), g.box_distance("a_", "b_").alias("gap"), g.contains("a_", "b_").alias("a_contains_b"), g.contains("b_", "a_").alias("b_contains_a"), g.intersects("a_", "b_").alias("overlap"))


def measure(objects: DataFrame, what: str) -> DataFrame:
    column, unit = {"volume": ("volume_mm3", "mm3"), "surface_area": ("surface_area_mm2", "mm2")}[what]
    return objects.select("model_id", "object_id", F.col(column).alias("value"), F.when(F.col(column).isNotNull(), unit).alias("unit"))


def _reached(planes: Column, cell: float, start: Column, delta: Column) -> Column:
    """Where along a path its coordinate passes the planes with these numbers."""
    return F.transform(planes, lambda k: (k * cell - start) / delta)


def path_cells(paths: DataFrame, cell: float = CELL) -> DataFrame:
    """Every cell that a path ``sx.., ex..`` passes, as ``gx gy gz``: the cells at its ends, where it crosses a plane of the grid, and half-way between. As many as the path is long, whatever else is in the scene."""
    none = F.array().cast("array<double>")
    start, delta = {x: F.col(f"s{x}") for x in g.AXES}, {x: F.col(f"e{x}") - F.col(f"s{x}") for x in g.AXES}
    crossed = [F.array(F.lit(0.0), F.lit(1.0))]
    for x in g.AXES:
        first, last = F.floor(F.least(f"s{x}", f"e{x}") / cell) + 1, F.floor(F.greatest(f"s{x}", f"e{x}") / cell)
        planes = F.sequence(first, F.greatest(first, last))
        crossed.append(F.when((F.abs(delta[x]) >= 1e-12) & (first <= last), _reached(planes, cell, start[x], delta[x])).otherwise(none))
    knots = paths.withColumn("knots", F.array_sort(F.filter(F.array_distinct(F.concat(*crossed)), lambda t: (t >= 0) & (t <= 1))))
    half = F.transform("knots", lambda t, i: (t + F.coalesce(F.get("knots", i + 1), t)) / 2)
    place = lambda t: F.struct(*(F.floor((start[x] + delta[x] * t) / cell).alias(f"g{x}") for x in g.AXES))
    cells = knots.withColumn("cell", F.explode(F.array_distinct(F.transform(F.concat("knots", half), place)))).drop("knots")
    return cells.select("*", "cell.*").drop("cell")


def near_paths(objects: DataFrame, paths: DataFrame, within: float, cell: float) -> DataFrame:
    """Paths with the objects of their model whose boxes, padded by ``within``, share a cell with them: all that are at most so far away, each once."""
    met = path_cells(paths, cell).join(grid_cells(side(objects, "o_"), "o_", within + 1e-6, cell), ["model_id", "gx", "gy", "gz"])
    return met.drop("gx", "gy", "gz").dropDuplicates(["path_id", "model_id", "o_obj_seq"])


def trajectory_hits(objects: DataFrame, paths: DataFrame, grid: bool = False) -> DataFrame:
    """Objects that the segments ``path_id, model_id, sx.., ex..`` hit; with ``grid``, only objects in the cells of a path meet it, for large models."""
    met = near_paths(objects, paths, 0.0, CELL) if grid else paths.join(side(objects, "o_"), "model_id")
    return met.where(g.segment_intersects_box("s", "e", "o_")).select("path_id", "model_id", F.col("o_object_id").alias("object_id"))


def trajectory_clearance(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """The clearance of every path and every object of its model: as many rows."""
    met = paths.join(side(objects, "o_"), "model_id")
    return met.select("path_id", "model_id", F.col("o_object_id").alias("object_id"), g.segment_box_distance("s", "e", "o_").alias("clearance"))


def least_clearance(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """``path_id, model_id, clearance``: of each path the distance to the nearest object that it does not hit, by growing rings: a path is settled once one is found within the ring, and the ring of the rest doubles until it holds the whole scene."""
    keys = ["path_id", "model_id"]
    ends = [objects.select(*(F.col(f"{x}0").alias(f"{x}0") for x in g.AXES), *(F.col(f"{x}1").alias(f"{x}1") for x in g.AXES)), paths.select(*(F.least(f"s{x}", f"e{x}").alias(f"{x}0") for x in g.AXES), *(F.greatest(f"s{x}", f"e{x}").alias(f"{x}1") for x in g.AXES))]
    span = ends[0].unionByName(ends[1]).agg(*(F.max(f"{x}1") - F.min(f"{x}0") for x in g.AXES)).first()
    widest = sum((v or 0.0) ** 2 for v in span) ** 0.5
    ring, left, out = CELL, paths, None
    while True:
        near = near_paths(objects, left, ring, max(CELL, ring)).where(~g.segment_intersects_box("s", "e", "o_"))
        found = near.groupBy(*keys).agg(F.min(g.segment_box_distance("s", "e", "o_")).alias("clearance"))
        if ring < widest:
            found = shared_table(found.where(F.col("clearance") <= ring))
        out = found if out is None else out.unionByName(found)
        if ring >= widest:
            return out
        left = shared_table(left.join(found.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            return out
        ring *= 2


def record_paths(objects: DataFrame, paths: DataFrame, grid: bool = False) -> DataFrame:
    """A row for each path: its length, what it hits in order of the model, and the least clearance of what it does not. With ``grid``, paths of models of more than WHOLE objects meet what is in their cells and around them."""
    if grid:
        small, large = by_size(objects)
        direct = record_paths(small, paths)
        return direct if large is None else direct.unionByName(grid_paths(large, paths))
    met = paths.join(side(objects, "o_"), "model_id")
    met = met.select("path_id", "model_id", g.trajectory_length().alias("length"), g.segment_intersects_box("s", "e", "o_").alias("hit"), g.segment_box_distance("s", "e", "o_").alias("clearance"), "o_obj_seq", "o_object_id")
    hits = F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("o_obj_seq", "o_object_id"))))
    return met.groupBy("path_id", "model_id", "length").agg(F.transform(hits, lambda h: h["o_object_id"]).alias("hits"), F.min(F.when(~F.col("hit"), F.col("clearance"))).alias("clearance"))


def grid_paths(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """``record_paths`` by cells and rings."""
    keys = ["path_id", "model_id"]
    own = shared_table(paths.join(objects.select("model_id").distinct(), "model_id", "left_semi").select(*keys, *(f"{p}{x}" for p in "se" for x in g.AXES)))
    hit = near_paths(objects, own, 0.0, CELL).where(g.segment_intersects_box("s", "e", "o_"))
    hits = hit.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_obj_seq", "o_object_id"))), lambda h: h["o_object_id"]).alias("hits"))
    told = own.select(*keys, g.trajectory_length().alias("length")).join(hits, keys, "left").join(least_clearance(objects, own), keys, "left")
    return told.withColumn("hits", F.coalesce("hits", F.array().cast(told.schema["hits"].dataType)))


def scene_bounds(objects: DataFrame, leave_out: str = "volume") -> DataFrame:
    return objects.where(F.col("obj_type") != leave_out).groupBy("model_id").agg(*(F.min(c).alias(c) for c in BOX if c[1] == "0"), *(F.max(c).alias(c) for c in BOX if c[1] == "1"))


OPERATIONS = {"distance": 2, "surface_distance": 2, "contains": 2, "intersects": 2, "adjacent": 2, "nearest": 1, "within_radius": 1, "volume": 1, "surface_area": 1, "trajectory_clearance": 0, "trajectory_intersections": 0}


def spatial_query(objects: DataFrame, operation: str, queries: DataFrame, **options: float) -> DataFrame:
    """One of OPERATIONS for a table of queries (``model_id, a_object_id[, b_object_id]``, or paths), with the ``method`` that answered."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation}; one of {', '.join(OPERATIONS)}")
    missing = {"model_id", *["a_object_id", "b_object_id"][: OPERATIONS[operation]]} - set(queries.columns)
    if missing:
        raise ValueError(f"{operation} needs {', '.join(sorted(missing))}")
    if operation == "trajectory_clearance":
        out = trajectory_clearance(objects, queries)
    elif operation == "trajectory_intersections":
        out = trajectory_hits(objects, queries)
    elif OPERATIONS[operation] == 2:
        value = {"distance": g.distance("a_", "b_"), "surface_distance": g.box_distance("a_", "b_"), "contains": g.contains("a_", "b_"), "intersects": g.intersects("a_", "b_"), "adjacent": g.adjacent("a_", "b_", options.get("tolerance", 1.0))}[operation]
        met = queries.join(side(objects, "a_"), ["model_id", "a_object_id"]).join(side(objects, "b_"), ["model_id", "b_object_id"])
        out = met.select("model_id", "a_object_id", "b_object_id", value.alias("value"))
    else:
        asked = queries.select("model_id", F.col("a_object_id").alias("object_id"))
        found = {"nearest": lambda: nearest(objects, int(options.get("k", 5))), "within_radius": lambda: within_radius(objects, options.get("radius", NEAR_MM))}.get(operation, lambda: measure(objects, operation))()
        out = found.join(asked, ["model_id", "object_id"], "left_semi")
    return out.withColumn("method", F.lit("axis-aligned boxes" if operation != "distance" else "centroids"))
