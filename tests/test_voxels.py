"""Volumes of a cohort: components, steps of growth, planes and grids against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import voxels
from cohortspark.plans import all_queries

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def moved(p, s):
    return tuple(a + b for a, b in zip(p, s, strict=True))


def plain_components(cells: set[tuple]) -> dict[tuple, tuple]:
    out: dict[tuple, tuple] = {}
    for start in sorted(cells):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            p = todo.pop()
            for q in (moved(p, s) for s in STEPS):
                if q in cells and q not in out:
                    out[q] = start
                    todo.append(q)
    return out


def table(spark, volumes: dict[str, set[tuple]]):
    rows = [(s, *p, 1.5) for s, cells in volumes.items() for p in cells]
    return spark.createDataFrame(rows, "series string, frame int, y int, x int, v double")


def found(df) -> dict:
    return {(r["series"], r["frame"], r["y"], r["x"]): tuple(r["component"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [3, 4, 64])
def test_components_of_many_volumes(spark, tile):
    rnd = random.Random(tile)
    volumes = {f"s{k}": {tuple(rnd.randrange(n) for n in (6, 9, 11)) for _ in range(30 * k)} for k in range(1, 9)}
    want = {(s, *p): c for s, cells in volumes.items() for p, c in plain_components(cells).items()}
    assert found(voxels.voxel_components(table(spark, volumes), tile)) == want


@pytest.mark.parametrize("whole", [0, 60, 1_000_000])
def test_components_of_whole_series_and_of_tiles_agree(spark, whole):
    rnd = random.Random(whole)
    volumes = {f"s{k}": {tuple(rnd.randrange(-3, n) for n in (6, 9, 11)) for _ in range(30 * k)} for k in range(1, 9)} | {"far": {(-(2**31), 0, -(2**31)), (2**31 - 1, 2**31 - 1, 0), (2**31 - 1, 2**31 - 1, 1)}}
    want = {(s, *p): c for s, cells in volumes.items() for p, c in plain_components(cells).items()}
    assert found(voxels.voxel_components(table(spark, volumes).repartition(3), 4, whole)) == want


def test_volumes_are_dealt_once(spark):
    for name in ("v06_frame_threshold", "v18_dilate_erode"):
        plan = all_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


@pytest.mark.parametrize("largest", [1, 1_000_000])
def test_closing_in_arrays_and_by_joins(spark, monkeypatch, largest):
    monkeypatch.setattr(voxels, "TASK_VOXELS", largest)
    monkeypatch.setattr(voxels, "BATCH_PLACES", 800)
    rnd, shape = random.Random(3), (9, 7, 6)
    rows = [(s, *(rnd.randrange(n) for n in shape)) for s in range(40) for _ in range(rnd.randrange(1, 30))] + [(0, 9, 3, 3), (1, -1, 2, 2)]
    df = spark.createDataFrame(rows, "series int, x int, y int, z int").where("x between 0 and 8").repartition(3)
    grown = voxels.dilate(df, shape, 2)
    want = [("dilated", *r) for r in grown.select("series", "x", "y", "z").collect()] + [("eroded", *r) for r in voxels.erode(grown, 2).collect()]
    assert sorted(map(tuple, voxels.closing(df, shape, 2).select("step", "series", "x", "y", "z").collect())) == sorted(want)


def test_components_of_a_line_over_many_tiles(spark):
    """One long snake, with numbers beyond four digits and below 0, and a repeated voxel."""
    snake = {(12_345, 9_999, x) for x in range(-40, 12_050)} | {(12_346, 9_999, 12_049)}
    df = table(spark, {"a": snake, "b": {(12_345, 9_999, 5)}})
    got = found(voxels.voxel_components(df.unionByName(df.limit(1))))
    assert len(got) == len(snake) + 1
    assert set(c for k, c in got.items() if k[0] == "a") == {(12_345, 9_999, -40)}
    assert got["b", 12_345, 9_999, 5] == (12_345, 9_999, 5)


def test_top_components_and_regions_by_series(spark):
    volumes = {"a": {(1, 0, x) for x in (*range(4), *range(10, 13), *range(20, 22))}, "b": {(1, 5, x) for x in range(3)} | {(2, 5, 0)}}
    c = voxels.voxel_components(table(spark, volumes))
    top = sorted((r["series"], r["rank"], r["n"], tuple(r["component"])) for r in voxels.top_components(c, min_size=3, k=1).collect())
    assert top == [("a", 1, 4, (1, 0, 0)), ("b", 1, 4, (1, 5, 0))]
    geometry = spark.createDataFrame([("a", 0.5, 1.0, 3.0), ("b", 1.0, 2.0, 2.0)], "series string, sx double, sy double, sz double")
    box = {(r["series"], tuple(r["component"])): r for r in voxels.region_objects(c, geometry, min_size=3).collect()}
    assert len(box) == 3
    a, b = box["a", (1, 0, 0)], box["b", (1, 5, 0)]
    assert (a["x0"], a["x1"], a["z0"], a["z1"], a["volume"]) == (0.0, 1.5, 3.0, 6.0, 6.0)
    assert (b["y0"], b["z0"], b["z1"], b["volume"]) == (10.0, 2.0, 4.0, 16.0)


@pytest.mark.parametrize("times", [1, 2, 5])
def test_steps_of_growth_and_loss(spark, times):
    rnd, shape = random.Random(times), (9, 7, 6)
    full = {(x, y, z) for x in range(9) for y in range(7) for z in range(6)}
    volumes = {1: {tuple(rnd.randrange(n) for n in shape) for _ in range(12)}, 2: full - {(4, 3, 3)}, 3: full | {(9, 3, 3), (-1, 2, 2)}, 4: full - {tuple(rnd.randrange(n) for n in shape) for _ in range(4)}}
    df = spark.createDataFrame([(s, *p) for s, cells in volumes.items() for p in cells], "series int, x int, y int, z int")
    grown, left = {}, {}
    for s, cells in volumes.items():
        grown[s] = cells & full
        left[s] = cells
        for _ in range(times):
            grown[s] = {q for p in grown[s] for q in (p, *(moved(p, t) for t in STEPS)) if q in full}
            left[s] = {p for p in left[s] if all(moved(p, t) in left[s] for t in STEPS)}
    rows = lambda by: sorted((s, *p) for s, cells in by.items() for p in cells)
    inside = df.where("x between 0 and 8")
    assert sorted(map(tuple, voxels.dilate(inside, shape, times).select("series", "x", "y", "z").collect())) == rows(grown)
    assert sorted(map(tuple, voxels.erode(df, times).collect())) == rows(left)


def test_planes_have_the_middle_of_each_series(spark):
    rows = [("a", f, y, x, float(100 * f + 10 * y + x)) for f in (7, 9, 30) for y in range(3) for x in range(2)] + [("b", 1, 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "series string, frame int, y int, x int, v double")
    axial = sorted(map(tuple, voxels.plane_slice(df, "axial").collect()))
    assert axial == sorted([("a", y, x, float(900 + 10 * y + x)) for y in range(3) for x in range(2)] + [("b", 0, 0, 5.0)])
    coronal = {(r["row"], r["column"]): r["v"] for r in voxels.plane_slice(df, "coronal", 1).where("series = 'a'").collect()}
    assert coronal == {(2 - z, x): float(100 * f + 10 + x) for z, f in enumerate((7, 9, 30)) for x in range(2)}
    far = voxels.plane_slice(df, "sagittal", 99).collect()
    assert {r["series"] for r in far} == {"a", "b"} and len(far) == 10


def test_dated_frames_become_places(spark):
    df = spark.createDataFrame([("a", d, 0, 0, 1.0) for d in ("2024-01-05", "2024-03-01", "2024-02-01")], "series string, frame string, y int, x int, v double")
    dated = voxels.frame_places(df.withColumn("day", F.col("frame")).withColumn("frame", F.to_date("frame")))
    assert {r["day"]: r["frame"] for r in dated.collect()} == {"2024-01-05": 0, "2024-02-01": 1, "2024-03-01": 2}


def test_grids_differ_by_series(spark):
    labels = spark.createDataFrame([(s, x, 0, 0, x + 1) for s in (1, 2) for x in range(4)], "series int, x int, y int, z int, label int")
    targets = spark.createDataFrame([(s, x, 0, 0, float(x), 0.0, 0.0) for s in (1, 2, 3) for x in range(8)], "series int, tx int, ty int, tz int, mx double, my double, mz double")
    axis = lambda x, size, start, step, last: {f"size_{x}": size, f"start_{x}": start, f"step_{x}": step, f"first_{x}": 0.0, f"last_{x}": last}
    flat = axis("y", 1, 0.0, 1.0, 0.0) | axis("z", 1, 0.0, 1.0, 0.0)
    grids = spark.createDataFrame([{"series": 1, "scale": 1.0} | axis("x", 4, 0.0, 1.0, 3.0) | flat, {"series": 2, "scale": 2.0} | axis("x", 4, 10.0, 1.0, 7.0) | flat])
    got = {(r["series"], r["tx"]): r["label"] for r in voxels.resample_labels(labels, targets, grids).collect()}
    assert [got[1, x] for x in range(8)] == [1, 2, 3, 4, 0, 0, 0, 0]
    assert [got[2, x] for x in range(8)] == [1, 1, 2, 2, 3, 3, 4, 4]  # halves go to the even one
    assert [got[3, x] for x in range(8)] == [0] * 8
