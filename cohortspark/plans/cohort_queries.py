"""Queries on headers, voxels, features, ledgers and experiments (I, V, F, A, X), with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.operators import experiments, features, ingest, ledger, tables, voxels
from cohortspark.operators import temporal as tm
from cohortspark.plans.fixtures import INSTANCES_SQL, OBJECTS_SQL, OUTCOMES_SQL, SHAPE, VOXELS_SQL, instances, objects, outcomes, table
from cohortspark.plans.fixtures import voxels as voxel_rows
from cohortspark.plans.registry import query

I, V, O, X = (f"WITH {s}" for s in (INSTANCES_SQL, VOXELS_SQL, OBJECTS_SQL, OUTCOMES_SQL))  # noqa: E741
SEG = "modality <> 'SEG'"


@query("i01_i04_studies", f"{I} SELECT study_uid, count(DISTINCT series_uid) AS series_count, count(*) AS image_count, coalesce(arg_min(modality, path) FILTER (WHERE {SEG}), arg_min(modality, path)) AS modality, min(path) AS first_path FROM inst GROUP BY study_uid")
def i01(spark: SparkSession, d: str) -> DataFrame:
    return ingest.index_studies(instances(spark, d))


@query("i02_series", f"{I} SELECT study_uid, series_uid, count(*) AS instance_count, min(z) AS z_min, max(z) AS z_max FROM inst GROUP BY ALL")
def i02(spark: SparkSession, d: str) -> DataFrame:
    return ingest.index_series(instances(spark, d)).drop("modality", "thickness")


@query("i03_instance_order", f"{I} SELECT series_uid, sop_uid, path, CAST(row_number() OVER (PARTITION BY series_uid ORDER BY z, instance_number, path) AS INTEGER) AS place FROM inst")
def i03(spark: SparkSession, d: str) -> DataFrame:
    return ingest.instance_order(instances(spark, d))


@query("i05_primary_series", f"{I}, s AS (SELECT study_uid, series_uid, arg_min(modality, (z, instance_number, path)) AS modality, count(*) AS instance_count FROM inst GROUP BY ALL) SELECT study_uid, series_uid, instance_count FROM (SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY instance_count DESC, series_uid) AS n FROM s WHERE modality NOT IN ('SEG', 'SR')) WHERE n = 1")
def i05(spark: SparkSession, d: str) -> DataFrame:
    return ingest.primary_series(ingest.index_series(instances(spark, d)))


@query("i06_without_derived", f"{I} SELECT study_uid, series_uid, count(*) AS instance_count FROM inst WHERE NOT starts_with(path, 'derived/') GROUP BY ALL")
def i06(spark: SparkSession, d: str) -> DataFrame:
    return ingest.drop_derived(instances(spark, d))


@query("i07_pending_imports", "SELECT o_orderkey AS study_uid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def i07(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pending_imports(table(spark, d, "orders").select(F.col("o_orderkey").alias("study_uid")), instances(spark, d))


@query("i08_first_arrivals", f"{I} SELECT study_uid, sop_uid, path, price FROM (SELECT *, row_number() OVER (PARTITION BY study_uid, sop_uid ORDER BY arrived_at, path, price) AS n FROM inst) WHERE n = 1")
def i08(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedupe_instances(instances(spark, d)).select("study_uid", "sop_uid", "path", "price")


@query("i09_catalog", f"{I} SELECT study_uid, series_uid, min(path) AS path, count(*) AS n FROM inst GROUP BY ALL")
def i09(spark: SparkSession, d: str) -> DataFrame:
    return ingest.list_catalog(instances(spark, d), "series").drop("modality")


@query("v01_rescaled", f"{V} SELECT series, frame, y, x, v * coalesce(nullif(CAST(x % 3 AS DOUBLE), 0), 1) + coalesce(CASE WHEN y % 2 = 0 THEN -10.0::DOUBLE END, 0) AS value FROM vx")
def v01(spark: SparkSession, d: str) -> DataFrame:
    slope, intercept = (F.col("x") % 3).cast("double"), F.when(F.col("y") % 2 == 0, -10.0)
    return voxel_rows(spark, d).withColumn("value", voxels.rescale(F.col("v"), slope, intercept)).drop("v")


@query("v02_frame_stats", f"{V} SELECT series, frame, floor(min(v)) AS v_min, floor(max(v)) AS v_max, round(avg(floor(v)), 6) AS v_mean, max(y)+1 AS rows, max(x)+1 AS columns, count(*) AS n FROM vx GROUP BY series, frame")
def v02(spark: SparkSession, d: str) -> DataFrame:
    return voxels.frame_stats(voxel_rows(spark, d).withColumn("v", F.floor("v").cast("double"))).withColumn("v_mean", F.round("v_mean", 6))


@query("v03_window_level", f"{V} SELECT series, frame, y, x, CAST(CASE WHEN hi > lo THEN floor(greatest(0.0, least(255.0, (v-lo)*255/(hi-lo)))) ELSE 0 END AS INTEGER) AS level FROM (SELECT *, min(v) OVER (PARTITION BY series, frame) AS lo, max(v) OVER (PARTITION BY series, frame) AS hi FROM vx)")
def v03(spark: SparkSession, d: str) -> DataFrame:
    return voxels.plane_levels(voxel_rows(spark, d))


@query("v04_coronal_slice", f"{V}, z AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY frame) - 1 AS z FROM vx), t AS (SELECT series, max(y) AS last, max(z) AS top FROM z GROUP BY series) SELECT series, CAST(top - z AS INTEGER) AS row, x AS \"column\", v FROM z JOIN t USING (series) WHERE y = greatest(0, least((last + 1)//2, last))")
def v04(spark: SparkSession, d: str) -> DataFrame:
    return voxels.plane_slice(voxel_rows(spark, d), "coronal")


@query("v05_manifest", f"{V}, f AS (SELECT series, frame, max(y)+1 AS rows, max(x)+1 AS columns FROM vx GROUP BY ALL) SELECT series, count(*) AS frame_count, max(rows) AS rows, max(columns) AS columns, count(DISTINCT (rows, columns)) = 1 AS renderable FROM f GROUP BY series")
def v05(spark: SparkSession, d: str) -> DataFrame:
    return voxels.volume_manifest(voxel_rows(spark, d))


_HITS = "t AS (SELECT series, frame, quantile_cont(v, 0.5) AS lim FROM vx GROUP BY ALL), hit AS (SELECT * EXCLUDE (hits) FROM (SELECT vx.*, count(*) OVER (PARTITION BY vx.series, vx.frame) AS hits FROM vx JOIN t ON vx.series = t.series AND vx.frame = t.frame WHERE v >= lim) WHERE hits >= 2)"
HITS = f"{V}, {_HITS}"


@query("v06_frame_threshold", f"{HITS} SELECT series, frame, y, x, v FROM hit")
def v06(spark: SparkSession, d: str) -> DataFrame:
    return voxels.frame_threshold(voxel_rows(spark, d), 0.5)


@query("v07_stride_sample", f"{V} SELECT series, frame, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY series, frame ORDER BY y, x) - 1 AS r, count(*) OVER (PARTITION BY series, frame) AS n FROM vx) WHERE r % greatest(1, n//3) = 0")
def v07(spark: SparkSession, d: str) -> DataFrame:
    return voxels.stride_sample(voxel_rows(spark, d), cap=3)


COMPONENTS = f"""WITH RECURSIVE {VOXELS_SQL}, {_HITS},
e AS (SELECT a.series, (a.frame, a.y, a.x) AS a, (b.frame, b.y, b.x) AS b FROM hit a JOIN hit b ON a.series = b.series AND abs(a.frame - b.frame) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT series, (frame, y, x) AS id, (frame, y, x) AS reach FROM hit UNION SELECT r.series, r.id, e.b FROM r JOIN e ON r.series = e.series AND r.reach = e.a),
comp AS (SELECT series, id, min(reach) AS component FROM r GROUP BY series, id),
lab AS (SELECT hit.*, concat(component[1], '|', component[2], '|', component[3]) AS component, component AS first FROM hit JOIN comp ON hit.series = comp.series AND (hit.frame, hit.y, hit.x) = comp.id)"""


def components(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a few voxels, so that what is found crosses their seams."""
    return voxels.voxel_components(voxels.frame_threshold(voxel_rows(spark, d), 0.5), tile=4)


def shown_component(df: DataFrame) -> DataFrame:
    return df.withColumn("component", F.concat_ws("|", "component.frame", "component.y", "component.x"))


@query("v08_components", f"{COMPONENTS} SELECT series, frame, y, x, v, component FROM lab")
def v08(spark: SparkSession, d: str) -> DataFrame:
    return shown_component(components(spark, d))


@query("v09_top_components", f"{COMPONENTS} SELECT series, component, n, CAST(rank AS INTEGER) AS rank FROM (SELECT series, component, count(*) AS n, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, first) AS rank FROM lab GROUP BY series, component, first HAVING count(*) >= 3) WHERE rank <= 2")
def v09(spark: SparkSession, d: str) -> DataFrame:
    return shown_component(voxels.top_components(components(spark, d), k=2))


@query("v11_region_objects", f"{COMPONENTS}, p AS (SELECT series, component, x * 0.5::DOUBLE AS px, y * (1.0::DOUBLE + series % 2) AS py, frame * 2.5::DOUBLE AS pz FROM lab) SELECT series, component, count(*) AS voxels, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, min(pz) AS z0, CASE WHEN max(pz) = min(pz) THEN min(pz) + 2.5::DOUBLE ELSE max(pz) END AS z1, count(*) * 0.5::DOUBLE * (1.0::DOUBLE + series % 2) * 2.5::DOUBLE AS volume FROM p GROUP BY series, component HAVING count(*) >= 2")
def v11(spark: SparkSession, d: str) -> DataFrame:
    geometry = table(spark, d, "orders").select(F.col("o_orderkey").alias("series"), F.lit(0.5).alias("sx"), (F.lit(1.0) + F.col("o_orderkey") % 2).alias("sy"), F.lit(2.5).alias("sz"))
    return shown_component(voxels.region_objects(components(spark, d), geometry, min_size=2))


@query("v12_v13_labelmap_objects", f"{V} SELECT series, x % 5 AS segment, count(*) AS voxel_count, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CASE x % 5 WHEN 1 THEN 'Lung nodule' WHEN 2 THEN 'Heart' ELSE 'Segment ' || (x % 5) END AS label, count(*) * 2.0::DOUBLE AS volume, CASE WHEN x % 5 = 1 THEN 'finding' ELSE 'anatomy' END AS obj_type FROM vx GROUP BY series, x % 5")
def v12(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(1, "Lung nodule"), (2, "Heart")], "segment int, label string")
    return voxels.labelmap_objects(voxel_rows(spark, d).select("series", (F.col("x") % 5).alias("segment"), "x", "y"), names)


GEOMETRY = {"ox": 5.0, "oy": -3.0, "rx": 0.6, "ry": 0.8, "rz": 0.0, "ux": -0.8, "uy": 0.6, "uz": 0.0, "sx": 0.5, "sy": 0.75}


@query(
    "v10_patient_points",
    f"{V} SELECT series, frame, y, x, round(CASE WHEN (series + frame) % 5 = 0 THEN x ELSE 5 + 0.6::DOUBLE * x * 0.75::DOUBLE - 0.8::DOUBLE * y * 0.5::DOUBLE END, 9) AS px, round(CASE WHEN (series + frame) % 5 = 0 THEN y ELSE -3 + 0.8::DOUBLE * x * 0.75::DOUBLE + 0.6::DOUBLE * y * 0.5::DOUBLE END, 9) AS py, CASE WHEN (series + frame) % 5 = 0 THEN 0.0::DOUBLE ELSE (series % 100) + frame * 2.0::DOUBLE END AS pz FROM vx",
)
def v10(spark: SparkSession, d: str) -> DataFrame:
    v = voxel_rows(spark, d)
    frames = v.select("series", "frame").distinct().where((F.col("series") + F.col("frame")) % 5 != 0)
    known = frames.select("series", "frame", *(F.lit(n).alias(k) for k, n in GEOMETRY.items()), (F.col("series") % 100 + F.col("frame") * 2.0).alias("oz"))
    found = voxels.voxel_to_patient(v, known)
    return found.select("series", "frame", "y", "x", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"), "pz")


@query(
    "v14_series_volumes",
    f"{I}, c AS (SELECT study_uid, series_uid, modality, path, z, k.px, k.py FROM inst, (VALUES (0.0, 0.0), (3.0, 0.0), (0.0, 4.0), (3.0, 4.0)) k(px, py)), b AS (SELECT study_uid, series_uid, count(DISTINCT path) AS instance_count, CAST(min(px) AS DOUBLE) AS x0, CAST(max(px) AS DOUBLE) AS x1, CAST(min(py) AS DOUBLE) AS y0, CAST(max(py) AS DOUBLE) AS y1, min(z) AS z0, max(z) AS z1 FROM c WHERE modality <> 'SEG' GROUP BY ALL) SELECT *, 'volume' AS obj_type, 12.0::DOUBLE * (z1 - z0) AS volume_mm3, 2 * (12.0::DOUBLE + 3 * (z1 - z0) + 4 * (z1 - z0)) AS surface_area_mm2 FROM b",
)
def v14(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d).select("study_uid", "series_uid", "modality", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.col("z").alias("oz"), F.lit(8).alias("rows"), F.lit(4).alias("columns"), F.lit(0.5).alias("sx"), F.lit(0.75).alias("sy"))
    return voxels.series_volume_objects(i.where(SEG), ["study_uid", "series_uid"]).drop("cx", "cy", "cz")


#: Source grid (size, first place, step) and target grid (first and last place) of each axis, in mm; a series has its own steps and scale by its number.
AXES = {"x": (17, -8.0, 1.0, 0.0, 32.0), "y": (6, -6.0, 1.0, 0.0, 10.0), "z": (8, 0.0, 2.0, 0.0, 14.0)}
_STEP, _SCALE = "(1 + series % 3 * 0.5::DOUBLE)", "(CASE WHEN series % 7 = 0 THEN NULL ELSE 1.2::DOUBLE + series % 2 * 0.4::DOUBLE END)"
_SOURCE = {x: f"CAST(round_even(({a} + ({n} - 1) * {s} * {_STEP} / 2 + (t{x} * 2.0::DOUBLE - {(lo + hi) / 2}) / {_SCALE} - ({a})) / ({s} * {_STEP}), 0) AS INTEGER)" for x, (n, a, s, lo, hi) in AXES.items()}


@query(
    "v19_resampled_labels",
    f"{V}, g AS (SELECT series, x, y, frame AS z, CAST(max(floor(v / 5)) AS INTEGER) AS label FROM vx GROUP BY ALL), t AS (SELECT DISTINCT series, x AS tx, y AS ty, frame AS tz FROM vx), s AS (SELECT *, {', '.join(f'{e} AS s{x}' for x, e in _SOURCE.items())} FROM t) SELECT t.series, tx, ty, tz, coalesce(g.label, 0) AS label FROM s t LEFT JOIN g ON g.series = t.series AND g.x = sx AND g.y = sy AND g.z = sz",
)
def v19(spark: SparkSession, d: str) -> DataFrame:
    v = voxel_rows(spark, d).withColumnRenamed("frame", "z")
    labels = v.groupBy("series", "x", "y", "z").agg(F.max(F.floor(F.col("v") / 5)).cast("int").alias("label"))
    targets = v.select("series", *(F.col(x).alias(f"t{x}") for x in "xyz"), *((F.col(x) * 2.0).alias(f"m{x}") for x in "xyz")).distinct()
    step = 1 + F.col("series") % 3 * 0.5
    axes = [c for x, (n, a, s, lo, hi) in AXES.items() for c in (F.lit(n).alias(f"size_{x}"), F.lit(a).alias(f"start_{x}"), (F.lit(s) * step).alias(f"step_{x}"), F.lit(lo).alias(f"first_{x}"), F.lit(hi).alias(f"last_{x}"))]
    series = table(spark, d, "orders").select(F.col("o_orderkey").alias("series")).where("series % 7 <> 0")
    grids = series.select("series", (F.lit(1.2) + F.col("series") % 2 * 0.4).alias("scale"), *axes)
    return voxels.resample_labels(labels, targets, grids)


GROUPED = f"{V}, g AS (SELECT series, x, y, frame AS z FROM vx WHERE v > 90)"


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return voxel_rows(spark, d).where("v > 90").select("series", "x", "y", F.col("frame").alias("z"))


@query("v15_exposed_surface", f'{GROUPED}, s AS (SELECT series, x+dx AS x, y+dy AS y, z+dz AS z, area FROM g, (VALUES (1,0,0,2.0),(-1,0,0,2.0),(0,1,0,2.0),(0,-1,0,2.0),(0,0,1,1.0),(0,0,-1,1.0)) d(dx,dy,dz,area)) SELECT series AS "group", count(*) AS faces, CAST(sum(area) AS DOUBLE) AS area FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.series=s.series AND g.x=s.x AND g.y=s.y AND g.z=s.z) GROUP BY series')
def v15(spark: SparkSession, d: str) -> DataFrame:
    return voxels.exposed_surface(grouped(spark, d).withColumnRenamed("series", "group"))


_BALL = "b AS (SELECT x AS dx, y AS dy, z AS dz FROM range(-2, 3) a(x), range(-2, 3) b(y), range(-2, 3) c(z) WHERE abs(x) + abs(y) + abs(z) <= 2)"


@query("v18_dilate_erode", f"{GROUPED}, {_BALL}, d AS (SELECT DISTINCT series, x+dx AS x, y+dy AS y, z+dz AS z FROM g, b WHERE x+dx BETWEEN 0 AND 16 AND y+dy BETWEEN 0 AND 5 AND z+dz BETWEEN 0 AND 7), e AS (SELECT d.series, d.x, d.y, d.z FROM d JOIN b ON true JOIN d n ON n.series = d.series AND n.x = d.x+dx AND n.y = d.y+dy AND n.z = d.z+dz GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM b)) SELECT 'dilated' AS step, series, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM d UNION ALL SELECT 'eroded', series, CAST(x AS INTEGER), CAST(y AS INTEGER), CAST(z AS INTEGER) FROM e")
def v18(spark: SparkSession, d: str) -> DataFrame:
    return voxels.closing(grouped(spark, d), SHAPE, 2)


TRIANGLES = "WITH v AS (SELECT vec_id % 7 AS mesh, vec_id AS vertex, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), f AS (SELECT a.mesh, a.vertex AS a, a.vertex+7 AS b, a.vertex+14 AS c FROM v a)"


def mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    v = e.select((F.col("vec_id") % 7).alias("mesh"), F.col("vec_id").alias("vertex"), *(F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate("xyz")))
    return v, v.select("mesh", F.col("vertex").alias("a"), (F.col("vertex") + 7).alias("b"), (F.col("vertex") + 14).alias("c"))


@query("v20_triangle_area", f"{TRIANGLES}, t AS (SELECT f.mesh, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz FROM f JOIN v a ON a.mesh=f.mesh AND a.vertex=f.a JOIN v b ON b.mesh=f.mesh AND b.vertex=f.b JOIN v c ON c.mesh=f.mesh AND c.vertex=f.c) SELECT mesh, round(sum(sqrt(pow(uy*wz-uz*wy,2)+pow(uz*wx-ux*wz,2)+pow(ux*wy-uy*wx,2))/2), 6) AS area FROM t GROUP BY mesh")
def v20(spark: SparkSession, d: str) -> DataFrame:
    return voxels.triangle_area(*mesh(spark, d)).withColumn("area", F.round("area", 6))


@query("v17_decimated_faces", f"{TRIANGLES}, w AS (SELECT mesh, vertex, concat(CAST(floor(x/0.2) AS BIGINT), '|', CAST(floor(y/0.2) AS BIGINT), '|', CAST(floor(z/0.2) AS BIGINT)) AS cell FROM v), j AS (SELECT f.mesh, a.cell AS ca, b.cell AS cb, c.cell AS cc FROM f JOIN w a ON a.mesh=f.mesh AND a.vertex=f.a JOIN w b ON b.mesh=f.mesh AND b.vertex=f.b JOIN w c ON c.mesh=f.mesh AND c.vertex=f.c) SELECT DISTINCT mesh, array_to_string(list_sort([ca, cb, cc]), ',') AS cells FROM j WHERE ca <> cb AND cb <> cc AND ca <> cc")
def v17(spark: SparkSession, d: str) -> DataFrame:
    _, faces = voxels.grid_decimate(*mesh(spark, d), 0.2)
    return faces.select("mesh", F.array_join("cells", ",").alias("cells"))


@query("v21_nearest_slice", f"{O}, i AS (SELECT DISTINCT l_orderkey AS model_id, l_linenumber * 20.0::DOUBLE AS z FROM lineitem WHERE l_linestatus = 'F') SELECT o.model_id, object_id, arg_min(z, (abs(z-cz), z)) AS slice_z FROM o JOIN i ON o.model_id=i.model_id GROUP BY ALL")
def v21(spark: SparkSession, d: str) -> DataFrame:
    return voxels.nearest_slice(objects(spark, d), instances(spark, d).where("path like 'derived/%'"))


FEATURES_SQL = f"{O}, f AS (SELECT model_id, CAST(count(*) AS DOUBLE) AS object_count, CAST(count(*) FILTER (WHERE obj_type='anatomy') AS DOUBLE) AS anatomy_count, CAST(count(*) FILTER (WHERE obj_type IN ('finding','lesion')) AS DOUBLE) AS finding_count, CAST(count(*) FILTER (WHERE obj_type='region') AS DOUBLE) AS region_count, CAST(count(*) FILTER (WHERE review_status='confirmed') AS DOUBLE) AS confirmed_count, sum(volume_mm3) AS total_volume, max(volume_mm3) AS largest_volume, coalesce(sum(volume_mm3) FILTER (WHERE obj_type='finding'), 0) AS finding_volume FROM o GROUP BY model_id)"
ROUNDED = "total_volume", "finding_volume"


def featured(spark: SparkSession, d: str) -> DataFrame:
    return features.extract_features(objects(spark, d))


@query("f01_features", f"{FEATURES_SQL} SELECT * REPLACE (round(total_volume, 4) AS total_volume, round(finding_volume, 4) AS finding_volume) FROM f")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return featured(spark, d).withColumns({c: F.round(c, 4) for c in ROUNDED})


LABELLED_SQL = f"{FEATURES_SQL}, lb AS (SELECT o_orderkey AS model_id, o_orderstatus AS status FROM orders)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("model_id"), F.when(F.col("o_orderstatus") == "F", " YES").when(F.col("o_orderstatus") == "O", "0").otherwise("maybe").alias("label"))


@query("f02_f03_dataset", f"{LABELLED_SQL} SELECT f.model_id, object_count, finding_count, CASE status WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM f JOIN lb USING (model_id) WHERE status IN ('F', 'O')")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return features.build_dataset(featured(spark, d), labelled(spark, d))[0].select("model_id", "object_count", "finding_count", "y")


@query("f02_rejects", f"{LABELLED_SQL} SELECT lb.model_id, CASE status WHEN 'F' THEN ' YES' WHEN 'O' THEN '0' ELSE 'maybe' END AS label, CASE WHEN f.model_id IS NULL THEN 'unknown model' ELSE 'unreadable' END AS reason FROM lb LEFT JOIN f USING (model_id) WHERE f.model_id IS NULL OR status NOT IN ('F', 'O')")
def f02b(spark: SparkSession, d: str) -> DataFrame:
    return features.build_dataset(featured(spark, d), labelled(spark, d))[1]


@query("f05_summary", f"{FEATURES_SQL}, u AS (UNPIVOT f ON COLUMNS(* EXCLUDE (model_id)) INTO NAME feature VALUE value) SELECT feature, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, round(min(value), 4) AS least, round(max(value), 4) AS largest, count(*) FILTER (WHERE abs(value) <= 1e-8) AS zeros FROM u GROUP BY feature")
def f05(spark: SparkSession, d: str) -> DataFrame:
    s = features.summarize(featured(spark, d))
    return s.select("feature", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), F.round("least", 4).alias("least"), F.round("largest", 4).alias("largest"), "zeros")


@query("f06_drift", f"{FEATURES_SQL}, u AS (UNPIVOT f ON COLUMNS(* EXCLUDE (model_id)) INTO NAME feature VALUE value), s AS (SELECT feature, model_id % 2 AS half, avg(value) AS mean, stddev_pop(value) AS std FROM u GROUP BY ALL) SELECT a.feature, round((a.mean-b.mean)/sqrt((a.std*a.std+b.std*b.std)/2), 6) AS smd, abs((a.mean-b.mean)/sqrt((a.std*a.std+b.std*b.std)/2)) >= 0.5 AS flagged FROM s a JOIN s b ON a.feature=b.feature AND a.half=0 AND b.half=1")
def f06(spark: SparkSession, d: str) -> DataFrame:
    f = featured(spark, d)
    return features.feature_drift(features.summarize(f.where("model_id % 2 = 0")), features.summarize(f.where("model_id % 2 = 1"))).withColumn("smd", F.round("smd", 6))


@query("f10_standardized", f"{FEATURES_SQL} SELECT model_id, round((object_count - avg(object_count) OVER ())/stddev_pop(object_count) OVER (), 6) AS object_count, round((largest_volume - avg(largest_volume) OVER ())/stddev_pop(largest_volume) OVER (), 6) AS largest_volume FROM f")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return features.standardize(featured(spark, d)).select("model_id", F.round("object_count", 6).alias("object_count"), F.round("largest_volume", 6).alias("largest_volume"))


@query("f07_holdout", f"{FEATURES_SQL} SELECT model_id, row_number() OVER (ORDER BY model_id) > count(*) OVER () - count(*) OVER () // 5 AS holdout FROM f")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return features.holdout_split(featured(spark, d)).select("model_id", "holdout")


@query("f15_folds", f"{LABELLED_SQL} SELECT model_id, CAST((row_number() OVER (PARTITION BY status ORDER BY model_id) - 1) % 5 AS INTEGER) AS fold FROM f JOIN lb USING (model_id) WHERE status IN ('F', 'O')")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return features.fold_numbers(features.build_dataset(featured(spark, d), labelled(spark, d))[0], 5).select("model_id", "fold")


SCORED = f"{LABELLED_SQL}, sc AS (SELECT CASE status WHEN 'F' THEN 1 ELSE 0 END AS y, CASE WHEN 1/(1+exp(-(0.5*finding_count - 0.25*object_count + 0.1))) >= 0.5 THEN 1 ELSE 0 END AS p, 0.5*finding_count - 0.25*object_count + 0.1 AS raw FROM f JOIN lb USING (model_id) WHERE status IN ('F','O')), c AS (SELECT count(*) FILTER (WHERE y=1 AND p=1) AS tp, count(*) FILTER (WHERE y=0 AND p=0) AS tn, count(*) FILTER (WHERE y=0 AND p=1) AS fp, count(*) FILTER (WHERE y=1 AND p=0) AS fn FROM sc)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    data = features.build_dataset(featured(spark, d), labelled(spark, d))[0]
    return features.predict_linear(data, {"finding_count": 0.5, "object_count": -0.25}, 0.1).join(data.select("model_id", "y"), "model_id")


@query("f08_f20_f23_classification", f"{SCORED} SELECT *, (tp+tn)/greatest(tp+tn+fp+fn,1) AS accuracy, tp/greatest(tp+fp,1) AS precision, tp/greatest(tp+fn,1) AS recall FROM c")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return features.classification_metrics(scored(spark, d))


@query("f09_regression_metrics", f"{SCORED} SELECT round(avg((y-raw)*(y-raw)), 8) AS mse, round(sqrt(avg((y-raw)*(y-raw))), 8) AS rmse, round(avg(abs(y-raw)), 8) AS mae, round(1 - avg((y-raw)*(y-raw))/var_pop(y), 8) AS r2 FROM sc")
def f09(spark: SparkSession, d: str) -> DataFrame:
    m = features.regression_metrics(scored(spark, d).select("y", F.col("raw").alias("p")))
    return m.select(*(F.round(c, 8).alias(c) for c in m.columns))


@query("f18_f19_clusters")
def f18(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return features.anomaly_rank(features.kmeans(vectors, 10, iterations=15)[0])


AUDIT = "WITH au AS (SELECT event_id, ts AS created_at, user_id AS subject, event_type FROM events)"


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("subject"), "event_type")


@query("a01_appended_audit", "SELECT event_id, ts AS created_at, event_type AS type, user_id AS subject, props AS detail, strftime(ts, '%Y-%m-%d') AS day FROM events")
def a01(spark: SparkSession, d: str) -> DataFrame:
    path = tables.shared_path(spark, "audit")
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("type"), F.col("user_id").alias("subject"), F.col("props").alias("detail"))
    for part in (0, 1):
        ledger.append_audit(rows.where(F.col("event_id") % 2 == part), path)
    return ledger.audit_trail(spark, path).withColumn("day", F.col("day").cast("string"))


@query("a02_audit", f"{AUDIT} SELECT * FROM au WHERE subject % 10 = 3 ORDER BY created_at DESC, event_id DESC LIMIT 500")
def a02(spark: SparkSession, d: str) -> DataFrame:
    a = audit(spark, d)
    return ledger.read_audit(a, a.where("subject % 10 = 3").select("subject").distinct(), limit=900).select("event_id", "created_at", "subject", "event_type")


REVISIONS = "WITH rv AS (SELECT user_id AS model_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, event_type AS payload, ts AS created_at FROM events)"


def revisions(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("model_id"), F.row_number().over(order).alias("version"), F.col("event_type").alias("payload"), F.col("ts").alias("created_at"))


@query("a03_appended_revisions", f"{REVISIONS}, n AS (SELECT c_custkey AS model_id, c_name AS payload FROM customer) SELECT n.model_id, CAST(coalesce(max(version), 0) + 1 AS INTEGER) AS version, n.payload FROM n LEFT JOIN rv USING (model_id) GROUP BY n.model_id, n.payload")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return ledger.append_revision(revisions(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("payload")))


@query("a04_history", f"{REVISIONS} SELECT model_id, version, created_at, version = max(version) OVER (PARTITION BY model_id) AS current FROM rv")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return ledger.history(revisions(spark, d))


@query("a05_as_of", f"{REVISIONS} SELECT * FROM rv WHERE version = 2")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return ledger.as_of_version(revisions(spark, d), 2)


@query("a06_reviewed_objects", f"{O} SELECT model_id, object_id, CASE obj_seq WHEN 1 THEN 'rejected' WHEN 2 THEN 'modified' ELSE review_status END AS review_status FROM o")
def a06(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    reviews = o.where("obj_seq <= 3").select("model_id", "object_id", F.when(F.col("obj_seq") == 1, "rejected").when(F.col("obj_seq") == 2, "modified").otherwise("nonsense").alias("status"))
    return ledger.apply_reviews(o, reviews).select("model_id", "object_id", "review_status")


@query("a08_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_state(table(spark, d, "events").drop("props"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("a09_interrupted_jobs", "SELECT event_id AS job_id, CASE WHEN event_type IN ('view', 'click') THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type IN ('view', 'click') THEN 'interrupted by restart' ELSE props END AS message FROM events")
def a09(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return ledger.fail_interrupted(table(spark, d, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("props").alias("message")))


@query("a10_stage_progress", "SELECT user_id AS job_id, event_id, event_type AS stage, CAST(row_number() OVER w AS INTEGER) AS step, CAST(floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_progress(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("stage"), F.col("ts").alias("updated_at")))


@query("a11_capabilities", f"{FEATURES_SQL} SELECT model_id, CASE WHEN finding_count > 0 THEN 'available' WHEN object_count > 0 THEN 'partial' ELSE 'not_configured' END AS findings, CASE WHEN confirmed_count = object_count THEN 'available' WHEN confirmed_count > 0 THEN 'partial' ELSE 'not_configured' END AS review FROM f")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return ledger.capability_summary(featured(spark, d))


PROPORTIONS = "c AS (SELECT experiment, CAST(count(*) FILTER (WHERE arm=0) AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE arm=1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE arm=0 AND success) AS DOUBLE) AS s0, CAST(count(*) FILTER (WHERE arm=1 AND success) AS DOUBLE) AS s1 FROM {} GROUP BY experiment), r AS (SELECT experiment, n0, n1, s0/n0 AS p0, s1/n1 AS p1, (s0+s1)/(n0+n1) AS pooled FROM c) SELECT experiment, n0, n1, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p1-p0, 9) AS effect, round((p1-p0)/sqrt(greatest(pooled*(1-pooled)*(1/n0+1/n1), 1e-12)), 6) AS z FROM r"


def rounded(tests: DataFrame, **digits: int) -> DataFrame:
    return tests.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("x04_two_proportions", f"{X}, {PROPORTIONS.format('oc')}")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.two_proportion_test(outcomes(spark, d)), p0=9, p1=9, effect=9, z=6)


#: The tail beyond z by Simpson's rule over 2,000 strips up to z + 12.
_TAIL = "list_sum([(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(abs(z) + i * 0.006) * (abs(z) + i * 0.006) / 2) FOR i IN range(2001)]) * 0.006 / 3 / sqrt(2 * pi())"


@query("x01_two_sided_p", f"{X}, t AS (WITH {PROPORTIONS.format('oc')}) SELECT experiment, round(2 * {_TAIL}, 6) AS p FROM t")
def x01(spark: SparkSession, d: str) -> DataFrame:
    z = F.round("z", 6)
    return experiments.two_proportion_test(outcomes(spark, d)).select("experiment", F.round(experiments.p_two_sided(z), 6).alias("p"))


@query("x05_mean_difference", f"{X} SELECT experiment, round(avg(value) FILTER (WHERE arm=1) - avg(value) FILTER (WHERE arm=0), 6) AS effect, round((avg(value) FILTER (WHERE arm=1) - avg(value) FILTER (WHERE arm=0))/(25.0*sqrt(1.0/count(*) FILTER (WHERE arm=0) + 1.0/count(*) FILTER (WHERE arm=1))), 6) AS z FROM oc GROUP BY experiment")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.mean_difference_test(outcomes(spark, d), 25.0), effect=6, z=6)


@query("x06_event_odds", f"{X}, c AS (SELECT experiment, count(*) FILTER (WHERE arm=0 AND success)+0.5::DOUBLE AS e0, count(*) FILTER (WHERE arm=1 AND success)+0.5::DOUBLE AS e1, count(*) FILTER (WHERE arm=0 AND NOT success)+0.5::DOUBLE AS c0, count(*) FILTER (WHERE arm=1 AND NOT success)+0.5::DOUBLE AS c1 FROM oc GROUP BY experiment) SELECT experiment, round(ln((e1/c1)/(e0/c0)), 8) AS log_odds, round(sqrt(1/e0+1/e1+1/c0+1/c1), 8) AS std_error, round(ln((e1/c1)/(e0/c0))/sqrt(1/e0+1/e1+1/c0+1/c1), 6) AS z, round((e1/c1)/(e0/c0), 8) AS odds_ratio FROM c")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.event_odds_test(outcomes(spark, d)), log_odds=8, std_error=8, z=6, odds_ratio=8)


@query("x07_wilson", f"{X}, c AS (SELECT experiment, arm, count(*) AS n, count(*) FILTER (WHERE success)/count(*) AS p FROM oc GROUP BY ALL) SELECT experiment, arm, round(greatest((p+3.8416/(2*n)-1.96*sqrt(p*(1-p)/n+3.8416/(4*n*n)))/(1+3.8416/n), 0), 8) AS low, round(least((p+3.8416/(2*n)+1.96*sqrt(p*(1-p)/n+3.8416/(4*n*n)))/(1+3.8416/n), 1), 8) AS high FROM c")
def x07(spark: SparkSession, d: str) -> DataFrame:
    c = outcomes(spark, d).groupBy("experiment", "arm").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("success").cast("double").alias("s"))
    low, high = experiments.wilson_interval(F.col("s"), F.col("n"))
    return c.select("experiment", "arm", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("x08_interim_look", f"{X}, k AS (SELECT *, row_number() OVER (PARTITION BY experiment, arm ORDER BY ts, event_id) AS rk, count(*) OVER (PARTITION BY experiment, arm) AS n FROM oc), q AS (SELECT * FROM k WHERE rk <= greatest(2, floor(n*0.5))), {PROPORTIONS.format('q')}")
def x08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.interim_look(outcomes(spark, d), 0.5), p0=9, p1=9, effect=9, z=6)


@query("x09_attrition", f"{X} SELECT experiment, arm, count(*) FILTER (WHERE value > 5) AS observed, count(*) FILTER (WHERE NOT value > 5) AS dropout, count(*) FILTER (WHERE value > 5 AND success) AS response, count(*) FILTER (WHERE value > 5 AND NOT success) AS no_response FROM oc GROUP BY ALL")
def x09(spark: SparkSession, d: str) -> DataFrame:
    return experiments.attrition_summary(outcomes(spark, d), F.col("value") > 5)


@query("x10_randomized", "WITH p AS (SELECT DISTINCT user_id AS participant_id, md5(concat('19:', user_id)) AS key FROM events) SELECT participant_id, substr(key, 1, 2) AS block, CASE WHEN (row_number() OVER (PARTITION BY substr(key, 1, 2) ORDER BY key, participant_id) - 1) % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm FROM p")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return experiments.randomize(table(spark, d, "events").select(F.col("user_id").alias("participant_id")).distinct(), 1.0, 19)


_KINDS = ("binary", "continuous", "time-to-event")
DESIGNS = f"""WITH ds AS (SELECT p_partkey AS design_id, CASE p_size % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'continuous' ELSE 'time-to-event' END AS kind, 0.05::DOUBLE AS alpha, CASE WHEN p_size % 2 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS target_power, (p_size % 10)/10.0::DOUBLE AS dropout, 1.0::DOUBLE + p_size % 3 AS ratio,
  0.3::DOUBLE AS p0, 0.3::DOUBLE + (p_size % 5)/20.0::DOUBLE AS p1, 1.0::DOUBLE + p_size % 4 AS delta, 5.0::DOUBLE AS sd, 0.5::DOUBLE + (p_size % 4)/10.0::DOUBLE AS hazard_ratio, 0.4::DOUBLE AS event_rate, {NormalDist().inv_cdf(0.975)!r} AS za, CASE WHEN p_size % 2 = 0 THEN {NormalDist().inv_cdf(0.8)!r} ELSE {NormalDist().inv_cdf(0.9)!r} END AS zb FROM part)"""


def designs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    kind = F.coalesce(*(F.when(s % 3 == i, k) for i, k in enumerate(_KINDS)))
    numbers = {"alpha": F.lit(0.05), "target_power": F.when(s % 2 == 0, 0.8).otherwise(0.9), "dropout": (s % 10) / 10.0, "ratio": 1.0 + s % 3, "p0": F.lit(0.3), "p1": 0.3 + (s % 5) / 20.0, "delta": 1.0 + s % 4, "sd": F.lit(5.0), "hazard_ratio": 0.5 + (s % 4) / 10.0, "event_rate": F.lit(0.4)}
    return table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), kind.alias("kind"), *(c.alias(k) for k, c in numbers.items()))


@query("x02_validated_designs", f"{DESIGNS} SELECT design_id, concat_ws(',', CASE WHEN dropout > 0.8 THEN 'dropout' END, CASE WHEN p0 = p1 THEN 'effect' END) AS reasons FROM ds")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return experiments.validate_designs(designs(spark, d)).select("design_id", "reasons")


@query(
    "x03_sample_size",
    f"""{DESIGNS}, v AS (SELECT *, (p0 + ratio * p1) / (1 + ratio) AS p FROM ds WHERE dropout <= 0.8 AND p0 <> p1),
n AS (SELECT *, CASE kind WHEN 'binary' THEN ceil(pow((za * sqrt((1 + 1/ratio) * p * (1 - p)) + zb * sqrt(p0 * (1 - p0) + p1 * (1 - p1) / ratio)) / abs(p1 - p0), 2))
  WHEN 'continuous' THEN ceil(pow(za + zb, 2) * sd * sd * (1 + 1/ratio) / (delta * delta)) ELSE ceil(ceil(ceil(4 * pow(za + zb, 2) / pow(ln(hazard_ratio), 2)) / event_rate) / (1 + ratio)) END AS n FROM v)
SELECT design_id, kind, CAST(greatest(2, ceil(greatest(2, n) / (1 - dropout))) AS BIGINT) AS control, CAST(greatest(2, ceil(greatest(2, ceil(n * ratio)) / (1 - dropout))) AS BIGINT) AS treatment FROM n""",
)
def x03(spark: SparkSession, d: str) -> DataFrame:
    valid = experiments.validate_designs(designs(spark, d)).where("reasons = ''")
    return experiments.sample_size(valid).select("design_id", "kind", "control", "treatment")


@query("x11_resampled_power")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return experiments.resampled_power(outcomes(spark, d), 40, 123)
