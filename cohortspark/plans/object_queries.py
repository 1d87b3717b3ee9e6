"""Queries on objects, relationships and longitudinal links (G, R, T), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions import geometry as g
from cohortspark.operators import graph, spatial, temporal
from cohortspark.plans.fixtures import OBJECTS_SQL, dealt_objects, object_tasks, objects
from cohortspark.plans.registry import ORACLE_SQL, query

O = f"WITH {OBJECTS_SQL}"  # noqa: E741


def gap_sql(a: str, b: str) -> str:
    parts = [f"greatest({a}.{x}0-{b}.{x}1, {b}.{x}0-{a}.{x}1, 0.0::DOUBLE)" for x in "xyz"]
    return "sqrt(" + "+".join(f"{p}*{p}" for p in parts) + ")"


def contains_sql(a: str, b: str) -> str:
    return "(" + " AND ".join(f"{a}.{x}0<={b}.{x}0 AND {a}.{x}1>={b}.{x}1" for x in "xyz") + ")"


def intersects_sql(a: str, b: str) -> str:
    return "(" + " AND ".join(f"{a}.{x}0<={b}.{x}1 AND {b}.{x}0<={a}.{x}1" for x in "xyz") + ")"


def distance_sql(a: str, b: str) -> str:
    return "sqrt(" + "+".join(f"({a}.c{x}-{b}.c{x})*({a}.c{x}-{b}.c{x})" for x in "xyz") + ")"


EDGES_SQL = f"""
pairs AS (SELECT a.model_id, a.object_id AS a_id, b.object_id AS b_id, {gap_sql("a", "b")} AS gap,
  CASE WHEN {contains_sql("a", "b")} THEN 'contains' WHEN {contains_sql("b", "a")} THEN 'inside' WHEN {intersects_sql("a", "b")} THEN 'intersects' WHEN {gap_sql("a", "b")} <= 45 THEN 'near' END AS type
  FROM o a JOIN o b ON a.model_id = b.model_id AND a.obj_seq < b.obj_seq),
edges AS (
  SELECT model_id, a_id AS source_id, b_id AS target_id, type, CASE WHEN type = 'near' THEN gap END AS value FROM pairs WHERE type IS NOT NULL
  UNION ALL
  SELECT model_id, b_id, a_id, CASE type WHEN 'contains' THEN 'inside' WHEN 'inside' THEN 'contains' ELSE type END, CASE WHEN type = 'near' THEN gap END FROM pairs WHERE type IS NOT NULL)
"""
E_ = f"{O}, {EDGES_SQL}"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spatial.derive_relationships(objects(spark, d))


def paired(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pairs(objects(spark, d))


@query("g01_distance", f"{O} SELECT a.model_id, a.object_id AS a_id, b.object_id AS b_id, {distance_sql('a', 'b')} AS distance FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("model_id", F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), g.distance("a_", "b_").alias("distance"))


@query("g02_box_distance", f"{O} SELECT a.model_id, a.object_id AS a_id, b.object_id AS b_id, {gap_sql('a', 'b')} AS gap FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("model_id", F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), g.box_distance("a_", "b_").alias("gap"))


@query("g03_surface_distance", f"{O} SELECT a.model_id, a.object_id AS a_id, b.object_id AS b_id, {gap_sql('a', 'b')} AS distance, 'axis-aligned boxes (approximate)' AS method FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("model_id", F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), *g.minimum_surface_distance("a_", "b_"))


@query(
    "g04_box_predicates",
    f"{O} SELECT a.model_id, a.object_id AS a_id, b.object_id AS b_id, {contains_sql('a', 'b')} AS a_contains_b, {contains_sql('b', 'a')} AS b_contains_a, {intersects_sql('a', 'b')} AS overlap, (NOT {intersects_sql('a', 'b')} AND {gap_sql('a', 'b')} <= 1.0) AS adjacent FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq",
)
def g04(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("model_id", F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), g.contains("a_", "b_").alias("a_contains_b"), g.contains("b_", "a_").alias("b_contains_a"), g.intersects("a_", "b_").alias("overlap"), g.adjacent("a_", "b_").alias("adjacent"))


@query("g07_relationships", f"{E_} SELECT model_id, source_id, target_id, type, value, CASE WHEN value IS NOT NULL THEN 'mm' END AS unit FROM edges")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query("g08_grid_relationships", f"{E_} SELECT model_id, source_id, target_id, type, value, CASE WHEN value IS NOT NULL THEN 'mm' END AS unit FROM edges")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return spatial.derive_relationships(objects(spark, d), grid=True)


@query("g08_grid_cells", f"{O} SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, CAST(gz AS BIGINT) AS gz, count(*) AS n FROM o, generate_series(CAST(floor(x0/64) AS BIGINT), CAST(floor(x1/64) AS BIGINT)) s(gx), generate_series(CAST(floor(y0/64) AS BIGINT), CAST(floor(y1/64) AS BIGINT)) t(gy), generate_series(CAST(floor(z0/64) AS BIGINT), CAST(floor(z1/64) AS BIGINT)) u(gz) GROUP BY ALL")
def g08b(spark: SparkSession, d: str) -> DataFrame:
    return spatial.grid_cells(objects(spark, d)).groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g09_box_query",
    f"{O}, q AS (SELECT model_id, min(object_id) AS query_id, min(cx)-10 AS x0, min(cx)+10 AS x1, min(cy)-10 AS y0, min(cy)+10 AS y1, min(cz)-10 AS z0, min(cz)+10 AS z1 FROM o GROUP BY model_id) SELECT DISTINCT q.query_id, q.model_id, o.object_id FROM q JOIN o ON q.model_id=o.model_id AND {intersects_sql('o', 'q')}",
)
def g09(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    corners = [(F.min(f"c{x}") + (10 if i else -10)).alias(f"q_{x}{i}") for x in "xyz" for i in (0, 1)]
    return spatial.box_query(o, o.groupBy("model_id").agg(F.min("object_id").alias("query_id"), *corners))


@query(
    "g10_candidates",
    f"""{O}, c AS (SELECT *, floor(x0/64) AS gx0, floor(x1/64) AS gx1, floor(y0/64) AS gy0, floor(y1/64) AS gy1, floor(z0/64) AS gz0, floor(z1/64) AS gz1, floor((x0-10)/64) AS qx0, floor((x1+10)/64) AS qx1, floor((y0-10)/64) AS qy0, floor((y1+10)/64) AS qy1, floor((z0-10)/64) AS qz0, floor((z1+10)/64) AS qz1 FROM o),
near AS (SELECT a.model_id, a.object_id AS a_object_id, b.object_id AS b_object_id FROM c a JOIN c b ON a.model_id=b.model_id AND a.qx0<=b.gx1 AND a.qx1>=b.gx0 AND a.qy0<=b.gy1 AND a.qy1>=b.gy0 AND a.qz0<=b.gz1 AND a.qz1>=b.gz0),
n AS (SELECT model_id, a_object_id, count(*) AS n FROM near GROUP BY ALL)
SELECT near.* FROM near JOIN n USING (model_id, a_object_id) WHERE n > 1
UNION ALL SELECT a.model_id, a.object_id, b.object_id FROM o a JOIN o b ON a.model_id=b.model_id JOIN n ON n.model_id=a.model_id AND n.a_object_id=a.object_id WHERE n.n <= 1""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    return spatial.candidates(dealt_objects(spark, d), radius=10.0)


@query(
    "g11_nearest",
    f"{O} SELECT model_id, object_id, near_id, CAST(rank AS INTEGER) AS rank, gap FROM (SELECT a.model_id, a.object_id, b.object_id AS near_id, {gap_sql('a', 'b')} AS gap, row_number() OVER (PARTITION BY a.model_id, a.obj_seq ORDER BY {gap_sql('a', 'b')}, b.obj_seq) AS rank FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<>b.obj_seq WHERE NOT {contains_sql('b', 'a')}) WHERE rank <= 5",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(objects(spark, d))


@query("g12_within_radius", f"{O} SELECT a.model_id, a.object_id, b.object_id AS near_id, {gap_sql('a', 'b')} AS gap FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<>b.obj_seq WHERE NOT {contains_sql('b', 'a')} AND {gap_sql('a', 'b')} <= 20")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_radius(objects(spark, d), 20.0)


@query("g12_within_radius_grid", f"{O} SELECT a.model_id, a.object_id, b.object_id AS near_id, {gap_sql('a', 'b')} AS gap FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<>b.obj_seq WHERE NOT {contains_sql('b', 'a')} AND {gap_sql('a', 'b')} <= 20")
def g12b(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_radius(objects(spark, d), 20.0, grid=True)


PATHS_SQL = "p AS (SELECT model_id, concat('path:', model_id) AS path_id, min(cx) AS sx, min(cy) AS sy, min(cz) AS sz, max(cx) AS ex, max(cy) AS ey, max(cz) AS ez FROM o GROUP BY model_id HAVING count(*) > 1)"


def paths(o: DataFrame) -> DataFrame:
    found = o.groupBy("model_id").agg(*(f(f"c{x}").alias(f"{s}{x}") for s, f in (("s", F.min), ("e", F.max)) for x in "xyz"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return found.withColumn("path_id", F.concat_ws(":", F.lit("path"), "model_id"))


@query("g13_trajectory_length", f"{O}, {PATHS_SQL} SELECT path_id, model_id, sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)+(ez-sz)*(ez-sz)) AS length FROM p")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return paths(objects(spark, d)).select("path_id", "model_id", g.trajectory_length().alias("length"))


def slab_sql(x: str) -> tuple[str, str, str]:
    dx = f"(p.e{x}-p.s{x})"
    t0, t1 = f"(o.{x}0-p.s{x})/{dx}", f"(o.{x}1-p.s{x})/{dx}"
    flat = f"abs{dx} < 1e-12"
    return f"CASE WHEN {flat} THEN 0.0 ELSE least({t0}, {t1}) END", f"CASE WHEN {flat} THEN 1.0 ELSE greatest({t0}, {t1}) END", f"({flat} AND (p.s{x} < o.{x}0 OR p.s{x} > o.{x}1))"


_S = [slab_sql(x) for x in "xyz"]
HIT_SQL = f"(NOT ({' OR '.join(s[2] for s in _S)}) AND greatest(0.0, {', '.join(s[0] for s in _S)}) <= least(1.0, {', '.join(s[1] for s in _S)}))"


@query("g17_trajectory_intersections", f"{O}, {PATHS_SQL} SELECT p.path_id, p.model_id, o.object_id FROM p JOIN o ON p.model_id=o.model_id WHERE {HIT_SQL}")
def g17(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return spatial.trajectory_hits(o, paths(o))


@query("g17_grid_intersections", f"{O}, {PATHS_SQL} SELECT p.path_id, p.model_id, o.object_id FROM p JOIN o ON p.model_id=o.model_id WHERE {HIT_SQL}")
def g17b(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return spatial.trajectory_hits(o, paths(o), grid=True)


def _clearance_sql() -> str:
    """Least of 401 evenly spaced places and the exact candidates: knots and the stationary point of each piece between neighbouring knots."""
    knots = ", ".join(f"CASE WHEN abs(ex-sx{'' if x == 'x' else ''})>=0 AND abs(e{x}-s{x})>=1e-12 AND ({x}{i}-s{x})/(e{x}-s{x})>0 AND ({x}{i}-s{x})/(e{x}-s{x})<1 THEN ({x}{i}-s{x})/(e{x}-s{x}) END" for x in "xyz" for i in (0, 1))
    gap = lambda x, t: f"greatest({x}0-(s{x}+(e{x}-s{x})*{t}), (s{x}+(e{x}-s{x})*{t})-{x}1, 0.0::DOUBLE)"
    squared = lambda t: "+".join(f"{gap(x, t)}*{gap(x, t)}" for x in "xyz")
    middle = "((t+coalesce(t2,t))/2)"
    face = lambda x: f"CASE WHEN s{x}+(e{x}-s{x})*{middle} < {x}0 THEN {x}0 WHEN s{x}+(e{x}-s{x})*{middle} > {x}1 THEN {x}1 END"
    slope = "+".join(f"coalesce((e{x}-s{x})*(s{x}-({face(x)})),0)" for x in "xyz")
    curve = "+".join(f"(CASE WHEN ({face(x)}) IS NOT NULL THEN (e{x}-s{x})*(e{x}-s{x}) ELSE 0 END)" for x in "xyz")
    return f"""{O}, {PATHS_SQL}, j AS (SELECT p.path_id, p.sx, p.sy, p.sz, p.ex, p.ey, p.ez, o.* FROM p JOIN o ON p.model_id=o.model_id),
k AS (SELECT *, unnest([0.0::DOUBLE, 1.0::DOUBLE, {knots}]) AS t FROM j),
n AS (SELECT *, lead(t) OVER (PARTITION BY path_id, object_id ORDER BY t) AS t2 FROM k WHERE t IS NOT NULL),
s AS (SELECT *, CASE WHEN {curve} > 0 THEN least(greatest(-({slope})/({curve}), t), coalesce(t2,t)) ELSE t END AS u FROM n)
SELECT path_id, model_id, object_id, round(sqrt(min(least({squared('t')}, {squared('u')}))), 6) AS clearance FROM s GROUP BY ALL"""


@query("g15_trajectory_clearance", _clearance_sql())
def g15(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return spatial.trajectory_clearance(o, paths(o)).withColumn("clearance", F.round("clearance", 6))


@query("g18_spatial_query", f"{O} SELECT a.model_id, a.object_id AS a_object_id, b.object_id AS b_object_id, {gap_sql('a', 'b')} AS value, 'axis-aligned boxes' AS method FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq")
def g18(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    wanted = spatial.pairs(o).select("model_id", "a_object_id", "b_object_id")
    return spatial.spatial_query(o, "surface_distance", wanted)


@query("g19_measure", f"{O} SELECT model_id, object_id, surface_area_mm2 AS value, 'mm2' AS unit FROM o")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return spatial.measure(objects(spark, d), "surface_area")


@query("g20_measure_between", f"{O} SELECT a.model_id, a.object_id AS a_object_id, b.object_id AS b_object_id, {distance_sql('a', 'b')} AS distance, {gap_sql('a', 'b')} AS gap, {contains_sql('a', 'b')} AS a_contains_b, {contains_sql('b', 'a')} AS b_contains_a, {intersects_sql('a', 'b')} AS overlap FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<b.obj_seq")
def g20(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return spatial.measure_between(o, spatial.pairs(o).select("model_id", "a_object_id", "b_object_id"))


@query("g21_extent_v16_box_measures", f"{O} SELECT model_id, object_id, greatest(x1-x0, y1-y0, z1-z0) AS diameter, greatest(x1-x0,0)*greatest(y1-y0,0)*greatest(z1-z0,0) AS box_volume, 2*(greatest(x1-x0,0)*greatest(y1-y0,0)+greatest(x1-x0,0)*greatest(z1-z0,0)+greatest(y1-y0,0)*greatest(z1-z0,0)) AS box_area FROM o")
def g21(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("model_id", "object_id", g.max_extent().alias("diameter"), g.box_volume().alias("box_volume"), g.box_surface_area().alias("box_area"))


@query("g22_recorded_paths", f"{O}, {PATHS_SQL} SELECT p.path_id, p.model_id, string_agg(o.object_id, ',' ORDER BY o.obj_seq) FILTER (WHERE {HIT_SQL}) AS hits FROM p JOIN o ON p.model_id=o.model_id GROUP BY ALL")
def g22(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    found = spatial.record_paths(o, paths(o))
    return found.select("path_id", "model_id", F.when(F.size("hits") > 0, F.array_join("hits", ",")).alias("hits"))


@query("g22_grid_paths", f"WITH c AS ({_clearance_sql()}), {OBJECTS_SQL}, {PATHS_SQL}, h AS (SELECT p.path_id, p.model_id, o.object_id, o.obj_seq, {HIT_SQL} AS hit FROM p JOIN o ON p.model_id=o.model_id) SELECT path_id, model_id, string_agg(object_id, ',' ORDER BY obj_seq) FILTER (WHERE hit) AS hits, min(clearance) FILTER (WHERE NOT hit) AS clearance FROM h JOIN c USING (path_id, model_id, object_id) GROUP BY ALL")
def g22b(spark: SparkSession, d: str) -> DataFrame:
    o = dealt_objects(spark, d)  # each ring of a large model reads it
    found = spatial.record_paths(o, paths(o), grid=True)
    return found.select("path_id", "model_id", F.when(F.size("hits") > 0, F.array_join("hits", ",")).alias("hits"), F.round("clearance", 6).alias("clearance"))


@query("g23_scene_bounds", f"{O} SELECT model_id, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM o WHERE obj_type <> 'volume' GROUP BY model_id")
def g23(spark: SparkSession, d: str) -> DataFrame:
    return spatial.scene_bounds(objects(spark, d))


@query("r01_incident_edges", f"{E_} SELECT DISTINCT e.model_id, source_id, target_id, type, value FROM edges e JOIN o ON o.model_id = e.model_id AND o.object_id IN (source_id, target_id) AND o.obj_type = 'finding'")
def r01(spark: SparkSession, d: str) -> DataFrame:
    wanted = objects(spark, d).where("obj_type = 'finding'").select("model_id", "object_id")
    return graph.incident_edges(edges(spark, d), wanted)


@query("r02_neighbors", f"{E_} SELECT DISTINCT model_id, source_id AS object_id, target_id AS other_id FROM edges")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d))


@query("r03_ancestors", f"{E_} SELECT DISTINCT model_id, target_id AS object_id, source_id AS ancestor_id FROM edges WHERE type = 'contains'")
def r03(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(edges(spark, d))


@query("r03_descendants_compat", f"{E_} SELECT DISTINCT model_id, source_id AS object_id, target_id AS descendant_id FROM edges WHERE type IN ('contains', 'inside')")
def r03b(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(edges(spark, d), compat=True)


@query(
    "r05_collapsed_relations",
    f"{E_} SELECT model_id, CASE WHEN type = 'contains' THEN source_id ELSE least(source_id, target_id) END AS source_id, CASE WHEN type = 'contains' THEN target_id ELSE greatest(source_id, target_id) END AS target_id, type, value FROM (SELECT *, row_number() OVER (PARTITION BY model_id, least(source_id, target_id), greatest(source_id, target_id) ORDER BY CASE type WHEN 'contains' THEN 0 WHEN 'intersects' THEN 1 ELSE 2 END, source_id) AS n FROM edges WHERE type <> 'inside') WHERE n = 1",
)
def r05(spark: SparkSession, d: str) -> DataFrame:
    return graph.collapse_relations(edges(spark, d))


@query("r06_edge_ids", f"{E_} SELECT model_id, source_id AS object_id, string_agg(type || '>' || target_id, ',' ORDER BY type || '>' || target_id) AS edges FROM edges GROUP BY ALL")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_ids_per_object(edges(spark, d)).withColumn("edges", F.array_join("edges", ","))


@query("r07_lookup", f"{O}, w AS (SELECT DISTINCT model_id, concat(model_id, ':', 3) AS object_id FROM o) SELECT w.model_id, w.object_id, o.label, o.object_id IS NOT NULL AS found FROM w LEFT JOIN o ON w.model_id=o.model_id AND w.object_id=o.object_id")
def r07(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    wanted = o.select("model_id", F.concat_ws(":", "model_id", F.lit(3)).alias("object_id")).distinct()
    return graph.lookup(o.select("model_id", "object_id", "label"), wanted, ["model_id", "object_id"])


@query("r04_graph_query")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_query("subgraph", *graph_tables(spark, d))


@query("r04_subgraphs")
def r04b(spark: SparkSession, d: str) -> DataFrame:
    found = graph.subgraph(*graph_tables(spark, d))
    return found.select("model_id", "object_id", *(F.array_join(c, ",").alias(c) for c in graph.OPERATIONS))


#: Objects of which one task has the graph, on average: fewer than elsewhere, since it holds some fifteen rows for each.
LINKED_A_TASK = 50_000


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Objects, their edges, bindings and links, all where their model is: only models and prior objects are dealt again."""
    o = dealt_objects(spark, d, LINKED_A_TASK)
    return o, spatial.derive_relationships(o), object_bindings(o), temporal.link_types(o, priors(o), tasks=object_tasks(spark, d, LINKED_A_TASK))


def object_bindings(o: DataFrame) -> DataFrame:
    """A binding of every other object."""
    return o.where("obj_seq % 2 = 0").select("model_id", F.lit("object").alias("target_type"), F.col("object_id").alias("target_id"), F.concat(F.lit("binding:"), "object_id").alias("binding_id"))


MODELS_SQL = "m AS (SELECT DISTINCT patient_id, model_id, study_date FROM o), pr AS (SELECT patient_id, model_id, study_date, lag(model_id) OVER w AS prior_id, lead(model_id) OVER w AS next_id, CAST(row_number() OVER w AS INTEGER) AS place, CAST(date_diff('day', CAST(lag(study_date) OVER w AS DATE), CAST(study_date AS DATE)) AS INTEGER) AS interval_days FROM m WINDOW w AS (PARTITION BY patient_id ORDER BY study_date, model_id))"


def priors(o: DataFrame) -> DataFrame:
    return temporal.select_prior(temporal.models(o))


@query("t01_normalized_labels", f"{O} SELECT label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm_label, count(*) AS n FROM o GROUP BY ALL")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).groupBy("label", temporal.normalize_label(F.col("label")).alias("norm_label")).agg(F.count(F.lit(1)).alias("n"))


@query("t09_t11_t14_priors", f"{O}, {MODELS_SQL} SELECT patient_id, model_id, prior_id, next_id, place, interval_days FROM pr")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return priors(objects(spark, d)).drop("study_date")


@query("t10_timeline", f"{O}, {MODELS_SQL} SELECT patient_id, string_agg(CAST(model_id AS VARCHAR), ',' ORDER BY study_date, model_id) AS models, count(*) AS n_models, CAST(date_diff('day', CAST(min(study_date) AS DATE), CAST(max(study_date) AS DATE)) AS INTEGER) AS span_days FROM m GROUP BY patient_id")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return temporal.build_timeline(temporal.models(objects(spark, d)))


#: Greedy matching, one current object of a label after the other: each takes the first of its candidates that none before it took.
MATCH_SQL = f"""WITH RECURSIVE {OBJECTS_SQL}, {MODELS_SQL},
ca AS (SELECT a.model_id, pr.prior_id, a.label, a.object_id, a.obj_seq, list(b.object_id ORDER BY 0.8::DOUBLE + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - {distance_sql("a", "b")}/1000) DESC, b.obj_seq) AS cands
  FROM o a JOIN pr ON a.model_id = pr.model_id JOIN o b ON b.model_id = pr.prior_id AND b.label = a.label GROUP BY ALL),
cu AS (SELECT *, row_number() OVER (PARTITION BY model_id, label ORDER BY obj_seq) AS n FROM ca),
ch AS (SELECT model_id, prior_id, label, n, object_id, cands[1] AS picked, [cands[1]] AS used FROM cu WHERE n = 1
  UNION ALL SELECT cu.model_id, cu.prior_id, cu.label, cu.n, cu.object_id, [c FOR c IN cu.cands IF NOT list_contains(ch.used, c)][1], list_append(ch.used, [c FOR c IN cu.cands IF NOT list_contains(ch.used, c)][1])
  FROM ch JOIN cu ON cu.model_id = ch.model_id AND cu.label = ch.label AND cu.n = ch.n + 1),
l AS (SELECT ch.model_id, ch.prior_id, ch.object_id, picked AS prior_object_id, 0.8 + 0.2 * greatest(0.0::DOUBLE, 1 - {distance_sql("a", "b")}/1000) AS confidence, {distance_sql("a", "b")} AS centroid_distance,
  a.volume_mm3 - b.volume_mm3 AS volume_delta, CASE WHEN b.volume_mm3 <> 0 THEN (a.volume_mm3-b.volume_mm3)/b.volume_mm3*100 END AS volume_percent,
  greatest(a.x1-a.x0, a.y1-a.y0, a.z1-a.z0) - greatest(b.x1-b.x0, b.y1-b.y0, b.z1-b.z0) AS diameter_delta, (greatest(a.x1-a.x0, a.y1-a.y0, a.z1-a.z0) - greatest(b.x1-b.x0, b.y1-b.y0, b.z1-b.z0)) / greatest(b.x1-b.x0, b.y1-b.y0, b.z1-b.z0) * 100 AS diameter_percent,
  a.surface_area_mm2 - b.surface_area_mm2 AS surface_delta, (a.surface_area_mm2 - b.surface_area_mm2) / b.surface_area_mm2 * 100 AS surface_percent, a.cx AS cx, b.cx AS p_cx, a.volume_mm3 AS volume, b.volume_mm3 AS p_volume
  FROM ch JOIN o a ON a.model_id = ch.model_id AND a.object_id = ch.object_id JOIN o b ON b.model_id = ch.prior_id AND b.object_id = picked),
ld AS (SELECT *, CASE WHEN abs(volume_percent) >= 20 OR centroid_distance >= 50 THEN 'changed_from' ELSE 'same_as_prior' END AS link_type FROM l),
lk AS (
  SELECT model_id, prior_id, object_id, prior_object_id, link_type, confidence, centroid_distance, volume_delta, volume_percent, diameter_delta, diameter_percent, surface_delta, surface_percent FROM ld
  UNION ALL SELECT pr.model_id, prior_id, object_id, object_id, 'new', 1.0::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pr JOIN o ON o.model_id = pr.model_id WHERE prior_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.model_id = pr.model_id AND l.object_id = o.object_id)
  UNION ALL SELECT pr.model_id, prior_id, object_id, object_id, 'resolved', 1.0::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pr JOIN o ON o.model_id = pr.prior_id WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.model_id = pr.model_id AND l.prior_object_id = o.object_id))
"""
CHANGES = ("confidence", "centroid_distance", "volume_delta", "volume_percent", "diameter_delta", "diameter_percent", "surface_delta", "surface_percent")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in CHANGES)


def links(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return temporal.compare_models(o, priors(o))


@query("t03_greedy_matches", f"{MATCH_SQL} SELECT model_id, prior_id, object_id, prior_object_id, round(confidence, 9) AS score FROM l")
def t03(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return temporal.match_objects(o, priors(o)).withColumn("score", F.round("score", 9))


@query("t05_t08_compared_models", f"{MATCH_SQL} SELECT model_id, prior_id, object_id, prior_object_id, link_type, {_ROUNDED} FROM lk")
def t08(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("model_id", "prior_id", "object_id", "prior_object_id", "link_type", *(F.round(c, 6).alias(c) for c in CHANGES))


@query("t18_change_counts", f"{O}, {MODELS_SQL}, n AS (SELECT model_id, label, count(*) AS n FROM o GROUP BY ALL), j AS (SELECT pr.model_id, coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS was FROM (SELECT pr.model_id, pr.prior_id, n.label, n.n FROM pr JOIN n ON n.model_id=pr.model_id WHERE prior_id IS NOT NULL) a FULL JOIN (SELECT pr.model_id, pr.prior_id, n.label, n.n FROM pr JOIN n ON n.model_id=pr.prior_id) b ON a.model_id=b.model_id AND a.label=b.label JOIN pr ON pr.model_id=coalesce(a.model_id, b.model_id)) SELECT model_id, CAST(sum(least(now, was)) AS BIGINT) AS matched, CAST(sum(greatest(now-was, 0)) AS BIGINT) AS new, CAST(sum(greatest(was-now, 0)) AS BIGINT) AS resolved FROM j GROUP BY model_id")
def t18(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    counts = temporal.change_counts(temporal.compare_models(o, priors(o)))
    return counts.select("model_id", (F.col("same_as_prior") + F.col("changed_from")).alias("matched"), "new", "resolved")


@query("t12_history", f"{MATCH_SQL} SELECT model_id, object_id, prior_object_id, link_type FROM lk WHERE suffix(object_id, ':1') OR suffix(prior_object_id, ':1')")
def t12(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    own = o.where("obj_seq = 1").select("model_id", "object_id")
    before = temporal.prior_objects(o, priors(o)).where("obj_seq = 1").select("model_id", "object_id")
    return temporal.history(links(spark, d), own.unionByName(before)).select("model_id", "object_id", "prior_object_id", "link_type")


@query(
    "t13_change_report",
    f"{MATCH_SQL} SELECT lk.model_id, lk.object_id, link_type, round(confidence, 9) AS confidence, CASE WHEN link_type <> 'new' THEN b.volume_mm3 END AS volume_prior, CASE WHEN link_type <> 'resolved' THEN a.volume_mm3 END AS volume_now, round(volume_percent, 6) AS volume_percent, round(diameter_delta, 6) AS diameter_delta FROM lk LEFT JOIN o a ON a.model_id = lk.model_id AND a.object_id = lk.object_id LEFT JOIN o b ON b.model_id = lk.prior_id AND b.object_id = lk.prior_object_id WHERE link_type <> 'same_as_prior'",
)
def t13(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = temporal.change_report(links(spark, d), objects(spark, d))
    return rows.select("model_id", "object_id", "link_type", F.round("confidence", 9).alias("confidence"), "volume_prior", "volume_now", *(F.round(c, 6).alias(c) for c in ("volume_percent", "diameter_delta")))


@query("t13_unchanged_counts", f"{MATCH_SQL} SELECT model_id, count(*) FILTER (WHERE link_type = 'same_as_prior') AS unchanged FROM lk GROUP BY model_id")
def t13b(spark: SparkSession, d: str) -> DataFrame:
    return temporal.change_report(links(spark, d), objects(spark, d))[1]


@query("t15_prior_versions", f"{MATCH_SQL} SELECT o.model_id, o.object_id, pr.prior_id, l.prior_object_id AS version_id FROM o JOIN pr ON pr.model_id = o.model_id LEFT JOIN l ON l.model_id = o.model_id AND l.object_id = o.object_id WHERE pr.prior_id IS NOT NULL")
def t15(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return temporal.prior_version(o, links(spark, d), priors(o))


@query("t16_interpolated", f"{MATCH_SQL} SELECT model_id, object_id, p_cx + (cx-p_cx)*0.25 AS cx, round(p_volume + (volume-p_volume)*0.25, 6) AS volume_mm3 FROM l")
def t16(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    names = ["cx", "cy", "cz", "volume_mm3"]
    before = temporal.prior_objects(o, priors(o)).select("model_id", F.col("object_id").alias("prior_object_id"), *(F.col(c).alias(f"p_{c}") for c in names))
    linked = temporal.match_objects(o, priors(o)).join(o.select("model_id", "object_id", *names), ["model_id", "object_id"]).join(before, ["model_id", "prior_object_id"])
    return temporal.interpolate(linked, 0.25).select("model_id", "object_id", "cx", F.round("volume_mm3", 6).alias("volume_mm3"))


@query("t17_overlay", f"{O}, {MODELS_SQL} SELECT model_id, object_id, 'current' AS side FROM o UNION ALL SELECT pr.model_id, object_id, 'prior' FROM pr JOIN o ON o.model_id = pr.prior_id")
def t17(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    return temporal.overlay(o, priors(o))


@query("t17_difference", f"{MATCH_SQL} SELECT o.model_id, o.object_id, CASE lk.link_type WHEN 'changed_from' THEN 'changed' WHEN 'new' THEN 'new' ELSE 'baseline' END AS style FROM o LEFT JOIN lk ON lk.model_id = o.model_id AND lk.object_id = o.object_id AND lk.link_type IN ('changed_from', 'new') UNION ALL SELECT model_id, object_id, 'resolved' FROM lk WHERE link_type = 'resolved'")
def t17b(spark: SparkSession, d: str) -> DataFrame:
    o = dealt_objects(spark, d)
    return temporal.difference(o, temporal.link_types(o, priors(o), tasks=object_tasks(spark, d)))


#: A rotation and shift for every model; the order of the axes by whether its number is even.
TURN = {"rx": 0.1, "ry": -0.2, "rz": 0.3, "tx": 5.0, "ty": -3.0, "tz": 2.0, "ox": 10.0, "oy": 20.0, "oz": 30.0}


def registrations(o: DataFrame) -> DataFrame:
    return o.select("model_id").distinct().select("model_id", *(F.lit(v).alias(k) for k, v in TURN.items()), F.when(F.col("model_id") % 2 == 0, "zyx").otherwise("zxy").alias("axes"))


def turned_sql(p: str) -> str:
    """``tx_, ty_, tz_``: a point's coordinates after TURN: about x then y (even models) or y then x, then about z."""
    cx, sx, cy, sy, cz, sz = (f"{f}({TURN[k]})" for k in ("rx", "ry", "rz") for f in ("cos", "sin"))
    u = {x: f"({p}{x} - {TURN['o' + x]})" for x in "xyz"}
    about_x = lambda v: (v[0], f"({cx}*{v[1]} - {sx}*{v[2]})", f"({sx}*{v[1]} + {cx}*{v[2]})")
    about_y = lambda v: (f"({cy}*{v[0]} + {sy}*{v[2]})", v[1], f"({cy}*{v[2]} - {sy}*{v[0]})")
    even, odd = about_y(about_x(tuple(u.values()))), about_x(about_y(tuple(u.values())))
    v = [f"(CASE WHEN model_id % 2 = 0 THEN {a} ELSE {b} END)" for a, b in zip(even, odd, strict=True)]
    done = (f"{cz}*{v[0]} - {sz}*{v[1]}", f"{sz}*{v[0]} + {cz}*{v[1]}", v[2])
    return ", ".join(f"{e} + {TURN['o' + x]} + {TURN['t' + x]} AS t{x}_" for e, x in zip(done, "xyz", strict=True))


@query("t07_rigid_transform", f"{O}, t AS (SELECT model_id, object_id, {turned_sql('c')} FROM o) SELECT model_id, object_id, round(tx_, 6) AS cx, round(ty_, 6) AS cy, round(tz_, 6) AS cz FROM t")
def t07(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).select("model_id", "object_id", "cx", "cy", "cz")
    moved = temporal.rigid_transform(o, registrations(o))
    return moved.select("model_id", "object_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")))


_CORNERS = " UNION ALL ".join(f"SELECT pr.model_id, object_id, x{i} AS kx, y{j} AS ky, z{k} AS kz FROM pr JOIN o ON o.model_id = pr.prior_id" for i in (0, 1) for j in (0, 1) for k in (0, 1))


@query(
    "t08_registered_priors",
    f"{O}, {MODELS_SQL}, k AS ({_CORNERS}), t AS (SELECT model_id, object_id, {turned_sql('k')} FROM k) SELECT model_id, object_id, round(min(tx_), 5) AS x0, round(max(tx_), 5) AS x1, round(min(ty_), 5) AS y0, round(max(ty_), 5) AS y1, round(min(tz_), 5) AS z0, round(max(tz_), 5) AS z1 FROM t GROUP BY ALL",
)
def t08b(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    moved = temporal.prior_objects(o, priors(o), registrations(o))
    return moved.select("model_id", "object_id", *(F.round(f"{x}{i}", 5).alias(f"{x}{i}") for x in "xyz" for i in (0, 1)))


_TURNED_MATCH = MATCH_SQL.replace("JOIN o b ON", "JOIN ot b ON").replace("\nca AS (", f"\not AS (SELECT t.* EXCLUDE (tx_, ty_, tz_, cx, cy, cz), tx_ AS cx, ty_ AS cy, tz_ AS cz FROM (SELECT *, {turned_sql('c')} FROM (SELECT o.* EXCLUDE (model_id), pr.prior_id, pr.model_id FROM o JOIN pr ON o.model_id = pr.prior_id)) t),\nca AS (", 1).replace("b.model_id = pr.prior_id AND", "b.model_id = pr.model_id AND").replace("b.model_id = ch.prior_id AND", "b.model_id = ch.model_id AND")


@query("t08_registered_links", f"{_TURNED_MATCH} SELECT model_id, object_id, prior_object_id, link_type, round(confidence, 6) AS confidence, round(centroid_distance, 5) AS centroid_distance FROM ld")
def t08c(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    found = temporal.compare_models(o, priors(o), registrations(o)).where("link_type in ('same_as_prior', 'changed_from')")
    return found.select("model_id", "object_id", "prior_object_id", "link_type", F.round("confidence", 6).alias("confidence"), F.round("centroid_distance", 5).alias("centroid_distance"))


GRAPH_SQL = f"""{MATCH_SQL}, {EDGES_SQL}, be AS (SELECT model_id, source_id AS object_id, target_id AS other_id, source_id, target_id, type FROM edges UNION ALL SELECT model_id, target_id, source_id, source_id, target_id, type FROM edges),
gr AS (SELECT DISTINCT 'neighbors' AS operation, model_id, object_id, other_id AS result_id FROM be
  UNION ALL SELECT DISTINCT 'ancestors', model_id, target_id, source_id FROM edges WHERE type = 'contains'
  UNION ALL SELECT DISTINCT 'descendants', model_id, source_id, target_id FROM edges WHERE type = 'contains'
  UNION ALL SELECT DISTINCT 'relationships', model_id, object_id, concat(source_id, '>', type, '>', target_id) FROM be
  UNION ALL SELECT 'context', model_id, object_id, concat('binding:', object_id) FROM o WHERE obj_seq % 2 = 0
  UNION ALL SELECT 'prior_versions', model_id, object_id, prior_object_id FROM l)
"""
ORACLE_SQL["r04_graph_query"] = f"{GRAPH_SQL} SELECT * FROM gr"
ORACLE_SQL["r04_subgraphs"] = f"""{GRAPH_SQL} SELECT o.model_id, o.object_id, {", ".join(f"coalesce(string_agg(result_id, ',' ORDER BY result_id) FILTER (WHERE operation = '{n}'), '') AS {n}" for n in graph.OPERATIONS)}
FROM o LEFT JOIN gr ON gr.model_id = o.model_id AND gr.object_id = o.object_id GROUP BY ALL"""
