"""Queries on models of cohort features (F), with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import features, learning
from cohortspark.operators.tables import shared_path, shared_table
from cohortspark.plans.cohort_queries import LABELLED_SQL, featured, labelled
from cohortspark.plans.fixtures import objects, table
from cohortspark.plans.object_queries import EDGES_SQL, MATCH_SQL, edges, links, object_bindings
from cohortspark.plans.registry import query
from cohortspark.sources.writers import list_artifacts

NAMES = ("object_count", "finding_count", "largest_volume")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of frames: line items, with their price as mean, discount as least and quantity as most."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("model_id"), (F.col("l_suppkey") % 3).alias("series"), (F.col("l_extendedprice") / 7).alias("mean"), F.col("l_discount").cast("double").alias("least"), F.col("l_quantity").cast("double").alias("most"))


_TOTALS = ("total_volume_mm3", "mean_temporal_volume_change_percent", "source_mean_intensity", "source_frame_mean_variability", "finding_volume_mm3")


@query(
    "f01_all_features",
    f"""{MATCH_SQL}, {EDGES_SQL},
a1 AS (SELECT model_id, CAST(count(*) AS DOUBLE) AS object_count, CAST(count(*) FILTER (WHERE obj_type = 'anatomy') AS DOUBLE) AS anatomy_count, CAST(count(*) FILTER (WHERE obj_type = 'finding') AS DOUBLE) AS finding_count, CAST(count(*) FILTER (WHERE obj_type = 'region') AS DOUBLE) AS region_count,
  CAST(count(*) FILTER (WHERE obj_seq % 3 = 0) AS DOUBLE) AS mesh_count, CAST(count(*) FILTER (WHERE obj_seq % 2 = 0) AS DOUBLE) AS context_binding_count, CAST(count(*) FILTER (WHERE review_status = 'confirmed') AS DOUBLE) AS confirmed_object_count,
  round(sum(volume_mm3), 4) AS total_volume_mm3, max(volume_mm3) AS largest_object_volume_mm3, round(coalesce(sum(volume_mm3) FILTER (WHERE obj_type = 'finding'), 0), 4) AS finding_volume_mm3 FROM o GROUP BY model_id),
a2 AS (SELECT model_id, CAST(count(*) AS DOUBLE) AS relationship_count FROM edges GROUP BY model_id),
a3 AS (SELECT model_id, CAST(count(*) AS DOUBLE) AS temporal_link_count, round(avg(volume_percent), 4) AS mean_temporal_volume_change_percent FROM lk GROUP BY model_id),
a4 AS (SELECT l_orderkey AS model_id, CAST(count(DISTINCT l_suppkey % 3) AS DOUBLE) AS source_series_count, CAST(count(*) AS DOUBLE) AS source_instance_count, round(avg(l_extendedprice / 7), 4) AS source_mean_intensity, CAST(min(l_discount) AS DOUBLE) AS source_min_intensity, CAST(max(l_quantity) AS DOUBLE) AS source_max_intensity, round(stddev_pop(l_extendedprice / 7), 4) AS source_frame_mean_variability FROM lineitem GROUP BY 1)
SELECT model_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in features.ALL_FEATURES)} FROM a1 LEFT JOIN a2 USING (model_id) LEFT JOIN a3 USING (model_id) LEFT JOIN a4 USING (model_id)""",
)
def f01(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).withColumn("mesh_id", F.when(F.col("obj_seq") % 3 == 0, F.col("object_id")))
    found = features.cohort_features(o, edges(spark, d), object_bindings(o), links(spark, d), frames(spark, d))
    return found.withColumns({n: F.round(n, 4) for n in _TOTALS})


def dataset(spark: SparkSession, d: str) -> DataFrame:
    return features.build_dataset(featured(spark, d), labelled(spark, d))[0]


DATA_SQL = f"{LABELLED_SQL}, ds AS (SELECT f.model_id, object_count, finding_count, largest_volume, CASE status WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM f JOIN lb USING (model_id) WHERE status IN ('F', 'O'))"
_Z = ", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS z{i}" for i, n in enumerate(NAMES))
STANDARD_SQL = f"{DATA_SQL}, z AS (SELECT model_id, y, {_Z} FROM ds)"


def descent_sql(steps: int, rate: float, l2: float) -> str:
    """Gradient steps one after the other, each a query over all rows with the weights of the one before."""
    k = range(len(NAMES))
    raw = " + ".join(f"w{i} * z{i}" for i in k)
    out = f"{STANDARD_SQL}, g0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w{i}' for i in k)}, 0.0::DOUBLE AS b)"
    for s in range(steps):
        moved = ", ".join(f"max(w{i}) - {rate} * (avg(e * z{i}) + {l2} * max(w{i})) AS w{i}" for i in k)
        out += f", g{s + 1} AS (SELECT {moved}, max(b) - {rate} * avg(e) AS b FROM (SELECT *, 1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, b + {raw})))) - y AS e FROM z, g{s}))"
    return out


@query("f11_logistic_descent", f"{descent_sql(20, 0.08, 0.001)} SELECT {', '.join(f'round(w{i}, 7) AS {n}' for i, n in enumerate(NAMES))}, round(b, 7) AS bias FROM g20")
def f11(spark: SparkSession, d: str) -> DataFrame:
    rows = features.standardize(dataset(spark, d), NAMES)
    weights, bias = learning.train_logistic(rows, NAMES, iterations=20, solver="gd")
    return rows.agg(*(F.lit(round(weights[n], 7)).alias(n) for n in NAMES), F.lit(round(bias, 7)).alias("bias"))


@query("f11_logistic_predictions")
def f11b(spark: SparkSession, d: str) -> DataFrame:
    rows = features.standardize(dataset(spark, d), NAMES)
    weights, bias = learning.train_logistic(rows, NAMES)
    return learning.predict_logistic(rows, weights, bias)


def linear_sql(steps: int, rate: float, l2: float) -> str:
    k = range(len(NAMES))
    sums = [f"sum(z{i} * z{j}) AS s{i}{j}" for i in k for j in k] + [f"sum(z{i} * y) AS t{i}" for i in k] + [f"sum(z{i}) AS u{i}" for i in k]
    step = [f"w{i} - {rate} * (({' + '.join(f's{i}{j} * w{j}' for j in k)} + u{i} * b - t{i}) / n + {l2} * w{i})" for i in k]
    bias = f"b - {rate} * ({' + '.join(f'u{j} * w{j}' for j in k)} + n * b - v) / n"
    base = STANDARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{base}, m AS (SELECT count(*) AS n, sum(y) AS v, {', '.join(sums)} FROM z), r AS (SELECT 0 AS k, {', '.join(f'0.0::DOUBLE AS w{i}' for i in k)}, v / n AS b FROM m UNION ALL SELECT k + 1, {', '.join(step)}, {bias} FROM r, m WHERE k < {steps})"


@query("f12_linear_fit", f"{linear_sql(600, 0.03, 0.001)} SELECT model_id, round(b + {' + '.join(f'w{i} * z{i}' for i in range(len(NAMES)))}, 6) AS raw, {', '.join(f'round(w{i} * z{i}, 6) AS from_{n}' for i, n in enumerate(NAMES))} FROM z, r WHERE k = 600")
def f12(spark: SparkSession, d: str) -> DataFrame:
    rows = features.standardize(dataset(spark, d), NAMES)
    weights, bias = features.train_linear(rows, NAMES)
    found = features.predict_linear(rows, weights, bias, classify=False)
    return found.select("model_id", *(F.round(c, 6).alias(c) for c in found.columns if c != "model_id"))


@query("f13_f21_forest_predictions")
def f13(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset(spark, d)
    model = learning.train_forest(rows, NAMES, n_trees=8, depth=4)
    baseline = rows.agg(F.avg("y")).first()[0]
    found = learning.predict_forest(model, rows, NAMES, learning.forest_importance(model, NAMES), learning.feature_scales(rows, NAMES), baseline)
    return found.withColumn("votes", F.array_join(F.transform("votes", lambda v: F.round(v, 6).cast("string")), ","))


@query("f14_forest_importance")
def f14(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset(spark, d)
    found = learning.forest_importance(learning.train_forest(rows, NAMES, n_trees=8, depth=4), NAMES)
    return rows.groupBy().agg(*(F.lit(v).alias(n) for n, v in found.items()))


@query("f15_cross_validation")
def f15(spark: SparkSession, d: str) -> DataFrame:
    rows = features.fold_numbers(dataset(spark, d), 3).persist()
    try:
        found = learning.cross_validate(rows, NAMES, "forest", n_trees=4, depth=3)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(f["fold"], float(f["accuracy"]), float(f["precision"]), float(f["recall"])) for f in found], "fold int, accuracy double, precision double, recall double")


def descents_sql(sets: str, rates: dict[int, float], steps: int = 20, l2: float = 0.001) -> str:
    """Descents of several training sets at once: ``sets`` has ``k, model_id, y, held`` and the features; ``scored`` then has ``k, y, p`` of the rows held out."""
    i = range(len(NAMES))
    scale = ", ".join(f"avg({n}) FILTER (WHERE NOT held) AS m{j}, CASE WHEN stddev_pop({n}) FILTER (WHERE NOT held) < 1e-9 THEN 1 ELSE stddev_pop({n}) FILTER (WHERE NOT held) END AS d{j}" for j, n in enumerate(NAMES))
    rate = f"CASE k {' '.join(f'WHEN {k} THEN {r}::DOUBLE' for k, r in rates.items())} END"
    share = f"1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, b + {' + '.join(f'w{j} * z{j}' for j in i)}))))"
    out = f"{sets}, sc AS MATERIALIZED (SELECT k, {scale} FROM sets GROUP BY k), z AS MATERIALIZED (SELECT k, y, held, {', '.join(f'({n} - m{j}) / d{j} AS z{j}' for j, n in enumerate(NAMES))} FROM sets JOIN sc USING (k)), g0 AS (SELECT k, {', '.join(f'0.0::DOUBLE AS w{j}' for j in i)}, 0.0::DOUBLE AS b FROM sc)"
    for s in range(steps):
        moved = ", ".join(f"max(w{j}) - {rate} * (avg(e * z{j}) + {l2} * max(w{j})) AS w{j}" for j in i)
        out += f", g{s + 1} AS MATERIALIZED (SELECT k, {moved}, max(b) - {rate} * avg(e) AS b FROM (SELECT *, {share} - y AS e FROM z JOIN g{s} USING (k) WHERE NOT held) GROUP BY k)"
    return f"{out}, scored AS (SELECT k, y, CAST({share} >= 0.5 AS INTEGER) AS p FROM z JOIN g{steps} USING (k) WHERE held)"


_RATES = "avg(CAST(y = p AS INTEGER)) AS accuracy, count(*) FILTER (WHERE y = 1 AND p = 1) / greatest(count(*) FILTER (WHERE p = 1), 1) AS precision, count(*) FILTER (WHERE y = 1 AND p = 1) / greatest(count(*) FILTER (WHERE y = 1), 1) AS recall"
_FOLDS = f"{DATA_SQL}, fd AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY model_id) - 1) % 3 AS fold FROM ds), sets AS MATERIALIZED (SELECT t.k, fold = t.k AS held, fd.* FROM fd, (VALUES (0), (1), (2)) t(k))"


@query(
    "f15_validated_descents",
    f"{descents_sql(_FOLDS, {0: 0.08, 1: 0.08, 2: 0.08})}, r AS (SELECT CAST(k AS INTEGER) AS fold, {_RATES} FROM scored GROUP BY k) SELECT fold, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall FROM (FROM r UNION ALL SELECT -1, avg(accuracy), avg(precision), avg(recall) FROM r)",
)
def f15b(spark: SparkSession, d: str) -> DataFrame:
    rows = features.fold_numbers(dataset(spark, d), 3).persist()
    try:
        found = learning.cross_validate(rows, NAMES, "logistic", iterations=20, solver="gd")
    finally:
        rows.unpersist()
    names = ("accuracy", "precision", "recall")
    return spark.createDataFrame([(f["fold"], *(round(float(f[n]), 9) for n in names)) for f in found], f"fold int, {', '.join(f'{n} double' for n in names)}")


DESCENTS = [{"algorithm": "logistic", "iterations": 20, "solver": "gd", "rate": r} for r in (0.02, 0.08, 1.0)]
_HELD = f"{DATA_SQL}, hd AS (SELECT *, row_number() OVER (ORDER BY model_id) > count(*) OVER () - count(*) OVER () // 5 AS held FROM ds), sets AS MATERIALIZED (SELECT t.k, hd.* FROM hd, (VALUES (0), (1), (2)) t(k))"


@query("f16_searched_descents", f"{descents_sql(_HELD, {k: c['rate'] for k, c in enumerate(DESCENTS)})}, r AS (SELECT k, {_RATES} FROM scored GROUP BY k) SELECT CAST(k AS INTEGER) AS candidate, round(accuracy, 9) AS accuracy, k = first_value(k) OVER (ORDER BY accuracy DESC, k) AS best FROM r")
def f16b(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset(spark, d).persist()
    try:
        found, best = learning.search_configs(rows, NAMES, DESCENTS)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(i, round(float(f["accuracy"]), 9), i == best) for i, f in enumerate(found)], "candidate int, accuracy double, best boolean")


CANDIDATES = [{"algorithm": "logistic", "iterations": 20}, {"algorithm": "logistic", "iterations": 40, "l2": 0.1}, {"algorithm": "forest", "n_trees": 4, "depth": 3}]


@query("f16_search")
def f16(spark: SparkSession, d: str) -> DataFrame:
    found, best = learning.search_configs(shared_table(dataset(spark, d)), NAMES, CANDIDATES)
    return spark.createDataFrame([(i, f["algorithm"], float(f["accuracy"]), i == best) for i, f in enumerate(found)], "candidate int, algorithm string, accuracy double, best boolean")


def axis_sql(matrix: str, name: str, squarings: int = 14) -> str:
    """The axis of the largest eigenvalue of a symmetric table ``i, j, v`` as ``name(i, w)``: the matrix squared again and again is that axis times itself. Its largest entry is positive."""
    out, last = "", matrix
    for s in range(squarings):
        out += f", {name}{s} AS MATERIALIZED (SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j))"
        last = f"{name}{s}"
    return f"{out}, {name} AS MATERIALIZED (SELECT p.i, p.v / sqrt(t.v) AS w FROM {last} p JOIN (SELECT i, v FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1) t ON p.j = t.i)"


def projection_sql(names: tuple[str, ...]) -> str:
    z = ", ".join(f"({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () < 1e-9 THEN 1 ELSE stddev_pop({n}) OVER () END" for n in names)
    out = f"{LABELLED_SQL}, zs AS MATERIALIZED (SELECT model_id, unnest([{z}]) AS z, unnest(range({len(names)})) AS i FROM f), m AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / count(*) AS v FROM zs a JOIN zs b USING (model_id) GROUP BY a.i, b.i)"
    out += axis_sql("m", "p")
    out += ", rest AS MATERIALIZED (SELECT m.i, m.j, m.v - l.v * a.w * b.w AS v FROM m JOIN p a ON a.i = m.i JOIN p b ON b.i = m.j, (SELECT sum(m.v * a.w * b.w) AS v FROM m JOIN p a ON a.i = m.i JOIN p b ON b.i = m.j) l)"
    return out + axis_sql("rest", "q") + " SELECT model_id, round(sum(z * p.w), 5) AS pc1, round(sum(z * q.w), 5) AS pc2 FROM zs JOIN p USING (i) JOIN q USING (i) GROUP BY model_id"


@query("f17_projection", projection_sql(features.FEATURES))
def f17(spark: SparkSession, d: str) -> DataFrame:
    found = learning.pca_project(featured(spark, d), features.FEATURES)[0]
    return found.select("model_id", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


def clusters_sql(k: int, steps: int) -> str:
    """Lloyd's steps from the vectors of the k smallest ids, and what ``anomaly_rank`` makes of the result."""
    out = f"WITH e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS k, v AS c FROM (FROM e ORDER BY id LIMIT {k}))"
    for s in range(steps + 1):
        out += f", a{s} AS MATERIALIZED (SELECT id, any_value(v) AS v, min({{'d': list_distance(v, c), 'k': k}}) AS m FROM e, c{s} GROUP BY id)"
        out += f", c{s + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, c{s}.c) AS c FROM c{s} LEFT JOIN (SELECT k, list(x ORDER BY p) AS c FROM (SELECT k, p, avg(x) AS x FROM (SELECT m.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{s}) GROUP BY k, p) GROUP BY k) n USING (k))"
    return out + f", ranked AS (SELECT id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, m.d / max(m.d) OVER () AS score FROM a{steps})"


def clusters(spark: SparkSession, d: str, k: int, steps: int) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    centres = [list(r["v"]) for r in vectors.orderBy("id").limit(k).collect()]
    return features.anomaly_rank(features.kmeans(vectors, k, iterations=steps, centres=centres)[0])


@query("f18_given_centres", f"{clusters_sql(8, 4)} SELECT id, cluster, round(distance, 6) AS distance, round(score, 6) AS score FROM ranked")
def f18b(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, 8, 4).select("id", "cluster", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("f19_cluster_summary", f"{clusters_sql(8, 4)} SELECT cluster, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS largest_score, arg_max(id, (score, -id)) AS farthest FROM ranked GROUP BY cluster")
def f19(spark: SparkSession, d: str) -> DataFrame:
    found = features.cluster_summary(clusters(spark, d, 8, 4))
    return found.select("cluster", "n", F.round("mean_score", 6).alias("mean_score"), F.round("largest_score", 6).alias("largest_score"), "farthest")


#: A forest that is not learned: nodes are feature, threshold, left, right, value.
_NODE = ("feature", "threshold", "left", "right", "value")
TREES = (
    ((0, 3.5, 1, 2, 0.0), (-1, None, -1, -1, 0.25), (1, 1.0, 3, 4, 0.0), (-1, None, -1, -1, 0.5), (-1, None, -1, -1, 1.0)),
    ((2, 2000.0, 1, 2, 0.0), (-1, None, -1, -1, 0.75), (-1, None, -1, -1, 0.125)),
)
IMPORTANCE = {"object_count": 0.5, "finding_count": 0.3, "largest_volume": 0.2}
_VOTES = "CASE WHEN object_count <= 3.5 THEN 0.25 WHEN finding_count <= 1 THEN 0.5 ELSE 1.0 END::DOUBLE", "CASE WHEN largest_volume <= 2000 THEN 0.75 ELSE 0.125 END::DOUBLE"


@query(
    "f21_registered_forest",
    f"{STANDARD_SQL}, v AS (SELECT model_id, {_VOTES[0]} AS vote_0, {_VOTES[1]} AS vote_1, ({_VOTES[0]} + {_VOTES[1]}) / 2 AS raw FROM ds), b AS (SELECT avg(y) AS base FROM ds) SELECT model_id, vote_0, vote_1, raw, CAST(raw >= 0.5 AS DOUBLE) AS p, {', '.join(f'round({w} * tanh(z{i}) * (raw - base), 7) AS from_{n}' for i, (n, w) in enumerate(IMPORTANCE.items()))} FROM v JOIN z USING (model_id), b",
)
def f21(spark: SparkSession, d: str) -> DataFrame:
    """A forest that is registered, loaded again and used."""
    rows, path = dataset(spark, d), shared_path(spark, "registry")
    trees = [[dict(zip(_NODE, n, strict=True)) for n in t] for t in TREES]
    saved = {"algorithm": "forest", "task": "binary", "names": list(NAMES), "importance": IMPORTANCE, "scales": learning.feature_scales(rows, NAMES), "baseline": rows.agg(F.avg("y")).first()[0], "trees": trees}
    learning.register(spark, path, "forest-0", "algorithm", "forest", datetime.datetime(2024, 1, 1), NAMES, {}, rows.count(), {}, "given", saved)
    found = learning.predict_saved(rows, learning.load_model(spark, path, "forest-0"))
    return found.select("model_id", *(F.get("votes", F.lit(i)).alias(f"vote_{i}") for i in range(2)), "raw", "p", *(F.round(f"from_{n}", 7).alias(f"from_{n}") for n in NAMES))


@query("f24_registered_linear", f"{linear_sql(600, 0.03, 0.001)} SELECT model_id, round(b + {' + '.join(f'w{i} * z{i}' for i in range(len(NAMES)))}, 6) AS raw FROM z, r WHERE k = 600")
def f24b(spark: SparkSession, d: str) -> DataFrame:
    """A linear model, trained, registered, loaded again and used on rows that are not standardised."""
    rows, path = dataset(spark, d), shared_path(spark, "registry")
    scales = learning.feature_scales(rows, NAMES)
    weights, bias = features.train_linear(learning.scaled(rows, scales), NAMES)
    learning.register(spark, path, "linear-0", "algorithm", "linear", datetime.datetime(2024, 1, 1), NAMES, {}, rows.count(), {}, "trained", learning.saved_linear("linear", weights, bias, scales))
    return learning.predict_saved(rows, learning.load_model(spark, path, "linear-0")).select("model_id", F.round("raw", 6).alias("raw"))


#: Weights that are not learned, for a prediction that SQL can follow.
FIXED, FIXED_BIAS = {"object_count": -0.25, "finding_count": 0.5}, 0.1


@query("f22_batch_predictions", f"{LABELLED_SQL} SELECT model_id, round(1 / (1 + exp(-(0.5 * finding_count - 0.25 * object_count + 0.1))), 9) AS probability, CAST(1 / (1 + exp(-(0.5 * finding_count - 0.25 * object_count + 0.1))) >= 0.5 AS INTEGER) AS p, -0.25 * object_count AS from_object_count, 0.5 * finding_count AS from_finding_count FROM f WHERE model_id % 3 = 1")
def f22(spark: SparkSession, d: str) -> DataFrame:
    f = featured(spark, d)
    found = learning.batch_predict(lambda rows: learning.predict_logistic(rows, FIXED, FIXED_BIAS), f, f.where("model_id % 3 = 1"))
    return found.withColumn("probability", F.round("probability", 9))


@query("f23_unlabelled_predictions", f"{LABELLED_SQL} SELECT f.model_id, CAST(1 / (1 + exp(-(0.5 * finding_count - 0.25 * object_count + 0.1))) >= 0.5 AS INTEGER) AS p FROM f JOIN lb USING (model_id) WHERE status NOT IN ('F', 'O')")
def f23(spark: SparkSession, d: str) -> DataFrame:
    predicted = learning.predict_logistic(featured(spark, d), FIXED, FIXED_BIAS).select("model_id", "p")
    return learning.evaluate(predicted, dataset(spark, d))[1]


@query("f24_registry")
def f24(spark: SparkSession, d: str) -> DataFrame:
    rows, path = dataset(spark, d), shared_path(spark, "registry")
    found, best = learning.search_configs(rows, NAMES, CANDIDATES[:2])
    n = rows.count()
    for i, f in enumerate(found):
        learning.register(spark, path, f"algorithm-{i}", "algorithm", f["algorithm"], datetime.datetime(2024, 1, 1 + i), NAMES, CANDIDATES[i], n, {"accuracy": round(f["accuracy"], 6)}, "search" if i == best else "candidate")
    return list_artifacts(learning.registry(spark, path, "algorithm"))
