"""Models on small data sets, against plain numpy."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import features, learning

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(120, 3))
    return x, (x @ [2.0, -1.0, 0.0] + 0.3 * rnd.normal(size=120) > 0).astype(float)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "model_id long, a double, b double, c double, y double").repartition(3).persist()


def test_descent_is_that_of_numpy(rows, data):
    x, y = data
    w, b = np.zeros(3), 0.0
    for _ in range(20):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.08 * (x.T @ e / len(y) + 0.001 * w), b - 0.08 * e.mean()
    weights, bias = learning.train_logistic(rows, NAMES, iterations=20, solver="gd")
    assert np.allclose(list(weights.values()), w) and bias == pytest.approx(b)


def test_logistic_predicts(rows):
    weights, bias = learning.train_logistic(rows, NAMES)
    found = learning.predict_logistic(rows, weights, bias)
    assert learning.metrics_of(found.select("model_id", "p"), rows, "binary")["accuracy"] > 0.9
    r = found.first()
    assert r["p"] == int(r["probability"] >= 0.5)
    with pytest.raises(ValueError, match="iterations"):
        learning.train_logistic(rows, NAMES, iterations=3)


def test_forest_votes_importance_and_prediction(rows):
    model = learning.train_forest(rows, NAMES, n_trees=6, depth=4)
    importance = learning.forest_importance(model, NAMES)
    assert sum(importance.values()) == pytest.approx(1) and max(importance, key=importance.get) == "a"
    scales = learning.feature_scales(rows, NAMES)
    found = learning.predict_forest(model, rows, NAMES, importance, scales, 0.5).collect()
    values = {r["model_id"]: r for r in rows.collect()}
    for r in found:
        assert r["raw"] == pytest.approx(np.mean(r["votes"])) and len(r["votes"]) == 6
        z = (values[r["model_id"]]["a"] - scales["a"][0]) / scales["a"][1]
        assert r["from_a"] == pytest.approx(importance["a"] * np.tanh(z) * (r["raw"] - 0.5))
    regression = learning.train_forest(rows, NAMES, "regression", n_trees=4, depth=3)
    got = learning.predict_forest(regression, rows, NAMES, importance, scales, 0.5, "regression")
    assert got.where(F.abs(F.col("raw") - F.col("p")) > 1e-9).isEmpty()


def test_folds_train_and_validate(rows):
    folded = features.fold_numbers(rows, 3, key="model_id")
    found = learning.cross_validate(folded, NAMES, "logistic", iterations=50)
    assert [f["fold"] for f in found] == [0, 1, 2, -1]
    assert sum(f["tp"] + f["tn"] + f["fp"] + f["fn"] for f in found[:3]) == 120
    assert found[3]["accuracy"] == pytest.approx(np.mean([f["accuracy"] for f in found[:3]])) and found[3]["accuracy"] > 0.85


def test_search_takes_the_first_best(rows):
    found, best = learning.search_configs(rows, NAMES, [{"algorithm": "logistic", "iterations": 20, "l2": 10.0}, {"algorithm": "logistic"}, {"algorithm": "logistic"}])
    scores = [f["accuracy"] for f in found]
    assert best == scores.index(max(scores)) and sum(found[0][k] for k in ("tp", "tn", "fp", "fn")) == 24
    found, best = learning.search_configs(rows, NAMES, [{"algorithm": "linear"}, {"algorithm": "forest", "n_trees": 4, "depth": 2}], "regression")
    assert best == min(range(2), key=lambda i: found[i]["rmse"])
    with pytest.raises(ValueError, match="1 to 12"):
        learning.search_configs(rows, NAMES, [{"algorithm": "linear"}] * 13)


def test_projection_is_that_of_a_singular_value_decomposition(rows, data):
    x, _ = data
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    v = v[:2] * np.sign(v[:2][np.arange(2), abs(v[:2]).argmax(axis=1)])[:, None]
    found, shares = learning.pca_project(rows, NAMES)
    got = np.array([[r["pc1"], r["pc2"]] for r in sorted(found.collect())])
    assert np.allclose(got, z @ v.T) and np.allclose(shares, s[:2] ** 2 / (s**2).sum())
    one, _ = learning.pca_project(rows, ("a",))
    assert one.where("pc2 <> 0").isEmpty()


def test_holdout_is_the_last_fifth(spark):
    for n, keys in ((4, range(4)), (5, range(5)), (37, range(0, 37 * 10**6, 10**6)), (100, range(100))):
        rows = spark.createDataFrame([(int(k), 1.0) for k in list(keys)[:n]], "model_id long, y double")
        held = sorted(r["model_id"] for r in features.holdout_split(rows).where("holdout").collect())
        assert held == (list(keys)[n - max(1, n // 5) : n] if n >= 5 else [])


def test_evaluation_registry_and_batches(spark, rows, tmp_path):
    predicted = rows.select("model_id", F.col("y").alias("p"))
    metrics, missing = learning.evaluate(predicted, rows.where("model_id < 100"))
    assert metrics.first()["accuracy"] == 1.0 and missing.count() == 20
    assert learning.batch_predict(lambda r: r.select("model_id", F.lit(1).alias("p")), rows, rows.where("model_id in (3, 5)")).count() == 2
    path = str(tmp_path / "registry")
    for i, kind in enumerate(("algorithm", "dataset")):
        learning.register(spark, path, f"x{i}", kind, "name", datetime.datetime(2024, 1, 1), NAMES, {"l2": 0.1}, 120, {"accuracy": 1.0}, "test")
    assert [r["artifact_id"] for r in learning.registry(spark, path, "dataset").collect()] == ["x1"]


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_saved_forest_predicts_as_its_model(spark, rows, tmp_path, task):
    model = learning.train_forest(rows, NAMES, task, n_trees=5, depth=5)
    importance, scales = learning.forest_importance(model, NAMES), learning.feature_scales(rows, NAMES)
    path = str(tmp_path / "registry")
    saved = learning.saved_forest(model, NAMES, importance, scales, 0.5, task)
    learning.register(spark, path, "f", "algorithm", "forest", datetime.datetime(2024, 1, 1), NAMES, {}, 120, {}, "test", saved)
    gaps = rows.withColumn("b", F.when(F.col("model_id") % 7 > 0, F.col("b")))
    want = sorted(learning.predict_forest(model, gaps, NAMES, importance, scales, 0.5, task).select("model_id", "votes", "raw", "p").collect())
    got = sorted(learning.predict_saved(gaps, learning.load_model(spark, path, "f")).select("model_id", "votes", "raw", "p").collect())
    assert len(got) == 120
    for g, w in zip(got, want, strict=True):
        assert g["model_id"] == w["model_id"] and g["votes"] == pytest.approx(w["votes"]) and g["raw"] == pytest.approx(w["raw"]) and g["p"] == pytest.approx(w["p"])


def test_saved_logistic_and_the_latest_of_an_id(spark, rows, tmp_path):
    scales = learning.feature_scales(rows, NAMES)
    weights, bias = learning.train_logistic(learning.scaled(rows, scales), NAMES, iterations=30)
    path = str(tmp_path / "registry")
    for day, b in ((2, bias), (1, 99.0)):
        learning.register(spark, path, "m", "algorithm", "logistic", datetime.datetime(2024, 1, day), NAMES, {}, 120, {}, "test", learning.saved_linear("logistic", weights, b, scales))
    learning.register(spark, path, "m", "algorithm", "logistic", datetime.datetime(2024, 1, 3), NAMES, {}, 120, {}, "without a model")
    want = sorted(learning.predict_logistic(learning.scaled(rows, scales), weights, bias).collect())
    assert sorted(learning.predict_saved(rows, learning.load_model(spark, path, "m")).collect()) == want
    with pytest.raises(ValueError, match="no saved model"):
        learning.load_model(spark, path, "n")


def test_given_centres_and_summary(spark):
    points = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5), 0.0]) for i in range(10)], "id long, v array<double>")
    found, centres = features.kmeans(points, 2, dims=2, centres=[[0.0, 0.0], [1.0, 0.0]])
    assert centres == [[2.0, 0.0], [12.0, 0.0]]
    got = sorted(map(tuple, features.cluster_summary(features.anomaly_rank(found)).collect()))
    assert got == [(0, 5, pytest.approx(0.6), 1.0, 0), (1, 5, pytest.approx(0.6), 1.0, 5)]
