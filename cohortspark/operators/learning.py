"""Models on cohort features (F4, F11, F13 to F17, F21, F22, F24): ``pyspark.ml`` where it has the model, aggregates of gradients where it has not.

Data sets are ``model_id``, features and ``y``. Only weights, centres and metrics,
whose number does not grow with the rows, reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.features import classification_metrics, holdout_split, predict_linear, regression_metrics, train_linear
from cohortspark.operators.tables import shared_path

#: Ranges of training parameters.
RANGES = {"iterations": (20, 5000), "rate": (1e-9, 2.0), "l2": (0.0, 10.0), "n_trees": (1, 200), "depth": (1, 12), "leaf": (1, 100)}
MOST_CANDIDATES = 12


def checked(**parameters: float) -> None:
    for name, value in parameters.items():
        low, high = RANGES[name]
        if not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")


def feature_matrix(dataset: DataFrame, names: tuple[str, ...], column: str = "x") -> DataFrame:
    """The features in order as one vector; a missing one is 0, a NaN an error."""
    return VectorAssembler(inputCols=list(names), outputCol=column, handleInvalid="error").transform(dataset.fillna(0.0, subset=list(names)))


def sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw))))


def train_logistic(rows: DataFrame, names: tuple[str, ...], iterations: int = 600, rate: float = 0.08, l2: float = 0.001, solver: str = "ml") -> tuple[dict[str, float], float]:
    """Weights and bias for standardised features; the bias is not penalised.

    ``ml`` is Spark's own solver. ``gd`` is plain gradient descent, each step one
    aggregate over the rows: as many jobs as iterations, for parity with it.
    """
    checked(iterations=iterations, rate=rate, l2=l2)
    if solver == "ml":
        model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=l2, standardization=False).fit(feature_matrix(rows, names))
        return dict(zip(names, map(float, model.coefficients), strict=True)), float(model.intercept)
    rows = rows.select(*names, "y").persist()
    weights, bias = dict.fromkeys(names, 0.0), 0.0
    try:
        for _ in range(iterations):
            error = sigmoid(sum((F.col(n) * w for n, w in weights.items()), F.lit(bias))) - F.col("y")
            step = rows.agg(F.avg(error).alias("bias"), *(F.avg(error * F.col(n)).alias(f"by_{n}") for n in names)).first()
            weights = {n: w - rate * (step[f"by_{n}"] + l2 * w) for n, w in weights.items()}
            bias -= rate * step["bias"]
    finally:
        rows.unpersist()
    return weights, bias


def predict_logistic(rows: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """``model_id, probability, p`` and what each feature contributes to the raw score."""
    scored = predict_linear(rows, weights, bias, classify=False)
    return scored.select("model_id", sigmoid(F.col("raw")).alias("probability"), (sigmoid(F.col("raw")) >= 0.5).cast("int").alias("p"), *(c for c in scored.columns if c.startswith("from_")))


def train_forest(rows: DataFrame, names: tuple[str, ...], task: str = "binary", n_trees: int = 32, depth: int = 6, leaf: int = 1, features: str = "sqrt", seed: int = 17):
    """A random forest of ``pyspark.ml`` on bootstrap samples, up to 64 thresholds a feature."""
    checked(n_trees=n_trees, depth=depth, leaf=leaf)
    kind = RandomForestClassifier if task == "binary" else RandomForestRegressor
    return kind(featuresCol="x", labelCol="y", numTrees=n_trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=features, maxBins=64, seed=seed).fit(feature_matrix(rows, names))


def forest_importance(model, names: tuple[str, ...]) -> dict[str, float]:
    """Share of each feature in the gain of all splits, weighted by their samples; sums to 1 where there is a split."""
    total = dict.fromkeys(names, 0.0)
    for tree in model.trees:
        open_ = [tree._call_java("rootNode")]
        while open_:
            node = open_.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                stats = node.impurityStats()
                total[names[node.split().featureIndex()]] += node.gain() * stats.count()
                open_ += [node.leftChild(), node.rightChild()]
    every = sum(total.values())
    return {n: v / every if every else 0.0 for n, v in total.items()}


def tree_votes(model, matrix: DataFrame, task: str = "binary") -> DataFrame:
    """``votes``: what each tree says of a row (its share of the class 1, or its value)."""
    votes = []
    for i, tree in enumerate(model.trees):
        tree = tree.copy()
        tree.setPredictionCol(f"tree_{i}")
        if task == "binary":
            tree.setRawPredictionCol(f"raw_{i}").setProbabilityCol(f"share_{i}")
        matrix = tree.transform(matrix)
        if task == "binary":
            matrix = matrix.withColumn(f"tree_{i}", F.get(vector_to_array(f"share_{i}"), F.lit(1))).drop(f"raw_{i}", f"share_{i}")
        votes.append(f"tree_{i}")
    return matrix.withColumn("votes", F.array(*votes)).drop(*votes)


def predict_forest(model, rows: DataFrame, names: tuple[str, ...], importance: dict[str, float], scales: dict[str, tuple[float, float]], baseline: float, task: str = "binary") -> DataFrame:
    """``model_id, raw`` (mean of the trees), ``p``, ``votes`` and ``from_<feature>``: importance times tanh of the standardised feature times what the raw score has over the baseline."""
    return explained(tree_votes(model, feature_matrix(rows, names), task), names, importance, scales, baseline, task)


def explained(voted: DataFrame, names: tuple[str, ...], importance: dict[str, float], scales: dict[str, tuple[float, float]], baseline: float, task: str) -> DataFrame:
    """Rows with ``votes`` as ``predict_forest`` gives them."""
    raw = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v) / F.size("votes")
    scored = voted.withColumn("raw", raw)
    z = {n: (F.col(n) - scales[n][0]) / scales[n][1] for n in names}
    own = [(F.lit(importance[n]) * F.tanh(z[n]) * (F.col("raw") - baseline)).alias(f"from_{n}") for n in names]
    decided = (F.col("raw") >= 0.5).cast("double") if task == "binary" else F.col("raw")
    return scored.select("model_id", "raw", decided.alias("p"), "votes", *own)


def feature_scales(rows: DataFrame, names: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a deviation below 1e-9 counts as 1."""
    got = rows.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    return {n: (got[f"m_{n}"], got[f"s_{n}"] if got[f"s_{n}"] >= 1e-9 else 1.0) for n in names}


def scaled(rows: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({n: (F.coalesce(F.col(n), F.lit(0.0)) - m) / s for n, (m, s) in scales.items()})


Predictor = Callable[[DataFrame], DataFrame]


def fit(rows: DataFrame, names: tuple[str, ...], algorithm: str, task: str = "binary", **parameters) -> Predictor:
    """A function from rows to ``model_id, p``, trained on ``rows``; scales are those of the training rows."""
    if algorithm == "forest":
        model = train_forest(rows, names, task, **parameters)
        return lambda new: model.transform(feature_matrix(new, names)).select("model_id", F.col("prediction").alias("p"))
    scales = feature_scales(rows, names)
    if algorithm == "logistic":
        weights, bias = train_logistic(scaled(rows, scales), names, **parameters)
        return lambda new: predict_logistic(scaled(new, scales), weights, bias).select("model_id", F.col("p").cast("double").alias("p"))
    if algorithm == "linear":
        weights, bias = train_linear(scaled(rows, scales), names, **parameters)
        return lambda new: predict_linear(scaled(new, scales), weights, bias, classify=False).select("model_id", F.col("raw").alias("p"))
    raise ValueError("algorithm must be forest, logistic or linear")


def metrics_of(predicted: DataFrame, rows: DataFrame, task: str) -> dict[str, float]:
    joined = predicted.join(rows.select("model_id", "y"), "model_id")
    return (classification_metrics if task == "binary" else regression_metrics)(joined).first().asDict()


def evaluate(predicted: DataFrame, labels: DataFrame, task: str = "binary") -> tuple[DataFrame, DataFrame]:
    """Metrics of predictions against labels (``model_id, y``), and the predictions without a label, each an error."""
    joined = predicted.join(labels.select("model_id", "y"), "model_id")
    return (classification_metrics if task == "binary" else regression_metrics)(joined), predicted.join(labels, "model_id", "left_anti")


def batch_predict(predictor: Predictor, features: DataFrame, wanted: DataFrame) -> DataFrame:
    """Predictions for the wanted models."""
    return predictor(features.join(wanted.select("model_id").distinct(), "model_id", "left_semi"))


def cross_validate(rows: DataFrame, names: tuple[str, ...], algorithm: str, task: str = "binary", fold: str = "fold", parallel: int = 2, **parameters) -> list[dict[str, float]]:
    """Metrics for each value of the column ``fold``, from a model trained on the other rows; then their mean, as fold -1."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("at least two folds are needed")

    def one(k: int) -> dict[str, float]:
        held = rows.where(F.col(fold) == k)
        return {"fold": k} | metrics_of(fit(rows.where(F.col(fold) != k), names, algorithm, task, **parameters)(held), held, task)

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(one, folds))
    mean = {m: sum(f[m] for f in found) / len(found) for m in found[0] if m != "fold"}
    return [*found, {"fold": -1} | mean]


def search_configs(rows: DataFrame, names: tuple[str, ...], candidates: list[dict], task: str = "binary", key: str = "model_id", parallel: int = 2) -> tuple[list[dict], int]:
    """Each candidate (``algorithm`` and its parameters) with its metrics on the last fifth of the rows, or where there is none on all; and the place of the first best one."""
    if not 0 < len(candidates) <= MOST_CANDIDATES:
        raise ValueError(f"1 to {MOST_CANDIDATES} candidates are needed")
    split = holdout_split(rows, key)
    train, held = split.where("not holdout"), split.where("holdout")
    if held.isEmpty() or (task == "binary" and train.select("y").distinct().count() < 2):
        train = held = rows

    def one(c: dict) -> dict:
        parameters = {k: v for k, v in c.items() if k != "algorithm"}
        return c | metrics_of(fit(train, names, c["algorithm"], task, **parameters)(held), held, task)

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(one, candidates))
    score = (lambda r: r["accuracy"]) if task == "binary" else (lambda r: -r["rmse"])
    best = max(range(len(found)), key=lambda i: (score(found[i]), -i))
    return found, best


def pca_project(rows: DataFrame, names: tuple[str, ...], components: int = 2) -> tuple[DataFrame, list[float]]:
    """``model_id, pc1, pc2...`` of standardised features, and the share of variance of each; the largest loading of a component is positive."""
    matrix = feature_matrix(scaled(rows, feature_scales(rows, names)), names)
    k = min(components, len(names))
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(matrix)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    at = vector_to_array("pc")
    own = [(F.get(at, F.lit(i)) * signs[i] if i < k else F.lit(0.0)).alias(f"pc{i + 1}") for i in range(components)]
    return model.transform(matrix).select("model_id", *own), list(map(float, model.explainedVariance))


#: Trees of a saved forest: each an array of nodes, its root first; a leaf has feature -1.
TREES = "array<array<struct<feature:int,threshold:double,left:int,right:int,value:double>>>"


def saved_linear(algorithm: str, weights: dict[str, float], bias: float, scales: dict[str, tuple[float, float]] | None = None) -> dict:
    """A ``linear`` or ``logistic`` model as plain values; ``scales`` are those of its training rows, none where rows come standardised."""
    return {"algorithm": algorithm, "weights": weights, "bias": bias, "scales": {n: list(s) for n, s in (scales or {}).items()}}


def saved_forest(model, names: tuple[str, ...], importance: dict[str, float], scales: dict[str, tuple[float, float]], baseline: float, task: str = "binary") -> dict:
    """A forest as plain values, from the node table that ``pyspark.ml`` writes. RANGES bound its size."""
    spark = SparkSession.active()
    path = shared_path(spark, "forest")
    model.write().save(path)
    at = lambda *c: F.col(".".join(("nodeData", *c)))
    shares = at("impurityStats")
    value = F.get(shares, F.lit(1)) / F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) if task == "binary" else at("prediction")
    node = F.struct(
        F.when(at("leftChild") >= 0, at("split", "featureIndex")).otherwise(-1).alias("feature"), F.get(at("split", "leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        at("leftChild").alias("left"), at("rightChild").alias("right"), value.alias("value"),
    )
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])
    trees = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(in_order(at("id"), node).alias("nodes"))
    found = trees.agg(F.to_json(in_order(F.col("treeID"), F.col("nodes"))).alias("trees")).first()[0]
    return {"algorithm": "forest", "task": task, "names": list(names), "importance": importance, "scales": {n: list(s) for n, s in scales.items()}, "baseline": baseline, "trees": json.loads(found)}


def saved_votes(trees: list, values: Column) -> Column:
    """What each tree says of an array of feature values: a walk from its root, as deep as RANGES allows."""

    def walk(tree: Column) -> Column:
        field = lambda at, name: F.get(tree, at)[name]
        step = lambda at, _: F.when(field(at, "feature") < 0, at).when(F.get(values, field(at, "feature")) <= field(at, "threshold"), field(at, "left")).otherwise(field(at, "right"))
        return field(F.aggregate(F.sequence(F.lit(1), F.lit(RANGES["depth"][1])), F.lit(0), step), "value")

    return F.transform(F.from_json(F.lit(json.dumps(trees)), TREES), walk)


def predict_saved(rows: DataFrame, saved: dict) -> DataFrame:
    """Predictions of a saved model: as ``predict_forest``, ``predict_logistic`` or ``predict_linear`` give them. A missing feature is 0."""
    if saved["algorithm"] == "forest":
        names = tuple(saved["names"])
        known = rows.fillna(0.0, subset=list(names))
        voted = known.withColumn("votes", saved_votes(saved["trees"], F.array(*(F.col(n).cast("double") for n in names))))
        return explained(voted, names, saved["importance"], saved["scales"], saved["baseline"], saved["task"])
    ready = scaled(rows, saved["scales"])
    if saved["algorithm"] == "logistic":
        return predict_logistic(ready, saved["weights"], saved["bias"])
    return predict_linear(ready, saved["weights"], saved["bias"], classify=False)


REGISTRY = "artifact_id string, kind string, name string, created_at timestamp, feature_schema string, parameters string, row_count long, metrics string, provenance string, model string"


def register(spark: SparkSession, path: str, artifact_id: str, kind: str, name: str, created_at, names: tuple[str, ...], parameters: dict, row_count: int, metrics: dict, provenance: str, model: dict | None = None) -> None:
    """Append one artifact to the registry, a Parquet table; ``model`` is what ``saved_linear`` or ``saved_forest`` gives."""
    row = (artifact_id, kind, name, created_at, json.dumps(list(names)), json.dumps(parameters, sort_keys=True), row_count, json.dumps(metrics, sort_keys=True), provenance, None if model is None else json.dumps(model))
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(path)


def registry(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Registered artifacts, of one kind or all."""
    found = spark.read.schema(REGISTRY).parquet(path)
    return found if kind is None else found.where(F.col("kind") == kind)


def load_model(spark: SparkSession, path: str, artifact_id: str) -> dict:
    """The saved model of the latest artifact of that id."""
    found = registry(spark, path).where((F.col("artifact_id") == artifact_id) & F.col("model").isNotNull()).orderBy(F.desc("created_at")).first()
    if found is None:
        raise ValueError(f"no saved model {artifact_id}")
    return json.loads(found["model"])
