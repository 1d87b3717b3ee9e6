"""Cohort features, data sets, splits and metrics (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one block; blocks of one group.
BLOCK = 4096
FEATURES = ("object_count", "anatomy_count", "finding_count", "region_count", "confirmed_count", "total_volume", "largest_volume", "finding_volume")


def extract_features(objects: DataFrame) -> DataFrame:
    """One row of FEATURES for each model; sums of nothing are 0."""
    kind = lambda *k: F.count_if(F.col("obj_type").isin(*k)).cast("double")
    return objects.groupBy("model_id").agg(
        F.count(F.lit(1)).cast("double").alias("object_count"), kind("anatomy").alias("anatomy_count"), kind("finding", "lesion").alias("finding_count"), kind("region").alias("region_count"),
        F.count_if(F.col("review_status") == "confirmed").cast("double").alias("confirmed_count"), F.coalesce(F.sum("volume_mm3"), F.lit(0.0)).alias("total_volume"), F.coalesce(F.max("volume_mm3"), F.lit(0.0)).alias("largest_volume"),
        F.coalesce(F.sum(F.when(F.col("obj_type").isin("finding", "lesion"), F.col("volume_mm3"))), F.lit(0.0)).alias("finding_volume"),
    )


def graph_features(edges: DataFrame) -> DataFrame:
    return edges.groupBy("model_id").agg(F.count(F.lit(1)).cast("double").alias("relationship_count"), F.count_if(F.col("type") == "contains").cast("double").alias("containment_count"))


#: All features of a model, in order. Fixed values.
ALL_FEATURES = (
    "object_count", "anatomy_count", "finding_count", "region_count", "relationship_count", "context_binding_count", "temporal_link_count", "mesh_count", "confirmed_object_count", "total_volume_mm3",
    "largest_object_volume_mm3", "mean_temporal_volume_change_percent", "source_series_count", "source_instance_count", "source_mean_intensity", "source_min_intensity", "source_max_intensity", "source_frame_mean_variability", "finding_volume_mm3",
)


def cohort_features(objects: DataFrame, edges: DataFrame, bindings: DataFrame, links: DataFrame, frames: DataFrame) -> DataFrame:
    """``model_id`` and ALL_FEATURES, 0 where a model has nothing to count; ``frames`` are ``model_id, series, mean, least, most``.

    Each child table is added up by model first, so the joins meet a row for each model.
    """
    kind = lambda *k: F.col("obj_type").isin(*k)
    volume = lambda when, f: f(F.when(when, F.col("volume_mm3")))
    every = F.lit(True)
    own = objects.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("object_count"), F.count_if(kind("anatomy")).alias("anatomy_count"), F.count_if(kind("finding", "lesion")).alias("finding_count"), F.count_if(kind("region")).alias("region_count"),
        F.count("mesh_id").alias("mesh_count"), F.count_if(F.col("review_status") == "confirmed").alias("confirmed_object_count"), volume(every, F.sum).alias("total_volume_mm3"), volume(every, F.max).alias("largest_object_volume_mm3"), volume(kind("finding", "lesion"), F.sum).alias("finding_volume_mm3"),
    )
    counted = lambda rows, name: rows.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))
    changed = links.groupBy("model_id").agg(F.count(F.lit(1)).alias("temporal_link_count"), F.avg("volume_percent").alias("mean_temporal_volume_change_percent"))
    seen = frames.groupBy("model_id").agg(
        F.count_distinct("series").alias("source_series_count"), F.count(F.lit(1)).alias("source_instance_count"), F.avg("mean").alias("source_mean_intensity"), F.min("least").alias("source_min_intensity"), F.max("most").alias("source_max_intensity"), F.stddev_pop("mean").alias("source_frame_mean_variability"),
    )
    for part in (counted(edges, "relationship_count"), counted(bindings, "context_binding_count"), changed, seen):
        own = own.join(part, "model_id", "left")
    return own.select("model_id", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in ALL_FEATURES))


def coerce_label(label: Column, task: str) -> Column:
    """Binary 0 or 1, or a finite number; null for anything else."""
    if task == "binary":
        text = F.lower(F.trim(label.cast("string")))
        return F.when(text.isin("1", "1.0", "true", "yes", "positive"), 1.0).when(text.isin("0", "0.0", "false", "no", "negative"), 0.0)
    number = label.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.round(number, 8))


def build_dataset(features: DataFrame, labels: DataFrame, task: str = "binary") -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and rejects with a reason: unknown model, unreadable or repeated label."""
    read = labels.withColumns({"y": coerce_label(F.col("label"), task), "times": F.count(F.lit(1)).over(Window.partitionBy("model_id"))})
    joined = read.join(features.withColumn("known", F.lit(True)), "model_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown model").when(F.col("times") > 1, "repeated").when(F.col("y").isNull(), "unreadable")
    marked = joined.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason", "known", "times", "label"), marked.where("reason is not null").select("model_id", "label", "reason")


def summarize(dataset: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Mean, population deviation, least, largest and zeros of each feature, in one pass over the rows."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    long = dataset.selectExpr(f"stack({len(names)}, {pairs}) as (feature, value)")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count_if(F.abs("value") <= 1e-8).alias("zeros"))


def feature_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Standardised mean difference of two summaries; flagged from 0.5 on."""
    b = baseline.select("feature", F.col("mean").alias("b_mean"), F.col("std").alias("b_std"))
    pooled = F.sqrt((F.col("std") * F.col("std") + F.col("b_std") * F.col("b_std")) / 2)
    delta = F.col("mean") - F.col("b_mean")
    smd = F.when(pooled > 1e-12, delta / pooled).when(F.abs(delta) <= 1e-12, 0.0).otherwise(1.0)
    return current.join(b, "feature").select("feature", smd.alias("smd"), (F.abs(smd) >= 0.5).alias("flagged"))


def standardize(dataset: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(x - mean) / population deviation; a deviation below 1e-9 counts as 1. The statistics are one row."""
    stats = dataset.agg(*(F.avg(n).alias(f"{n}_m") for n in names), *(F.stddev_pop(n).alias(f"{n}_s") for n in names))
    scaled = ((F.col(n) - F.col(f"{n}_m")) / F.when(F.col(f"{n}_s") < 1e-9, 1.0).otherwise(F.col(f"{n}_s")) for n in names)
    others = [c for c in dataset.columns if c not in names]
    return dataset.crossJoin(F.broadcast(stats)).select(*others, *(s.alias(n) for s, n in zip(scaled, names, strict=True)))


def holdout_split(dataset: DataFrame, key: str = "model_id") -> DataFrame:
    """``holdout``: the last fifth of the rows by key, none below five rows; rows of one key stay together, at the end of the training rows. Keys are counted by block first, then those of the block where the fifth begins, so no rows meet in one task."""
    n = dataset.count()
    if n < 5:
        return dataset.withColumn("holdout", F.lit(False))
    block = F.floor(F.col(key) / F.lit(BLOCK))
    sizes = dataset.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy(F.floor(F.col("block") / F.lit(BLOCK)).alias("group")).agg(F.sum("n").alias("n"))
    first, left = None, max(1, n // 5)
    for counts, part, inside in ((groups, "group", F.lit(True)), (sizes, "block", None), (dataset.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, None)):
        if inside is None:
            inside = F.floor(F.col(part) / F.lit(BLOCK)) == F.lit(first)
        rows = counts.where(inside).withColumn("after", F.sum("n").over(Window.orderBy(F.desc(part))))
        found = rows.where(F.col("after") >= left).orderBy(F.desc(part)).select(part, (F.col("after") - F.col("n")).alias("beyond")).first()
        first, left = found[0], left - found[1]
    return dataset.withColumn("holdout", F.col(key) >= first)


def fold_numbers(dataset: DataFrame, folds: int, key: str = "model_id", label: str = "y") -> DataFrame:
    """Round-robin folds by class in order of key. Ranks are counted by block of keys first, so a large class is not sorted in one task."""
    placed = dataset.withColumn("block", F.floor(F.col(key) / F.lit(BLOCK)))
    counts = placed.groupBy(label, "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(label).orderBy("block")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy(label, "block").orderBy(key))
    return placed.withColumn("rank", rank).join(before, [label, "block"]).withColumn("fold", ((F.col("before") + F.col("rank") - 1) % folds).cast("int")).drop("block", "rank", "before")


def classification_metrics(scored: DataFrame) -> DataFrame:
    """Of ``y, p``: counts and rates; denominators of at least 1."""
    c = scored.agg(F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"))
    at_least = lambda x: F.greatest(x, F.lit(1))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return c.select("*", ((F.col("tp") + F.col("tn")) / at_least(n)).alias("accuracy"), (F.col("tp") / at_least(F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / at_least(F.col("tp") + F.col("fn"))).alias("recall"))


def regression_metrics(scored: DataFrame) -> DataFrame:
    """Of ``y, p``: mse, rmse, mae and r2 (0 where y does not vary)."""
    error = F.col("y") - F.col("p")
    m = scored.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("y").alias("variance"))
    return m.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("variance") > 1e-12, 1 - F.col("mse") / F.col("variance")).otherwise(0.0).alias("r2"))


def predict_linear(rows: DataFrame, weights: dict[str, float], bias: float, classify: bool = True) -> DataFrame:
    """Raw score, and class by sigmoid >= 0.5, with each feature's contribution."""
    parts = {n: F.col(n) * w for n, w in weights.items()}
    raw = sum(parts.values(), F.lit(bias))
    out = rows.select("model_id", raw.alias("raw"), *(c.alias(f"from_{n}") for n, c in parts.items()))
    return out.withColumn("p", F.when(1 / (1 + F.exp(-F.col("raw"))) >= 0.5, 1).otherwise(0)) if classify else out


def train_linear(rows: DataFrame, names: tuple[str, ...], iterations: int = 600, rate: float = 0.03, l2: float = 0.001) -> tuple[dict[str, float], float]:
    """Gradient descent on squared error of standardised features. The gradient needs only sums of products: one Spark aggregate, then steps on a small matrix."""
    import numpy as np

    every = [*names, "y"]
    cells = [(i, j) for i in range(len(every)) for j in range(i + 1)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(every[i]) * F.col(every[j])).alias(f"s{i}_{j}") for i, j in cells), *(F.sum(c).alias(f"t{k}") for k, c in enumerate(every))).first()
    n, p = got["n"], len(names)
    gram = np.zeros((p + 1, p + 1))
    for i, j in cells:
        gram[i, j] = gram[j, i] = got[f"s{i}_{j}"]
    sums = np.array([got[f"t{k}"] for k in range(p + 1)])
    w, b = np.zeros(p), sums[p] / n
    for _ in range(iterations):
        w_step = (gram[:p, :p] @ w + sums[:p] * b - gram[:p, p]) / n + l2 * w
        b_step = (sums[:p] @ w + n * b - sums[p]) / n
        w, b = w - rate * w_step, b - rate * b_step
    return dict(zip(names, w.tolist(), strict=True)), float(b)


def kmeans(vectors: DataFrame, k: int, seed: int = 17, iterations: int = 60, dims: int = 64, centres: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's steps on ``id, v`` (array) from given centres or the k rows with the smallest hash; an empty cluster keeps its centre. Only k centres reach the driver."""
    centres = centres or [list(map(float, r["v"])) for r in vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()]

    def assigned() -> DataFrame:
        gaps = F.array(*(F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres))
        return vectors.withColumn("gaps", gaps).select("id", "v", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int").alias("cluster"), F.sqrt(F.array_min("gaps")).alias("distance"))

    for _ in range(iterations):
        new = assigned().groupBy("cluster").agg(*(F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dims))).collect()
        moved = list(centres)
        for r in new:
            moved[r["cluster"]] = [r[f"m{i}"] for i in range(dims)]
        still = all(abs(a - b) < 1e-12 for x, y in zip(moved, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = moved
        if still:
            break
    return assigned(), centres


def anomaly_rank(assigned: DataFrame) -> DataFrame:
    """Distance to the own centre as a share of the largest."""
    most = assigned.agg(F.max("distance").alias("most"))
    return assigned.crossJoin(F.broadcast(most)).select("id", "cluster", "distance", F.when(F.col("most") > 0, F.col("distance") / F.col("most")).otherwise(0.0).alias("score"))


def cluster_summary(ranked: DataFrame) -> DataFrame:
    """For each cluster of ``anomaly_rank`` its size, mean and largest score, and the row that is farthest out (ties: the smallest id)."""
    farthest = F.max_by("id", F.struct("score", (-F.col("id")).alias("id")))
    return ranked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("largest_score"), farthest.alias("farthest"))
