"""Audit trail, revisions and latest states (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVIEWS = ("confirmed", "modified", "rejected")


AUDIT = "event_id long, created_at timestamp_ntz, type string, subject long, detail string, day date"


def append_audit(events: DataFrame, path: str) -> None:
    """Append ``event_id, created_at, type, subject, detail`` to the audit trail, a Parquet table by day; what stands there is never written again."""
    events.withColumn("day", F.to_date("created_at")).write.partitionBy("day").mode("append").parquet(path)


def audit_trail(spark: SparkSession, path: str) -> DataFrame:
    """All events of the trail; a filter on ``day`` reads only those days."""
    return spark.read.schema(AUDIT).parquet(path)


def read_audit(events: DataFrame, subject: DataFrame | None = None, limit: int = 100, compat: bool = False) -> DataFrame:
    """Newest first, 1 to 500 rows; filtered by subject before the limit, or after it if ``compat``."""
    n = max(1, min(500, limit))
    newest = lambda e: e.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)
    if subject is None:
        return newest(events)
    return newest(events).join(subject, "subject", "left_semi") if compat else newest(events.join(subject, "subject", "left_semi"))


def append_revision(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of ``new`` (``model_id, payload``) that get the version after their model's last."""
    last = revisions.groupBy("model_id").agg(F.max("version").alias("last"))
    return new.join(last, "model_id", "left").select("model_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "payload")


def first_writes(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """Of ``new`` (``model_id, version``...) what is not there yet; a version is never overwritten."""
    return new.join(revisions, ["model_id", "version"], "left_anti")


def history(revisions: DataFrame) -> DataFrame:
    current = F.max("version").over(Window.partitionBy("model_id"))
    return revisions.select("model_id", "version", "created_at", (F.col("version") == current).alias("current"))


def as_of_version(revisions: DataFrame, version: int) -> DataFrame:
    return revisions.where(F.col("version") == version)


def apply_reviews(objects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Objects with the status of their review, where that is one of REVIEWS."""
    valid = reviews.where(F.col("status").isin(*REVIEWS)).select("model_id", "object_id", "status")
    return objects.join(valid, ["model_id", "object_id"], "left").withColumn("review_status", F.coalesce("status", "review_status")).drop("status")


def latest_state(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("last")
    return rows.groupBy(key).agg(last).select(key, "last.*")


def fail_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that were queued or running when the service stopped are failed, with a message."""
    stopped = F.col("status").isin("queued", "running")
    return jobs.withColumns({"message": F.when(stopped, F.lit("interrupted by restart")).otherwise(F.col("message")), "status": F.when(stopped, F.lit("failed")).otherwise(F.col("status"))})


def stage_progress(updates: DataFrame) -> DataFrame:
    """Each job's stages with their seconds until the next."""
    order = Window.partitionBy("job_id").orderBy("updated_at", "event_id")
    return updates.select("job_id", "event_id", "stage", F.row_number().over(order).alias("step"), (F.unix_timestamp(F.lead("updated_at").over(order).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))).alias("seconds"))


def capability_summary(features: DataFrame) -> DataFrame:
    """available, partial or not_configured, from what a model has."""
    state = lambda full, some: F.when(full, "available").when(some, "partial").otherwise("not_configured")
    return features.select("model_id", state(F.col("finding_count") > 0, F.col("object_count") > 0).alias("findings"), state(F.col("confirmed_count") == F.col("object_count"), F.col("confirmed_count") > 0).alias("review"))
