"""Ingest and indexing of instance headers (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(compat: bool = False) -> Column:
    """Position along z, then instance number (as text if ``compat``), then path."""
    number = F.col("instance_number").cast("string") if compat else F.col("instance_number")
    return F.struct(F.coalesce("z", F.lit(0.0)).alias("z"), number.alias("number"), F.col("path").alias("path"))


def study_modality() -> Column:
    """First modality that is no segmentation, else the first."""
    return F.coalesce(F.min_by(F.when(F.col("modality") != "SEG", F.col("modality")), F.when(F.col("modality") != "SEG", F.col("path"))), F.min_by("modality", "path"))


def index_studies(instances: DataFrame) -> DataFrame:
    """A row for each study: counts, modality, first path. Rows without a study uid are left out."""
    named = instances.where(F.col("study_uid").isNotNull())
    return named.groupBy("study_uid").agg(F.count_distinct("series_uid").alias("series_count"), F.count(F.lit(1)).alias("image_count"), study_modality().alias("modality"), F.min("path").alias("first_path"))


def index_series(instances: DataFrame) -> DataFrame:
    """A row for each series (missing uid: ``unknown``), attributes of its first instance."""
    uid = F.coalesce("series_uid", F.lit("unknown")).alias("series_uid")
    return instances.groupBy("study_uid", uid).agg(F.min_by("modality", order_key()).alias("modality"), F.count(F.lit(1)).alias("instance_count"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.coalesce(F.nullif(F.min_by("price", order_key()), F.lit(0.0)), F.lit(1.0)).alias("thickness"))


def instance_order(instances: DataFrame, compat: bool = False) -> DataFrame:
    place = Window.partitionBy("series_uid").orderBy(order_key(compat))
    return instances.select("series_uid", "sop_uid", "path", F.row_number().over(place).alias("place"))


def primary_series(series: DataFrame) -> DataFrame:
    """The largest series of each study that can be shown; ties to the first uid."""
    first = Window.partitionBy("study_uid").orderBy(F.desc("instance_count"), "series_uid")
    return series.where(~F.col("modality").isin("SEG", "SR")).withColumn("n", F.row_number().over(first)).where("n = 1").select("study_uid", "series_uid", "instance_count")


def drop_derived(instances: DataFrame) -> DataFrame:
    """Series counts without instances below ``derived/``; series left empty vanish."""
    return instances.where(~F.col("path").startswith("derived/")).groupBy("study_uid", "series_uid").agg(F.count(F.lit(1)).alias("instance_count"))


def pending_imports(catalog: DataFrame, present: DataFrame) -> DataFrame:
    return catalog.join(present, "study_uid", "left_anti")


def dedupe_instances(instances: DataFrame) -> DataFrame:
    """Of each study and SOP uid the first arrival."""
    first = Window.partitionBy("study_uid", "sop_uid").orderBy("arrived_at", "path", "price")
    return instances.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def list_catalog(instances: DataFrame, level: str) -> DataFrame:
    """A header row for each study, series or instance, the first by path."""
    keys = {"studies": ["study_uid"], "series": ["study_uid", "series_uid"], "instances": ["study_uid", "series_uid", "sop_uid"]}[level]
    return instances.groupBy(*keys).agg(F.min_by("modality", F.struct("path", "price")).alias("modality"), F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
