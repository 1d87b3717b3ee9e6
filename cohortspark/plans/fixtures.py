"""Views derived from the star-schema tables: the tables of the operators, at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.operators.tables import dealt_table

#: Lines of which one task makes the voxels, on average.
LINES_A_TASK = 50_000
#: Objects of which one task has the models, on average.
OBJECTS_A_TASK = 100_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def object_tasks(spark: SparkSession, d: str, a_task: int | None = None) -> int:
    """How many tasks objects are dealt to, ``a_task`` to each on average."""
    return max(8, -(-table(spark, d, "lineitem").count() // (a_task or OBJECTS_A_TASK)))


def objects(spark: SparkSession, d: str, a_task: int | None = None, key: str = "long") -> DataFrame:
    """Patient = customer, model = order, object = line item; ``key`` is the type of models' ids. They come dealt out by model, so many a task whatever the size, and what meets or is grouped within a model stays where it is."""
    lines, orders, parts = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    in_model = Window.partitionBy("model_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    lines, orders = (t.withColumn(c, F.col(c).cast(key)) for t, c in ((lines, "l_orderkey"), (orders, "o_orderkey")))
    o = lines.withColumnRenamed("l_orderkey", "model_id").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    o = o.repartition(object_tasks(spark, d, a_task), "model_id").join(orders, F.col("model_id") == F.col("o_orderkey"))
    o = o.select(
        F.col("o_custkey").alias("patient_id"), "model_id", F.col("o_orderdate").alias("study_date"), F.row_number().over(in_model).alias("obj_seq"), F.col("p_type").alias("label"),
        F.when(F.col("l_returnflag") == "R", "finding").when(F.col("l_returnflag") == "A", "anatomy").otherwise("region").alias("obj_type"),
        F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("unreviewed").alias("review_status"),
        (F.col("l_partkey") % 100).cast("double").alias("cx"), (F.col("l_suppkey") % 100).cast("double").alias("cy"), (F.col("l_linenumber") * F.lit(20.0)).alias("cz"),
        (F.col("l_quantity") / 2).alias("hx"), (F.col("p_size").cast("double") / 2).alias("hy"), (F.col("l_quantity") / 2).alias("hz"), (F.col("l_extendedprice") / 10).alias("volume_mm3"),
    )
    boxes = {f"{x}{i}": F.col(f"c{x}") + (-1 if i == 0 else 1) * F.col(f"h{x}") for x in "xyz" for i in (0, 1)}
    area = 2 * (4 * F.col("hx") * F.col("hy") + 4 * F.col("hx") * F.col("hz") + 4 * F.col("hy") * F.col("hz"))
    return o.withColumns(boxes | {"surface_area_mm2": area, "object_id": F.concat_ws(":", "model_id", "obj_seq")}).drop("hx", "hy", "hz")


def whole_objects(spark: SparkSession, d: str, a_task: int | None = None) -> DataFrame:
    """``objects`` for a query that uses them many times: they pass through one grouping by model with all their columns, so every use reads the same exchange and not one of its own with fewer columns."""
    o = objects(spark, d, a_task)
    return o.groupBy("model_id").agg(F.collect_list(F.struct(*(c for c in o.columns if c != "model_id"))).alias("all")).select("model_id", F.inline("all"))


def dealt_objects(spark: SparkSession, d: str, a_task: int | None = None, key: str = "long") -> DataFrame:
    """``objects`` written once in buckets of models, for a query that uses them many times: nothing that meets or is grouped within a model is dealt out again, and no use makes them anew."""
    return dealt_table(objects(spark, d, a_task, key), "model_id", object_tasks(spark, d, a_task))


OBJECTS_SQL = """
o AS (
  SELECT *, concat(model_id, ':', obj_seq) AS object_id, cx-hx AS x0, cy-hy AS y0, cz-hz AS z0, cx+hx AS x1, cy+hy AS y1, cz+hz AS z1, 2*(4*hx*hy+4*hx*hz+4*hy*hz) AS surface_area_mm2 FROM (
  SELECT o.o_custkey AS patient_id, l.l_orderkey AS model_id, o.o_orderdate AS study_date,
    CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax, l.l_shipdate) AS INTEGER) AS obj_seq,
    p.p_type AS label,
    CASE l.l_returnflag WHEN 'R' THEN 'finding' WHEN 'A' THEN 'anatomy' ELSE 'region' END AS obj_type,
    CASE l.l_linestatus WHEN 'F' THEN 'confirmed' ELSE 'unreviewed' END AS review_status,
    CAST(l.l_partkey % 100 AS DOUBLE) AS cx, CAST(l.l_suppkey % 100 AS DOUBLE) AS cy, l.l_linenumber * 20.0::DOUBLE AS cz,
    l.l_quantity / 2 AS hx, CAST(p.p_size AS DOUBLE) / 2 AS hy, l.l_quantity / 2 AS hz, l.l_extendedprice / 10 AS volume_mm3
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey))
"""


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """A volume for each order; in each frame (line number) runs of voxels for its line items. Lines are dealt by order before they become runs, so what is then grouped within a volume stays where it is."""
    l = table(spark, d, "lineitem")  # noqa: E741
    l = l.repartition(max(8, -(-l.count() // LINES_A_TASK)), "l_orderkey")  # noqa: E741
    run = F.explode(F.sequence(F.lit(0), (F.col("l_quantity") % 6).cast("int"))).alias("i")
    rows = l.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("int").alias("frame"), (F.col("l_suppkey") % 6).cast("int").alias("y"), (F.col("l_partkey") % 12).cast("int").alias("start"), (F.col("l_extendedprice") / 1000).alias("price"), run)
    return rows.groupBy("series", "frame", "y", (F.col("start") + F.col("i")).alias("x")).agg(F.max(F.col("price") + F.col("i")).cast("double").alias("v"))


VOXELS_SQL = "vx AS (SELECT l_orderkey AS series, CAST(l_linenumber AS INTEGER) AS frame, CAST(l_suppkey % 6 AS INTEGER) AS y, CAST(l_partkey % 12 + i AS INTEGER) AS x, CAST(max(l_extendedprice / 1000 + i) AS DOUBLE) AS v FROM lineitem, range(6) r(i) WHERE i <= CAST(l_quantity AS INTEGER) % 6 GROUP BY ALL)"
#: The volume that holds all places of ``voxels``, as x, y and frame.
SHAPE = (17, 6, 8)


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Header rows: one for each line item; repeated ``sop_uid`` are intended."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("study_uid"), F.concat_ws(".", "l_orderkey", F.col("l_suppkey") % 3).alias("series_uid"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("sop_uid"),
        F.when(F.col("l_returnflag") == "A", "CT").when(F.col("l_returnflag") == "R", "MR").otherwise("SEG").alias("modality"), (F.col("l_linenumber") * F.lit(20.0)).alias("z"), F.col("l_linenumber").alias("instance_number"),
        F.concat_ws("/", F.when(F.col("l_linestatus") == "F", "derived").otherwise("raw"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.col("l_shipdate").alias("arrived_at"), F.col("l_extendedprice").alias("price"),
    )


INSTANCES_SQL = """
inst AS (SELECT l_orderkey AS study_uid, concat(l_orderkey, '.', l_suppkey % 3) AS series_uid, concat(l_orderkey, '.', l_linenumber) AS sop_uid,
  CASE l_returnflag WHEN 'A' THEN 'CT' WHEN 'R' THEN 'MR' ELSE 'SEG' END AS modality, l_linenumber * 20.0::DOUBLE AS z, l_linenumber AS instance_number,
  concat(CASE l_linestatus WHEN 'F' THEN 'derived' ELSE 'raw' END, '/', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) AS path, l_shipdate AS arrived_at, l_extendedprice AS price FROM lineitem)
"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Two arms by user, an experiment for each event type."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("participant_id"), (F.col("user_id") % 2).cast("int").alias("arm"), F.col("event_type").alias("experiment"), "value", (F.col("value") > 50).alias("success"), "ts", "event_id")


OUTCOMES_SQL = "oc AS (SELECT user_id AS participant_id, CAST(user_id % 2 AS INTEGER) AS arm, event_type AS experiment, value, value > 50 AS success, ts, event_id FROM events)"


def context_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", F.lower("text").alias("haystack"))
