"""Tables in the folder that all executors share, and joins whose keys may hold any share of all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that are joined by broadcast.
HEAVY_KEYS = 10_000
#: Most lines in a compressed file, which one task reads.
LINES_A_FILE = 50_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read and write. Only where the session names none and all tasks run in this process, as in tests, one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share, and read again: lineage ends there."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_table(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """As ``shared_table``, for rows that come dealt out by ``key`` to so many ``tasks``: a bucket has a file, and however often the table is read, what meets or is grouped by ``key`` stays where it is. Its name is taken out of the catalog at once, the files stay."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    # Under other names, so that reading renames them: a column that carries the table's name is not known again in a union.
    df.toDF(*(f"{c}_" for c in df.columns)).write.bucketBy(tasks, f"{key}_").option("compression", "zstd").option("path", shared_path(spark, "table")).saveAsTable(name)
    found = spark.table(name).select(*(F.col(f"{c}_").alias(c) for c in df.columns))
    spark.sql(f"DROP TABLE {name}")
    return found


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """A column of texts as compressed files of LINES_A_FILE at most, so that many tasks read them again."""
    lines.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", LINES_A_FILE).text(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a shared table whose successor is written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_by_key(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` (a row for each key at most).

    Keys with a HEAVY_KEYS-th of all rows, so HEAVY_KEYS at most, are joined by
    broadcast where their rows are; the others are dealt out.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    heavy = shared_table(counts.where(F.col("n") >= max(total / HEAVY_KEYS, 1000)).select(key))
    if heavy.isEmpty():
        return rows.join(found, key, how)
    often = F.broadcast(heavy)
    near = rows.join(often, key, "left_semi").join(F.broadcast(found.join(often, key, "left_semi")), key, how)
    return near.unionByName(rows.join(often, key, "left_anti").join(found, key, how))
