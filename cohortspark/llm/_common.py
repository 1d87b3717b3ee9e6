"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``doc_id`` and ``text``, whatever they were called; no other column survives."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def folded(text: Column) -> Column:
    """Lower case. Of all letters only A-Z become a-z: the Kelvin sign, which lower() makes a k, becomes another one first. translate() is many times slower."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


#: Most keys that ``join_by_key`` sends to every task.
HEAVY_KEYS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none and all tasks run in this process, as in tests, one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a task: memory that its worker has freed, Arrow's too, goes back to the system, since the worker stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A whole number for each row: its id where no two rows share one and none is null or below -2**62; else 64 bits of hash of id and text, so that rows equal in both share it."""
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if ids.where(f"n > 1 or `{id_col}` is null or `{id_col}` < {-(1 << 62)}").isEmpty():
        return F.col(id_col).cast("long")
    return F.xxhash64(id_col, text_col)


def join_by_key(rows: DataFrame, found: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined with ``found`` (a row for each key at most), where a key may hold any share of all rows.

    ``counts(key, n)`` has the number of rows by key. Keys with a ``HEAVY_KEYS``-th
    of all rows, so HEAVY_KEYS at most, are joined by broadcast where their rows
    are; the others are dealt out.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") >= max(total / HEAVY_KEYS, 8)).select(key)
    heavy = F.broadcast(materialize(heavy))
    near = rows.join(F.broadcast(found.join(heavy, key)), key)
    return near.unionByName(rows.join(heavy, key, "left_anti").join(found, key))
