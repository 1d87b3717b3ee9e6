"""Structured Streaming over the library's feeds (W). Each function takes a streaming DataFrame."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortspark.operators.tables import drop_folder, shared_path
from cohortspark.operators.temporal import compare_models


def shared_folder(df: DataFrame) -> str:
    """A new folder in the one that all executors share."""
    return shared_path(df.sparkSession, "stream")


def stream_table(spark, path: str, pattern: str, schema, files_at_once: int | None = None) -> DataFrame:
    """A Parquet folder as a file stream, limited to the files of ``pattern``; with ``files_at_once``, so many in a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def run_once(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder and return that. ``settings`` hold for the session meanwhile."""
    out, conf = shared_folder(stream), stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            conf.set(k, v)
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def unique_arrivals(instances: DataFrame, keys: list[str], time: str = "arrived_at", delay: str = "30 days") -> DataFrame:
    """Each key once, however often it arrives within the delay."""
    return instances.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def audit_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by type in tumbling or sliding windows; later data is dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window, "event_type").count().select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", F.col("count").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").count()
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def written(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table of the shared folder, if it has been written."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_batches(stream: DataFrame, key: str, order: list[str], folder: str | None = None, buckets: int = 64) -> DataFrame:
    """Last write of each key, as a table in buckets by hash of the key.

    A batch reads and writes the buckets of its own keys only, as ``rows/epoch=<its number>/bucket=``;
    ``state/epoch=`` says for every bucket which epoch holds it now. A batch that runs again
    starts from the state before it and writes the same, so what a batch replaced is
    dropped by the batch after it. With the ``folder`` of an earlier run the stream goes on where that ended.
    """
    out = folder or shared_folder(stream)
    spark = stream.sparkSession
    plain = [c for c in stream.columns if c != key]

    def states() -> dict[int, dict[int, int]]:
        """By epoch: the epoch that holds each bucket. Three epochs at most, a row for each bucket."""
        found = written(spark, f"{out}/state", "bucket int, at int, epoch int")
        by: dict[int, dict[int, int]] = {}
        for bucket, at, epoch in found.collect() if found is not None else []:
            by.setdefault(epoch, {})[bucket] = at
        return by

    def merge(batch: DataFrame, epoch: int) -> None:
        earlier = {e: held for e, held in states().items() if e < epoch}
        *old, last_epoch = sorted(earlier) or [-1]
        before = earlier.get(last_epoch, {})
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in own.select("bucket").distinct().collect())
        if not touched:
            return
        every = own
        for at in sorted({before[b] for b in touched if b in before}):
            places = [f"{out}/rows/epoch={at}/bucket={b}" for b in touched if before.get(b) == at]
            held = spark.read.option("basePath", f"{out}/rows/epoch={at}").parquet(*places)
            every = every.unionByName(held.select(*own.columns))
        last = every.groupBy("bucket", key).agg(F.max_by(F.struct(*plain), F.struct(*order)).alias("last")).select("bucket", key, "last.*")
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/epoch={epoch}")
        now = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(now.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{out}/state/epoch={epoch}")
        for e in old:
            for bucket, at in earlier[e].items():
                if before.get(bucket) != at:
                    drop_folder(spark, f"{out}/rows/epoch={at}/bucket={bucket}")
            drop_folder(spark, f"{out}/state/epoch={e}")

    each_batch(stream, merge, f"{out}/_state")
    found = states()
    if not found:
        return spark.createDataFrame([], stream.schema)
    by_epoch: dict[int, list[int]] = {}
    for bucket, at in found[max(found)].items():
        by_epoch.setdefault(at, []).append(bucket)
    parts = [spark.read.schema(stream.schema).parquet(*(f"{out}/rows/epoch={at}/bucket={b}" for b in own)) for at, own in sorted(by_epoch.items())]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(*stream.columns)


class PriorState(StatefulProcessor):
    """Keeps a patient's models in order, as one value, so a patient costs two calls to the store; tells the prior of each that arrives and the new prior of the one after it."""

    def __init__(self, id_type: str) -> None:
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"told long, at array<long>, id array<{self.id_type}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        told, *lists = self.kept.get() or (0, [], [])
        known = list(zip(*lists, strict=True))
        ids = set(lists[1])
        n = told
        for at, id_ in sorted((r["at"], r["model_id"]) for r in rows):
            if id_ in ids:
                continue  # delivered again
            place = bisect_left(known, (at, id_))
            yield Row(patient_id=key[0], model_id=id_, prior_id=known[place - 1][1] if place else None, version=n)
            n += 1
            if place < len(known):
                yield Row(patient_id=key[0], model_id=known[place][1], prior_id=id_, version=n)
                n += 1
            known.insert(place, (at, id_))
            ids.add(id_)
        if n > told:
            self.kept.update((n, [at for at, _ in known], [id_ for _, id_ in known]))

    def close(self) -> None:
        pass


def enrich_prior(models: DataFrame, objects: DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Models (``patient_id, model_id, study_date``) as they arrive, with the one before each by date, then id, of the same patient (``patient_id, model_id, prior_id``); and with ``objects`` (of all models, read anew for each batch) the links of each to its prior, as in ``compare_models``.

    What has arrived is kept as state by patient, so the prior may have come in any earlier
    batch; a model that comes late becomes the prior of the one after it, which is
    told and compared once more. The last word on each model counts, so the tables do not
    depend on how the stream was cut. A model that is delivered again changes nothing.
    """
    out = folder or shared_folder(models)
    spark, kinds = models.sparkSession, dict(models.dtypes)
    at = F.coalesce(F.unix_micros(F.col("study_date").cast("timestamp")), F.lit(-(1 << 62)))
    keyed = models.select("patient_id", "model_id", at.alias("at"))
    schema = f"patient_id {kinds['patient_id']}, model_id {kinds['model_id']}, prior_id {kinds['model_id']}, version long"
    told = keyed.groupBy("patient_id").transformWithState(PriorState(kinds["model_id"]), schema, "update", "none")

    def last_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("patient_id", "model_id").agg(F.max_by("prior_id", "version").alias("prior_id"))

    def work(batch: DataFrame, epoch: int) -> None:
        place = f"{out}/rows/batch={epoch}"
        batch.write.mode("overwrite").parquet(place)
        if objects is not None:
            pairs = last_of(spark.read.schema(schema).parquet(place)).where("prior_id is not null").select("model_id", "prior_id")
            met = pairs.select("model_id").unionByName(pairs.select(F.col("prior_id").alias("model_id"))).distinct()
            compare_models(objects.join(met, "model_id", "left_semi"), pairs).write.mode("overwrite").parquet(f"{out}/links/batch={epoch}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS_DB[_PROVIDER])
    try:
        each_batch(told, work, f"{out}/_state", "update")
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    rows = written(spark, f"{out}/rows", f"{schema}, batch int")
    priors = last_of(rows if rows is not None else spark.createDataFrame([], schema))
    if objects is None:
        return priors, None
    links = written(spark, f"{out}/links")
    if links is None:
        return priors, compare_models(objects, priors)
    return priors, links.drop("batch").join(priors.select("model_id", "prior_id"), ["model_id", "prior_id"], "left_semi").distinct()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Run ``work`` on every batch until the stream is drained."""
    query = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The state store of streams with timers or lists.
ROCKS_DB = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
JOB_STATE = "job_id long, status string, stage string, updated_at timestamp"


class LastState(StatefulProcessor):
    """Keeps the last update of a job; a job without news for ``timeout_ms`` that has not ended is failed."""

    def __init__(self, timeout_ms: int, ended: tuple[str, ...]) -> None:
        self.timeout_ms, self.ended = timeout_ms, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, stage string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.last.get() if self.last.exists() else None
        for part in rows:
            at = part["updated_at"].astype("datetime64[us]").astype("int64")
            for status, stage, t in zip(part["status"], part["stage"], at, strict=True):
                if best is None or (t, stage) >= (best[2], best[1]):
                    best = (status, stage, int(t))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(best)
        self.handle.registerTimer(best[2] // 1000 + self.timeout_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, stage, at = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "status": [status if status in self.ended else "failed"], "stage": [stage], "updated_at": pd.to_datetime([at], unit="us")})

    def close(self) -> None:
        pass


def job_state(updates: DataFrame, timeout: str = "1 hour", ended: tuple[str, ...] = ("completed", "failed"), delay: str = "1 hour") -> DataFrame:
    """The final state of each job of ``job_id, status, stage, updated_at``, once it has had no update for ``timeout``: failed, if it has not ended by then. Needs ROCKS_DB."""
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return updates.withWatermark("updated_at", delay).groupBy("job_id").transformWithStateInPandas(LastState(ms, ended), JOB_STATE, "append", "EventTime")
