"""Streams that have ended hold what a batch over the same events holds."""

from __future__ import annotations

import datetime
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import all_queries
from cohortspark.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "batch"), [("w02_stream_counts", streams.audit_counts), ("w06_stream_sessions", streams.sessions)])
def test_final_is_batch(spark, name, batch):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(tuple, batch(events).collect()))
    assert sorted(map(tuple, all_queries.QUERIES[name](spark, SF).collect())) == want


def files(spark, tmp_path, parts, schema):
    """A folder of files, to be read one after the other."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    return [f"{tmp_path}/in{i}" for i in range(len(parts))]


MODEL = "patient_id long, model_id string, study_date date"


def arriving(spark, folder):
    return streams.stream_table(spark, folder, "*.parquet", spark.createDataFrame([], MODEL).schema, files_at_once=1)


def test_priors_from_any_split(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i % 5, f"m{i:03}", datetime.date(2024, 1, 1) + datetime.timedelta(days=rnd.randrange(9))) for i in range(60)]
    want = {}
    for p in range(5):
        own = sorted((r[2], r[1]) for r in rows if r[0] == p)
        want |= {m: own[k - 1][1] if k else None for k, (_, m) in enumerate(own)}
    for n in (1, 7):
        rnd.shuffle(rows)
        folder = tmp_path / f"all{n}"
        folder.mkdir()
        for k in range(n):
            part = files(spark, tmp_path / f"p{n}-{k}", [rows[k::n] + rows[:2]], MODEL)[0]  # two of them are delivered with every file
            for f in Path(part).glob("*.parquet"):
                shutil.copy(f, folder / f"{k}.parquet")
        priors, links = streams.enrich_prior(arriving(spark, str(folder)))
        assert links is None and {r["model_id"]: r["prior_id"] for r in priors.collect()} == want


def test_prior_of_an_earlier_file_and_links(spark, tmp_path):
    day = lambda n: datetime.date(2024, 5, n)
    parts = files(spark, tmp_path / "in", [[(1, "new", day(20))], [(1, "old", day(1))], [(1, "middle", day(10)), (2, "lone", None)]], MODEL)
    things = [(m, f"{m}-{k}", k, "cyst", float(k), 0.0, 0.0, *(0.0, 1.0) * 3, v, 1.0) for m, v in (("old", 10.0), ("middle", 10.5), ("new", 30.0)) for k in (1, 2)]
    objects = spark.createDataFrame(things, "model_id string, object_id string, obj_seq int, label string, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, volume_mm3 double, surface_area_mm2 double")
    out = str(tmp_path / "out")
    state = []
    for part in parts:  # a stream of its own for each file, over one state
        (tmp_path / "feed").mkdir(exist_ok=True)
        for f in Path(part).glob("*.parquet"):
            shutil.copy(f, tmp_path / "feed" / f"{len(state)}-{f.name}")
        priors, links = streams.enrich_prior(arriving(spark, str(tmp_path / "feed")), objects, out)
        state.append({r["model_id"]: r["prior_id"] for r in priors.collect()})
    assert state == [{"new": None}, {"new": "old", "old": None}, {"new": "middle", "middle": "old", "old": None, "lone": None}]
    kinds = {(r["model_id"], r["prior_id"]): r["link_type"] for r in links.collect()}
    assert kinds == {("new", "middle"): "changed_from", ("middle", "old"): "same_as_prior"}


def test_empty_streams(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert streams.enrich_prior(arriving(spark, str(tmp_path / "none")))[0].count() == 0
    assert streams.upsert_batches(arriving(spark, str(tmp_path / "none")), "model_id", ["study_date"]).count() == 0


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    schema = "key long, at long, text string"
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    size = lambda epoch: sum(f.stat().st_size for f in Path(out, "rows", f"epoch={epoch}").rglob("*.parquet"))

    def deliver(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("*.parquet"):
            shutil.copy(f, feed / f"{name}-{f.name}")
        stream = streams.stream_table(spark, str(feed), "*.parquet", spark.createDataFrame([], schema).schema, files_at_once=1)
        return sorted(map(tuple, streams.upsert_batches(stream, "key", ["at", "text"], str(out)).collect()))

    want = {k: (k, 1, f"first {k} " + "x" * 50) for k in range(4000)}
    assert deliver("a", list(want.values())) == sorted(want.values())
    for n, name in enumerate("bcd", 2):
        rows = [(7, n, f"news {n}"), (7, n, "less"), (9, 0, "too late"), (5000 + n, n, "new")]
        want |= {7: rows[0], 5000 + n: rows[3]}
        assert deliver(name, rows) == sorted(want.values())
        assert size(n - 1) < size(0) / 5
    assert deliver("e", [(1, 9, "last")])[1] == (1, 9, "last")
    held = {p.name: len(list(p.glob("bucket=*"))) for p in (out / "rows").glob("epoch=*")}
    assert held["epoch=0"] < 64 and len(list((out / "state").glob("epoch=*"))) <= 3
    stream = streams.stream_table(spark, str(feed), "*.parquet", spark.createDataFrame([], schema).schema)
    assert streams.upsert_batches(stream, "key", ["at", "text"], str(out)).count() == len(want)  # nothing new: the table as it is
