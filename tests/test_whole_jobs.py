"""Queries do their whole job at any size."""

from __future__ import annotations

import json

from cohortspark.operators import tables, temporal
from cohortspark.plans import all_queries, language_queries, source_queries
from cohortspark.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_context_models_are_as_many_for_any_number_of_passages(spark):
    objects = language_queries.catalogue(spark, SF)
    assert objects.select("model_id").distinct().count() == language_queries.MODELS == 7
    assert objects.where("model_id = object_id % 7").count() == objects.count()


def test_headers_are_written_compressed_and_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(tables, "LINES_A_FILE", 1000)
    assert source_queries.headers(spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    files = [f for f in (tmp_path / "headers").iterdir() if f.name.startswith("part-")]
    assert len(files) > 4 and sum(f.stat().st_size for f in files) < 100 * spark.read.text(f"{tmp_path}/headers").count()


def test_models_are_put_together_in_one_grouping(spark, tmp_path):
    parts = source_queries.model_tables(spark, SF)
    plan = writers.nest_models(parts)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == len(parts)


def test_written_models_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    models = source_queries.written_models(spark, SF).count()
    assert models == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert spark.read.text(f"{tmp_path}/models").count() == models + 3
    assert sum(f.stat().st_size for f in (tmp_path / "models").iterdir()) < 600 * models


def test_label_documents_are_read_by_lines(spark, tmp_path):
    ids = [f"m{i}" for i in range(3000)]
    listed = ",\n".join(json.dumps({"id": m, "outcome": None if i % 500 == 7 else 'a "b", ]{ \\' + str(i), "x": [[i], {"y": 1}]}, indent=i % 3 or None) for i, m in enumerate(ids))
    (tmp_path / "list.json").write_text(f"﻿[{listed}\n]\n")
    entries = ",\n".join(f'"{m}"\n: {json.dumps("" if i % 500 == 7 else f"v{i}")}' for i, m in enumerate(ids))
    (tmp_path / "map.json").write_text(f'{{"other": {{"labels": {{"m0": 5}}}},\n "labels"\n: {{{entries}}}, "n": [1, 2]}}')
    (tmp_path / "broken.json").write_text('[{"id": "m1", "outcome": 1},')
    (tmp_path / "empty.json").write_text("[ ]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for name, shown in (("list", 'a "b", ]{ \\{}'), ("map", "v{}")):
            assert spark.read.text(str(tmp_path / f"{name}.json")).rdd.getNumPartitions() > 2
            good, bad = readers.read_labels(spark, str(tmp_path / f"{name}.json"), "json")
            assert {tuple(r) for r in good.collect()} == {(m, shown.replace("{}", str(i))) for i, m in enumerate(ids) if i % 500 != 7}
            assert sorted((r["row"], r["reason"]) for r in bad.collect()) == [(i + 2, "no label") for i in range(7, 3000, 500)]
        for name in ("broken", "empty"):
            assert all(part.isEmpty() for part in readers.read_labels(spark, str(tmp_path / f"{name}.json"), "json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_row_of_label_lists_holds_all_labels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    source_queries.s05b(spark, SF)
    assert spark.read.text(f"{tmp_path}/labels").count() == orders + 2
    whole = json.loads("".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/labels").collect()))
    assert len(whole) == orders


def test_paths_on_a_grid_make_objects_once(spark):
    plan = all_queries.QUERIES["g22_grid_paths"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_models_are_compared_in_one_grouping(spark):
    plan = all_queries.QUERIES["t08_registered_links"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("collect_list(now") == 1
    schema = "model_id string, object_id string, obj_seq int, label string, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "x0", "x1", "y0", "y1", "z0", "z1", "volume_mm3", "surface_area_mm2"))
    rows = [(m, f"{m}{i}", i, label, *map(float, (i, 0, 0, 0, 1, 0, 1, 0, 1, 10, 5))) for m, labels in (("a", ("Cyst", None, "rib")), ("b", ("cyst", None, "CYST"))) for i, label in enumerate(labels)]
    links = temporal.compare_models(spark.createDataFrame(rows, schema), spark.createDataFrame([("b", "a"), ("a", None)], "model_id string, prior_id string"))
    told = sorted((r["object_id"], r["prior_object_id"], r["link_type"], r["volume_delta"]) for r in links.collect())
    assert told == [("a1", "a1", "resolved", None), ("a2", "a2", "resolved", None), ("b0", "a0", "same_as_prior", 0.0), ("b1", "b1", "new", None), ("b2", "b2", "new", None)]
