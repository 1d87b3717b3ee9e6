"""What must not grow faster than the tables: see the findings of round 3."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Row

from cohortspark.operators import graph, learning, spatial, temporal
from cohortspark.plans import fixtures, language_queries, learning_queries, object_queries, source_queries, text_queries
from cohortspark.sources import readers, writers
from cohortspark.streaming import streams

TABLES = "/root/testdata/sf0.001"


def test_objects_are_dealt_by_model_once_and_a_task_has_no_more_of_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "OBJECTS_A_TASK", 500)
    objects = fixtures.objects(spark, TABLES)
    tasks = -(-fixtures.table(spark, TABLES, "lineitem").count() // 500)
    assert tasks > 8 and spatial.pairs(objects).rdd.getNumPartitions() == tasks
    assert objects.groupBy("model_id").count().rdd.getNumPartitions() == tasks


def test_a_search_makes_its_rows_once(spark, monkeypatch):
    plans = []

    def search(rows, names, candidates):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return [{"algorithm": "logistic", "accuracy": 0.5}], 0

    monkeypatch.setattr(learning, "search_configs", search)
    learning_queries.f16(spark, TABLES)
    assert "Scan parquet" in plans[0] and "Exchange" not in plans[0] and "Join" not in plans[0]


def test_a_patient_costs_two_calls_to_the_state_store():
    calls, held = [], []

    class Value:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

    state = streams.PriorState("long")
    state.init(Handle())
    tell = lambda *rows: [(r["model_id"], r["prior_id"], r["version"]) for r in state.handleInputRows(("p",), (Row(at=at, model_id=m) for at, m in rows), None)]
    assert tell((30, 3), (10, 1), (10, 1)) == [(1, None, 0), (3, 1, 1)] and calls == ["get", "update"]
    assert tell((20, 2)) == [(2, 1, 2), (3, 2, 3)] and held[-1] == (4, [10, 20, 30], [1, 2, 3])
    assert tell((20, 2)) == [] and len(held) == 2


def test_bundles_meet_in_one_grouping(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "model_id long, object_id string")
    near = spark.createDataFrame([(1, "a", "c", 2, 5.0), (1, "a", "b", 1, 0.0), (2, "z", "y", 1, 1.0)], "model_id long, object_id string, near_id string, rank int, gap double")
    bindings = spark.createDataFrame([(1, "object", "a", "k2"), (1, "object", "a", "k1"), (1, "model", "b", "k3")], "model_id long, target_type string, target_id string, binding_id string")
    links = spark.createDataFrame([(1, "gone", "resolved", "gone")], "model_id long, object_id string, link_type string, prior_object_id string")
    found = writers.export_context_bundles(wanted, near, bindings, links)
    assert {r["object_id"]: r["bundle"] for r in found.collect()} == {
        "a": '{"object_id":"a","nearby_objects":[{"rank":1,"near_id":"b","gap":0.0},{"rank":2,"near_id":"c","gap":5.0}],"context_bindings":[{"binding_id":"k1"},{"binding_id":"k2"}],"temporal_links":[]}',
        "b": '{"object_id":"b","nearby_objects":[],"context_bindings":[],"temporal_links":[]}',
    } and found.count() == 2
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_utterances_and_objects_stay_where_their_model_is(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (language_queries.l06, language_queries.l09):
            plan = query(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
            assert "utterance_id" in plan and "hashpartitioning(utterance_id" not in plan and "word#" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_of_a_digest_stay_where_their_model_is(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = text_queries.d07(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    keys = {re.sub(r"#\d+L?", "", x).rsplit(", ", 1)[0] for x in dealt}
    assert "model_id" in keys and not [k for k in keys if "," in k]


def test_current_changes_are_those_of_the_report(spark):
    objects = fixtures.objects(spark, TABLES)
    priors = temporal.select_prior(temporal.models(objects))
    told, _ = temporal.change_report(temporal.compare_models(objects, priors), objects)
    columns = ["model_id", "object_id", "link_type", "volume_prior", "volume_now"]
    want = {tuple(r) for r in told.where("link_type <> 'resolved'").select(columns).collect()}
    for tasks in (None, fixtures.object_tasks(spark, TABLES)):
        found = temporal.current_changes(objects.withColumn("of", objects["object_id"]), priors, ("of",), tasks)
        assert {tuple(r) for r in found.withColumnRenamed("of", "object_id").select(columns).collect()} == want
    assert {r[2] for r in want} == {"changed_from", "new"}


def executed(df):
    """The plan, as if every table were too large for a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set(name, before)


def test_models_are_put_together_where_they_are_dealt(spark):
    parts = source_queries.model_tables(spark, TABLES)
    assert "Exchange" not in executed(writers.nest_models(parts))
    assert "Exchange" not in executed(writers.export_graph(parts))


def test_models_of_a_dealt_table_are_those_of_the_objects(spark):
    want = fixtures.objects(spark, TABLES).withColumnRenamed("model_id", "m")
    found = fixtures.dealt_objects(spark, TABLES, 500, "string")
    assert found.groupBy("model_id").count().rdd.getNumPartitions() == fixtures.object_tasks(spark, TABLES, 500) > 8
    columns = [c for c in found.columns if c != "model_id"]
    assert found.select(columns).exceptAll(want.select(columns)).isEmpty() and found.count() == want.count()
    assert found.where("object_id = model_id || ':' || obj_seq").count() == found.count()


def test_documents_are_not_broadcast(spark):
    plan = source_queries.s08(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan


def test_a_list_that_was_dropped_has_no_table(spark):
    models = readers.known_models(spark.createDataFrame([('{"id": "a", "patient_id": "p", "study_id": "s", "sources": [{"id": "x"}]}', 1)], "value string, k int"))
    tables = readers.flatten_models(models.drop("objects", "k"))
    assert "objects" not in tables and [r["id"] for r in tables["sources"].collect()] == ["x"]


@pytest.mark.parametrize("query", [object_queries.r04, object_queries.r04b, object_queries.t17b, text_queries.s10, text_queries.s10b])
def test_links_edges_and_bindings_meet_where_their_model_is(spark, query):
    keys = [re.sub(r"#\d+L?", "", x).rsplit(", ", 1)[0] for x in re.findall(r"hashpartitioning\(([^)]*)\)", executed(query(spark, TABLES)))]
    assert "prior_id" in keys and set(keys) <= {"model_id", "patient_id", "prior_id"}


def test_link_types_are_those_of_the_comparison(spark):
    objects = fixtures.objects(spark, TABLES)
    priors = temporal.select_prior(temporal.models(objects))
    found = temporal.link_types(objects, priors, tasks=fixtures.object_tasks(spark, TABLES))
    want = temporal.compare_models(objects, priors).select(found.columns)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and found.select("link_type").distinct().count() == 4


def test_what_is_found_of_wanted_objects_has_all_its_rows(spark):
    edges = spark.createDataFrame([(1, "a", "b", "contains", None), (1, "b", "c", "near", 1.0), (2, "a", "d", "near", 2.0)], "model_id long, source_id string, target_id string, type string, value double")
    bindings = spark.createDataFrame([(1, "object", "a", "k"), (1, "object", "a", "k"), (1, "model", "a", "m")], "model_id long, target_type string, target_id string, binding_id string")
    links = spark.createDataFrame([(1, "a", "same_as_prior", "z"), (1, "c", "new", "c")], "model_id long, object_id string, link_type string, prior_object_id string")
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x")], "model_id long, object_id string")
    rows = sorted(tuple(r) for r in graph.graph_query("subgraph", wanted, edges, bindings, links).collect())
    assert rows == [(1, "a", "context", "k"), (1, "a", "context", "k"), (1, "a", "descendants", "b"), (1, "a", "neighbors", "b"), (1, "a", "prior_versions", "z"), (1, "a", "relationships", "a>contains>b")]
    told = {r["object_id"]: r for r in graph.subgraph(wanted, edges, bindings, links).collect()}
    assert set(told) == {"a", "x"} and told["a"]["context"] == ["k", "k"] and told["x"]["neighbors"] == [] == told["x"]["context"]


def test_a_difference_keeps_repeated_objects(spark):
    objects = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c")], "model_id long, object_id string")
    links = spark.createDataFrame([(1, "a", "changed_from"), (1, "b", "same_as_prior"), (1, "c", "new"), (1, "c", "resolved"), (1, "gone", "resolved"), (2, "q", "new")], "model_id long, object_id string, link_type string")
    assert sorted(tuple(r) for r in temporal.difference(objects, links).collect()) == [(1, "a", "changed"), (1, "a", "changed"), (1, "b", "baseline"), (1, "c", "new"), (1, "c", "resolved"), (1, "gone", "resolved")]


def boxes_of(spark, rows):
    """``rows`` (model, object, x, width); the objects of a model in order."""
    seq = {}
    at = [(m, o, seq.setdefault(m, []).append(o) or len(seq[m]), "l", "t", *[x, 5.0, 5.0], x, None if w is None else x + w, 0.0, 10.0, 0.0, 10.0) for m, o, x, w in rows]
    return spark.createDataFrame(at, "model_id string, object_id string, obj_seq int, label string, obj_type string, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")


def test_candidates_are_the_same_by_pairs_and_by_cells(spark, monkeypatch):
    rows = [("a", f"a{i}", 31.0 * i, 40.0) for i in range(30)] + [("b", "b0", 0.0, 10.0), ("b", "b1", 900.0, 10.0), ("b", "b2", 905.0, 300.0), ("b", "b3", 5.0, None), ("c", "c0", -64.0, 64.0), ("c", "c1", 64.0, -150.0), ("d", "d0", 1.0, 1.0)]
    objects = boxes_of(spark, rows)
    told = []
    for whole in (0, 10, 1000):
        monkeypatch.setattr(spatial, "WHOLE", whole)
        told.append(sorted(tuple(r) for r in spatial.candidates(objects, 10.0).collect()))
    assert told[0] == told[1] == told[2]
    of = lambda a: [r[2] for r in told[0] if r[1] == a]
    assert of("b0") == of("b3") == ["b0", "b1", "b2", "b3"] and of("b1") == ["b1", "b2"] and of("d0") == ["d0"] and 2 < len(of("a9")) < 10


def test_recorded_paths_are_the_same_for_small_and_large_models(spark, monkeypatch):
    objects = boxes_of(spark, [("a", f"a{i}", 130.0 * i, 40.0) for i in range(30)] + [("b", "b0", 0.0, 10.0), ("b", "b1", 900.0, 10.0), ("c", "c0", 0.0, 10.0)])
    ends = [(m, (0.0, 0.0, 0.0), (600.0, 12.0 * k, 3.0 * k)) for m in "abcd" for k in range(3)]
    paths = spark.createDataFrame([(f"p{i}", m, *a, *b) for i, (m, a, b) in enumerate(ends)], "path_id string, model_id string, sx double, sy double, sz double, ex double, ey double, ez double")
    told = []
    for whole in (0, 10, 1000):
        monkeypatch.setattr(spatial, "WHOLE", whole)
        found = spatial.record_paths(objects, paths, grid=True).collect()
        told.append(sorted((r["path_id"], tuple(r["hits"]), r["clearance"] is not None and round(r["clearance"], 6), round(r["length"], 6)) for r in found))
    assert told[0] == told[1] == told[2] and len(told[0]) == 9


def test_cells_and_paths_meet_where_their_model_is(spark):
    assert "Exchange" not in executed(object_queries.g10(spark, TABLES))
    plan = executed(object_queries.g22b(spark, TABLES))  # a row for each path is dealt out, and no cell
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(path_id") == 1
