"""Small literal cases."""

from __future__ import annotations

import json
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import geometry as g
from cohortspark.operators import components, context, deid, experiments, features, spatial, temporal, utterances, voxels
from cohortspark.sources import readers, writers

#: A stone in a kidney, and a duct 3 mm beside the stone and inside the kidney as well.
BOXES = [("stone", "finding", "Stone", (20, 5, 5), (24, 8, 8)), ("kidney", "anatomy", "Left kidney", (10, 0, 0), (60, 40, 30)), ("duct", "anatomy", "Duct", (27, 5, 5), (30, 8, 8)), ("spine", "anatomy", "Spine", (130, 0, 0), (150, 40, 90))]


def boxes(spark, rows=BOXES, model="m"):
    out = []
    for i, (name, kind, label, low, high) in enumerate(rows, 1):
        c = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
        out.append((model, name, i, label, kind, *map(float, c), *(float(v) for p in zip(low, high, strict=True) for v in p), 1.0, 1.0))
    return spark.createDataFrame(out, "model_id string, object_id string, obj_seq int, label string, obj_type string, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, volume_mm3 double, surface_area_mm2 double")


def test_relations_and_nearest(spark):
    o = boxes(spark)
    found = {(r["source_id"], r["target_id"]): r["type"] for r in spatial.derive_relationships(o).collect()}
    assert found == {("kidney", "stone"): "contains", ("stone", "kidney"): "inside", ("kidney", "duct"): "contains", ("duct", "kidney"): "inside", ("stone", "duct"): "near", ("duct", "stone"): "near"}
    assert found == {(r["source_id"], r["target_id"]): r["type"] for r in spatial.derive_relationships(o, grid=True).collect()}
    near = {r["object_id"]: (r["near_id"], r["gap"]) for r in spatial.nearest(o, 1).collect()}
    assert near == {"stone": ("duct", 3.0), "duct": ("stone", 3.0), "kidney": ("stone", 0.0), "spine": ("kidney", 70.0)}


def test_grid_finds_what_pairs_find(spark):
    rnd = random.Random(9)
    place = lambda wide: tuple(rnd.uniform(0, wide) for _ in range(3))
    rows = [(f"o{i}", "anatomy", "x", low, tuple(v + rnd.uniform(0, 40) for v in low)) for i, low in enumerate([place(1500) for _ in range(60)] + [place(100) for _ in range(20)])]
    o = boxes(spark, rows)
    plain = lambda df: sorted((r["object_id"], r["near_id"], round(r["gap"], 9)) for r in df.collect())
    assert plain(spatial.within_radius(o, 150.0, grid=True)) == plain(spatial.within_radius(o, 150.0))
    assert plain(spatial.nearest(o, 3, grid=True)) == plain(spatial.nearest(o, 3))


@pytest.mark.parametrize(("low", "high", "start", "end", "hit", "clearance"), [((-2, 3, 3), (2, 5, 5), (-8, 4, 4), (8, 4, 4), True, 0.0), ((1, 1, 1), (2, 2, 2), (0, 6, 1), (6, 6, 1), False, 4.0), ((3, 4, 0), (9, 9, 9), (0, 0, 0), (-5, 0, 0), False, 5.0), ((0, 0, 0), (4, 4, 4), (4, 9, 2), (4, 1, 2), True, 0.0)])
def test_trajectories(spark, low, high, start, end, hit, clearance):
    o = boxes(spark, [("box", "anatomy", "Box", low, high)])
    path = spark.createDataFrame([("p", "m", *map(float, start), *map(float, end))], "path_id string, model_id string, sx double, sy double, sz double, ex double, ey double, ez double")
    assert spatial.trajectory_hits(o, path).count() == int(hit)
    assert spatial.trajectory_clearance(o, path).first()["clearance"] == pytest.approx(clearance)


def test_paths_on_a_grid_meet_what_all_pairs_meet(spark):
    """Thousands of objects in one model, boxes that end on planes of the grid among them, and paths along planes, through corners, far away, and of no length."""
    rnd = random.Random(12)
    at = lambda wide: float(rnd.choice([rnd.uniform(-wide, wide), 64 * rnd.randint(-8, 8)]))
    rows = []
    for i in range(600):
        low = [at(2000) for _ in range(3)]
        rows.append((f"o{i}", "anatomy", "x", low, tuple(v + rnd.choice([0, 64, rnd.uniform(0, 90)]) for v in low)))
    o = boxes(spark, rows)
    ends = [((-512, 64, 64), (512, 64, 64)), ((-512, -512, -512), (512, 512, 512)), ((-512, 512, 0), (512, -512, 0)), ((9000, 0, 0), (9500, 0, 0)), ((64, 64, 64), (64, 64, 64)), *(tuple(tuple(at(900) for _ in range(3)) for _ in range(2)) for _ in range(12))]
    paths = spark.createDataFrame([(f"p{i}", "m", *map(float, (*a, *b))) for i, (a, b) in enumerate(ends)], "path_id string, model_id string, sx double, sy double, sz double, ex double, ey double, ez double")
    told = lambda df: sorted((r["path_id"], tuple(r["hits"]), round(r["clearance"], 6), round(r["length"], 6)) for r in df.collect())
    assert told(spatial.record_paths(o, paths, grid=True)) == told(spatial.record_paths(o, paths))
    many = o.unionByName(boxes(spark, [(f"q{i}", "anatomy", "x", (10.0 * (i % 100), 10.0 * (i // 100), 5000.0), (10.0 * (i % 100) + 5, 10.0 * (i // 100) + 5, 5005.0)) for i in range(10_000)]).withColumn("obj_seq", F.col("obj_seq") + 1000))
    few = spatial.near_paths(many, paths, 0.0, 64.0).count()
    assert 0 < few < 0.05 * many.count() * paths.count()
    assert sorted(map(tuple, spatial.trajectory_hits(many, paths, grid=True).collect())) == sorted(map(tuple, spatial.trajectory_hits(many, paths).collect()))
    lone = boxes(spark, rows[:1], "alone")
    inside = spark.createDataFrame([("p", "alone", *map(float, (*rows[0][3], *rows[0][3])))], paths.schema)
    assert [(r["hits"], r["clearance"]) for r in spatial.record_paths(lone, inside, grid=True).collect()] == [(["o0"], None)]


def test_segment_distance_against_sampling(spark):
    rnd = random.Random(4)
    rows = [(i, *(rnd.uniform(-9, 9) for _ in range(6)), *sum(([a := rnd.uniform(-5, 5), a + rnd.uniform(0, 4)] for _ in range(3)), [])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, sx double, sy double, sz double, ex double, ey double, ez double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    for r in df.select("*", g.segment_box_distance("s", "e", "").alias("d")).collect():
        def at(t, r=r):
            return sum(max(r[f"{x}0"] - p, p - r[f"{x}1"], 0) ** 2 for x in "xyz" for p in [r[f"s{x}"] + (r[f"e{x}"] - r[f"s{x}"]) * t]) ** 0.5
        best = min(at(k / 4000) for k in range(4001))
        assert r["d"] <= best + 1e-9 and r["d"] >= best - 0.01


def test_segment_distances_are_found_in_arrays(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, -1.0, 1.0, -1.0, 1.0), (0.0, 0.0, 0.0, 9.0, 9.0, None, 1.0, 2.0, 1.0, 2.0, 1.0, 2.0), (-5.0, 4.0, 0.0, 5.0, 4.0, 0.0, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0)], "sx double, sy double, sz double, ex double, ey double, ez double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    told = df.select(g.segment_box_distance("s", "e", "").alias("d"))
    assert "transform(" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert [r["d"] for r in told.collect()] == [1.0, None, 3.0]


def test_change_of_a_matched_object(spark):
    now = boxes(spark, [("k1", "finding", "Cyst, left", (0, 0, 0), (6, 4, 2))], "b").withColumns({"volume_mm3": F.lit(48.0), "surface_area_mm2": F.lit(88.0)})
    then = boxes(spark, [("k9", "finding", "cyst left", (0, 0, 0), (5, 4, 2))], "a").withColumns({"volume_mm3": F.lit(40.0), "surface_area_mm2": F.lit(76.0)})
    priors = spark.createDataFrame([("b", "a")], "model_id string, prior_id string")
    link = temporal.compare_models(now.unionByName(then), priors).first()
    assert (link["link_type"], link["volume_delta"], link["diameter_delta"], link["surface_delta"], link["centroid_distance"]) == ("changed_from", 8.0, 1.0, 12.0, 0.5)
    assert (link["volume_percent"], link["diameter_percent"]) == (pytest.approx(20), pytest.approx(20))
    lost = temporal.compare_models(then, priors).first()
    assert lost["link_type"] == "resolved"
    # half a turn about z and a shift bring the prior to where the object is now
    turn = spark.createDataFrame([("b", 0.0, 0.0, math.pi, 5.0, 4.0, 0.0, 0.0, 0.0, 0.0, "zyx")], "model_id string, rx double, ry double, rz double, tx double, ty double, tz double, ox double, oy double, oz double, axes string")
    moved = temporal.prior_objects(now.unionByName(then), priors, turn).first()
    assert [round(moved[c], 9) for c in ("x0", "x1", "y0", "y1", "z0", "z1", "cx")] == [0, 5, 0, 4, 0, 2, 2.5]


def test_labelmap_cube(spark):
    cells = spark.createDataFrame([(1, x, y, 0) for x in (1, 2) for y in (1, 2)], "group int, x int, y int, z int")
    s = voxels.exposed_surface(cells).first()
    assert (s["faces"], s["area"]) == (16, 24.0)
    one = spark.createDataFrame([(1, 5, 5, 5)], "series int, x int, y int, z int")
    assert voxels.dilate(one, (10, 10, 10)).count() == 7
    assert voxels.erode(voxels.dilate(one, (10, 10, 10))).count() == 1


def test_components_do_not_depend_on_partitions(spark):
    rnd = random.Random(6)
    n, edges = 60, []
    for _ in range(50):
        edges.append((rnd.randrange(n), rnd.randrange(n)))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "a long, b long")
    a = {r["id"]: r["component"] for r in components.connected_components(nodes, e).collect()}
    b = {r["id"]: r["component"] for r in components.connected_components(nodes.repartition(7), e.repartition(1)).collect()}
    assert a == b
    assert all(a[x] == a[y] for x, y in edges)


def test_scrub_and_utterances(spark):
    row = spark.createDataFrame([("P12", "Doe^Jane", "Jane Doe, doe's id P12\tseen 20240102, uid 1.2.840.1.5")], "pid string, name string, text string")
    assert row.select(deid.scrub(F.col("text"), deid.identifier_tokens(F.col("pid"), F.col("name")))).first()[0] == "[redacted] [redacted], [redacted]'s id [redacted] seen [date], uid [uid]"


def said(spark, labels, *texts):
    """What each text means among the objects ``labels`` (names, or name and type) of one model."""
    rows = [("m", str(i), i, *(n if isinstance(n, tuple) else (n, "anatomy"))) for i, n in enumerate(labels)]
    objects = spark.createDataFrame(rows, "model_id string, object_id string, obj_seq int, label string, obj_type string")
    spoken = spark.createDataFrame([(i, "m", t) for i, t in enumerate(texts)], "utterance_id int, model_id string, text string")
    found = {r["utterance_id"]: (r["intent"], r["action"], [int(t) for t in r["targets"]]) for r in utterances.resolve_utterances(spoken, objects).collect()}
    return [found[i] for i in range(len(texts))]


def test_utterances(spark):
    labels = ["kidney_right", "kidney_left", "rib_left_1", "rib_left_2", "rib_right_2", "nasal_sinus", "vertebrae_T5", "heart", ("series", "volume"), ("Dark spot", "region")]
    got = said(
        spark, labels,
        "Highlight the right kidneys, please", "show me the second rib", "the left and right kidney", "Select the nasal sinus", "t five", "right heart", "Reset the view", "clear it", "everything", "any abnormality", "left rib and the backbone", "nothing known", "stop spinning", "zoom in on the heart", None,
    )
    assert got == [
        ("highlight", None, [0]), ("highlight", None, [3, 4]), ("highlight", None, [1, 0]), ("highlight", None, [5]), ("highlight", None, [6]), ("unknown", None, []), ("view", "reset_view", []), ("clear", None, []),
        ("highlight", None, [0, 1, 2, 3, 4, 5, 6, 7, 9]), ("highlight", None, [9]), ("highlight", None, [2, 3, 6]), ("unknown", None, []), ("view", "spin_off", []), ("view", "zoom_in", []), ("unknown", None, []),
    ]


def test_findings_come_before_regions(spark):
    assert said(spark, ["heart", ("a lump", "finding"), ("Region 1", "region")], "is there anything wrong") == [("highlight", None, [1])]


def test_displayed_labels(spark):
    labels = ["lung_upper_lobe_left", "vertebrae_L1", "heart", "clavicula_right", "Liver lesion 2", "autochthon_left"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string").orderBy("i")
    assert [r[0] for r in rows.select(utterances.display_label(F.col("label"))).collect()] == ["Left lung · upper lobe", "Vertebra L1", "Heart", "Right clavicle", "Liver lesion 2", "Left deep back muscle"]


def test_json_texts_and_codes(spark):
    body = json.dumps({"id": "a", "code": {"text": "Ko, \"so\": {", "coding": [{"system": "s", "code": "c1", "display": "Knee"}, {"code": "c2"}]}, "bodySite": [{"text": "leg"}], "content": ["x, y", {"n": 3, "ok": True}], "subject": {"reference": "P/1"}})
    item = context.normalize_context(spark.createDataFrame([(0, body)], "seq int, body string"), "2024-01-01").first()
    assert (item["item_id"], item["type"], item["title"], item["date"]) == ("a", "context", 'Ko, "so": {', "2024-01-01")
    assert item["text"] == "x, y 3 true" and item["subject"] == "P/1"
    assert item["codes"] == 'Ko, "so": { s c1 Knee c2 leg'


def test_binding_by_code_label_and_words(spark):
    objects = spark.createDataFrame([("m", "o1", 1, "Left lung", None, "K-77"), ("m", "o2", 2, "heart valve", ["mitral"], None), ("m", "o3", 3, "lung", None, None)], "model_id string, object_id string, obj_seq int, label string, terms array<string>, code string")
    texts = ["see K-77 now", "the mitral one", "both lungs are left", "valves of hearts", "the lung", "none"]
    items = spark.createDataFrame([("m", i, "note", "", t, "", "") for i, t in enumerate(texts)], "model_id string, item_id int, type string, title string, text string, codes string, subject string")
    models = spark.createDataFrame([("m", "S1", "P1")], "model_id string, study_id string, patient_id string")
    found = {r["item_id"]: (r["target_type"], r["target_id"], r["score"], r["method"]) for r in context.bind_context(items, objects, models).collect()}
    assert found == {0: ("object", "o1", 0.98, "structured"), 1: ("object", "o2", 0.92, "text-extraction"), 2: ("object", "o1", 0.7, "text-extraction"), 3: ("object", "o2", 0.7, "text-extraction"), 4: ("object", "o3", 0.92, "text-extraction"), 5: ("patient", "P1", 0.5, "manual")}


def test_digests_are_shortened_step_by_step(spark):
    def one(model, n_regions, n_anatomy, note):
        kinds = [("finding", 1)] + [("region", k) for k in range(n_regions)] + [("anatomy", k) for k in range(n_anatomy)]
        rows = [(model, i, f"O{i}", f"{kind} number {k}", kind, float(k), 1.0, "unreviewed") for i, (kind, k) in enumerate(kinds)]
        edges = [(model, f"O{i}", "near", f"O{i + 1}", 2.0) for i in range(len(rows) - 1)]
        return rows, edges, [(model, 1, "note", None, note)]

    parts = [one("small", 2, 2, "x"), one("regions", 12, 0, "x"), one("long note", 2, 2, "y" * 3000), one("many", 3, 200, "x")]
    rows = spark.createDataFrame([r for p in parts for r in p[0]], "model_id string, obj_seq int, ref string, label string, obj_type string, volume_mm3 double, extent double, review_status string")
    edges = spark.createDataFrame([r for p in parts for r in p[1]], "model_id string, a string, relation string, b string, gap double")
    notes = spark.createDataFrame([r for p in parts for r in p[2]], "model_id string, item_id int, title string, about string, text string")
    none = spark.createDataFrame([], "model_id string, ref string, change string, volume_prior double, volume_now double")
    found = {r["model_id"]: (r["level"], json.loads(r["digest"])) for r in deid.model_digest(rows, edges, none, notes, 2600).collect()}
    assert {k: v[0] for k, v in found.items()} == {"small": 0, "regions": 0, "long note": 4, "many": 5}
    kept = [o for o in found["regions"][1]["objects"] if o["obj_type"] == "region"]
    assert sorted(o["volume_mm3"] for o in kept) == [4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0] and found["regions"][1]["omitted"] == 4
    assert found["long note"][1]["context"][0]["text"] == "y" * 200
    many = found["many"][1]
    assert many["relations"] == [] and many["omitted"] + len(many["objects"]) == 204
    assert len(json.dumps(many, separators=(",", ":"))) <= 2600 < len(json.dumps(many, separators=(",", ":"))) + 60


def test_normal_functions_and_sample_size(spark):
    p = spark.createDataFrame([(1.959963984540054,)], "z double").select(experiments.p_two_sided(F.col("z"))).first()[0]
    assert p == pytest.approx(0.05)
    q = spark.createDataFrame([(p / 1000,) for p in (1, 20, 24, 25, 500, 800, 975, 999)], "p double").select("p", experiments.norm_quantile(F.col("p")).alias("z"), experiments.norm_cdf(experiments.norm_quantile(F.col("p"))).alias("back"))
    for r in q.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-12) and r["back"] == pytest.approx(r["p"], abs=1e-14)
    z = spark.createDataFrame([(x / 2,) for x in range(-18, 19)], "z double").select("z", experiments.norm_cdf(F.col("z")).alias("p"))
    assert all(r["p"] == pytest.approx(NormalDist().cdf(r["z"]), rel=1e-9, abs=1e-15) for r in z.collect())
    shape = "kind string, alpha double, target_power double, p0 double, p1 double, delta double, sd double, hazard_ratio double, event_rate double, ratio double, dropout double"
    d = spark.createDataFrame([("binary", 0.05, 0.9, 0.25, 0.4, 1.0, 1.0, 0.5, 0.5, 1.0, 0.0), ("continuous", 0.05, 0.8, 0.1, 0.2, 5.0, 10.0, 0.5, 0.5, 1.0, 0.2), ("time-to-event", 0.05, 0.8, 0.1, 0.2, 1.0, 1.0, 0.5, 0.5, 1.0, 0.0)], shape)
    got = {r["kind"]: (r["control"], r["treatment"]) for r in experiments.sample_size(d).collect()}
    # (1.96 * sqrt(2 * 0.325 * 0.675) + 1.2816 * sqrt(0.1875 + 0.24))^2 / 0.15^2 = 202.8; 2 * 2.8016^2 * 100 / 25 = 62.8, over 0.8; 4 * 2.8016^2 / ln(2)^2 = 65.4 events
    assert got == {"binary": (203, 203), "continuous": (79, 79), "time-to-event": (66, 66)}


def test_linear_fit_recovers_a_line(spark):
    rows = spark.createDataFrame([(i, (i - 50) / 29.0, 2.0 * (i - 50) / 29.0 + 1) for i in range(100)], "model_id int, a double, y double")
    weights, bias = features.train_linear(rows, ("a",), iterations=2000, l2=0.0)
    assert weights["a"] == pytest.approx(2, abs=1e-3) and bias == pytest.approx(1, abs=0.02)


def test_readers(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"0020000D": {"vr": "UI", "Value": ["1.2"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Doe^Jane"}]}, "00280010": {"vr": "US", "Value": ["no number"]}, "00280011": {"vr": "US", "Value": [8]}}, indent=2))
    h = readers.read_dicom_json(spark, str(tmp_path / "h.json")).first()
    assert (h["study_uid"], h["patient_name"], h["rows"], h["columns"]) == ("1.2", "Doe^Jane", None, 8)
    (tmp_path / "many.json").write_text('[{"0020000D": {"Value": ["1"]}},\n {"0020000D": {"Value": ["2"]}}]')
    assert sorted(r["study_uid"] for r in readers.read_dicom_json(spark, str(tmp_path / "many.json")).collect()) == ["1", "2"]
    (tmp_path / "lines.json").write_text('{"0020000D": {"Value": ["1"]}}\n{"0020000D": {"Value": ["2"]}}\n')
    assert readers.read_dicom_json(spark, str(tmp_path / "lines.json"), lines=True).count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "DiagnosticReport", "id": "r1", "code": {"text": "Follow-up"}, "valueString": "stable"}}, {"resource": {"resourceType": "Note"}}]}))
    items = context.normalize_context(readers.read_context(spark, str(tmp_path / "b.json")), "2024-01-01").collect()
    assert [(i["item_id"], i["type"], i["title"], i["text"]) for i in items] == [("r1", "diagnosticreport", "Follow-up", "stable"), ("source-1", "note", "Note", "")]
    assert readers.file_manifest(spark, str(tmp_path)).count() == 4


def test_all_header_keywords(spark, tmp_path):
    values = {"00280030": ["0.5", 0.75], "00200032": [1, 2.5, "x"], "00200037": [1, 0, 0, 0, 1, 0], "0008103E": ["{axial}"], "00080016": ["1.2.3"], "00200011": ["7"], "00100020": [], "00081030": ["Chest", "other"]}
    (tmp_path / "h.json").write_text(json.dumps({t: {"vr": "UN", "Value": v} for t, v in values.items()} | {"00080060": {"vr": "CS"}}))
    h = readers.frame_geometry(readers.read_dicom_json(spark, str(tmp_path / "h.json"))).first()
    assert len(readers.TAGS) == 18
    assert (h["pixel_spacing"], h["image_position"], h["image_orientation"]) == ([0.5, 0.75], [1.0, 2.5, None], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])
    assert (h["series_description"], h["sop_class_uid"], h["series_number"], h["patient_id"], h["study_description"], h["modality"]) == ("{axial}", "1.2.3", 7, None, "Chest", None)
    assert (h["ox"], h["oy"], h["oz"], h["uy"], h["sx"], h["sy"]) == (1.0, 2.5, None, 1.0, 0.5, 0.75)


LABEL_FILES = {
    "csv": "model_id,label\nm1,1\nm2,\nm3,0\nm3,1\n,5\n",
    "json": '[{"model_id": "m1", "label": 1},\n {"id": "m2", "outcome": ""},\n {"id": "m3", "label": 0}, {"id": " m3", "label": 1},\n {"label": 5}, 17]',
    "lines": '{"id": "m1", "label": 1}\n{"id": "m2"}\n{"id": "m3", "label": "0"}\n{"id": "m3", "label": 1}\n{"label": 5}\n[17]\n',
}


@pytest.mark.parametrize("kind", LABEL_FILES)
def test_label_files_give_the_same_rows_and_rejects(spark, tmp_path, kind):
    (tmp_path / "l").write_text(LABEL_FILES[kind])
    good, bad = readers.read_labels(spark, str(tmp_path / "l"), kind)
    assert [tuple(r) for r in good.collect()] == [("m1", "1")]
    assert sorted((r["row"], r["reason"]) for r in bad.collect()) == [(3, "no label"), (4, "repeated"), (5, "repeated"), (6, "no id"), *([(7, "no object")] if kind != "csv" else [])]


def test_label_maps_and_rows_of_large_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('\ufeff{"labels": {\n "m1": 1,\n "m2": "",\n "m3": "yes"}}')
    good, bad = readers.read_labels(spark, str(tmp_path / "m.json"), "json")
    assert sorted(map(tuple, good.collect())) == [("m1", "1"), ("m3", "yes")]
    assert [(r["row"], r["model_id"], r["reason"]) for r in bad.collect()] == [(3, "m2", "no label")]
    (tmp_path / "big.csv").write_text("id,outcome\n" + "".join(f"m{i},{'' if i % 1000 == 7 else i}\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        _, bad = readers.read_labels(spark, str(tmp_path / "big.csv"))
        assert sorted(r["row"] for r in bad.collect()) == [i + 2 for i in range(30_000) if i % 1000 == 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_models_round_trip(spark, tmp_path):
    thing = {"id": "x", "type": "finding", "label": "Stone", "geometry": {"centroid": [1.0, 2.0, 3.5], "bounding_box": {"min": [0, 0, 0], "max": [2, 4, 7]}, "volume_mm3": 5.25, "coordinate_system": "patient"}, "metadata": {"a": {"b": [1, None, "c"]}}, "observations": [{"id": "o", "label": "size", "value": "about 5"}]}
    model = {"id": "m", "patient_id": "p", "study_id": "s", "objects": [thing, {"id": "y", "type": "volume", "label": "CT"}], "temporal_links": [{"id": "t", "source_object_id": "x", "target_object_id": "x", "type": "new", "confidence": 1, "changes": {"reason": "first", "n": 2}}], "timeline": [{"id": "e", "study_id": "s", "date": "20240101", "label": "Study", "model_id": "other"}], "context_items": [{"k": [1]}], "capabilities": {"ai": "off"}}
    bad = [{**model, "id": None}, {**model, "objects": [{**thing, "type": "dragon"}]}, {**model, "temporal_links": [{**model["temporal_links"][0], "type": "lost"}]}, {**model, "objects": [{**thing, "review_status": "odd"}]}]
    (tmp_path / "m.json").write_text("\n".join([json.dumps(model), "{broken", "", "[]", *map(json.dumps, bad), json.dumps({"id": "bare", "patient_id": "p", "study_id": "s"})]))
    tables = readers.flatten_models(readers.read_models(spark, str(tmp_path / "m.json")))
    assert sorted(r["model_id"] for r in tables["models"].collect()) == ["bare", "m"]
    assert [r["own_model_id"] for r in tables["timeline"].collect()] == ["other"] and tables["relationships"].count() == 0
    first = {r["model_id"]: r["document"] for r in writers.nest_models(tables).collect()}
    whole = json.loads(first["m"])
    assert whole["objects"][0]["metadata"] == thing["metadata"] and whole["objects"][0]["observations"][0]["value"] == "about 5"
    assert whole["temporal_links"][0]["changes"] == {"reason": "first", "n": 2} and whole["context_items"] == [{"k": [1]}] and whole["version"] == 1 and whole["objects"][1]["geometry"] is None
    spark.createDataFrame([(d,) for d in first.values()], "d string").write.text(str(tmp_path / "again"))
    again = writers.nest_models(readers.flatten_models(readers.read_models(spark, str(tmp_path / "again"))))
    assert {r["model_id"]: r["document"] for r in again.collect()} == first
    graph = {r["model_id"]: json.loads(r["document"]) for r in writers.export_graph(tables).collect()}
    assert graph["bare"]["objects"] == [] and graph["m"]["temporalLinks"][0]["id"] == "t" and graph["m"]["patientId"] == "p"


def test_search_by_id_and_vocabulary(spark):
    c = spark.createDataFrame([("K-1", 1, "Left kidney"), ("s-22", 2, "kidney stone 12 b7")], "object_id string, seq int, label string")
    assert {r["object_id"]: r["score"] for r in context.find_object(c, "k-1").collect()} == {"K-1": 0.7}
    assert {r["object_id"]: r["score"] for r in context.find_object(c, "Left Kidney ").collect()} == {"K-1": 1.0}
    assert context.find_object(c, "").count() == 2
    words = [r["word"] for r in context.label_vocabulary(c).orderBy("place").collect()]
    assert words[:2] == ["highlight", "clear"] and words[20:] == ["kidney", "stone", "b7"]
    assert context.label_vocabulary(c, 21).count() == 21


def test_classes_find_what_pairs_find(spark):
    rnd = random.Random(8)
    words = ["aa", "aab", "b", "stone", "left", "kid", "kidney"]
    labels = [(f"o{i:03}", " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(150)] + [("o999", None), ("o000b", "")]
    queries = [(i, " ".join(rnd.choices([*words, "no"], k=rnd.randint(0, 4))).upper()) for i in range(60)] + [(99, None)]
    first = {}
    for o, text in labels:
        if text is not None:
            first[text] = min(o, first.get(text, "z"))
    want = set()
    for q, text in queries:
        scores = sorted((-n, o) for t, o in first.items() if (n := sum(w in t for w in set((text or "").lower().split()))))
        want |= {(q, o, -n, k) for k, (n, o) in enumerate(scores[:5], 1)}
    c, a = spark.createDataFrame(labels, "object_id string, label string"), spark.createDataFrame(queries, "query_id int, query string")
    found = context.find_objects(c, a)
    assert {(r["query_id"], r["object_id"], r["score"], r["rank"]) for r in found.collect()} == want


def test_written_data_sets_are_read_as_labels(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "yes", 2.5, 9), ("m2", "no", 0.0, 9)], "model_id string, label string, object_count double, other int")
    writers.write_dataset_csv(rows, f"{tmp_path}/set", ["model_id", "label", "object_count"])
    assert spark.read.csv(f"{tmp_path}/set", header=True).columns == ["model_id", "label", "object_count"]
    good, bad = readers.read_labels(spark, f"{tmp_path}/set")
    assert {r["model_id"]: r["y"] for r in good.withColumn("y", features.coerce_label(F.col("label"), "binary")).collect()} == {"m1": 1.0, "m2": 0.0} and bad.isEmpty()


def test_plans_stay_in_the_jvm_and_without_products(spark):
    o = boxes(spark)
    plan = spatial.derive_relationships(o, grid=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
