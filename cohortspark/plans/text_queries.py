"""Queries on context, labels, de-identification, exports and streams (C, L, D, S, W), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import context, deid, graph, spatial, temporal
from cohortspark.plans.fixtures import OBJECTS_SQL, context_items, dealt_objects, object_tasks, objects, table, whole_objects
from cohortspark.plans.object_queries import contains_sql, gap_sql
from cohortspark.plans.registry import query
from cohortspark.sources import writers
from cohortspark.streaming import streams

O = f"WITH {OBJECTS_SQL}"  # noqa: E741
@query("c10_distinct_items", "SELECT min(doc_id) AS item_id, count(*) AS copies FROM documents GROUP BY text")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return context.dedupe_items(context_items(spark, d)).select("item_id", "copies")


@query("c11_search_context", "SELECT doc_id AS item_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'mit') ORDER BY doc_id LIMIT 8")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return context.search_context(context_items(spark, d), "MIT license")


@query("l01_find_object", f"{O} SELECT object_id, CASE WHEN lower(label) = 'promo' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM o WHERE contains(lower(label), 'promo')")
def l01(spark: SparkSession, d: str) -> DataFrame:
    return context.find_object(objects(spark, d), "PROMO")


@query("l01_find_by_id", f"{O} SELECT object_id, 0.7::DOUBLE AS score FROM o WHERE contains(object_id, '17:2')")
def l01b(spark: SparkSession, d: str) -> DataFrame:
    return context.find_object(objects(spark, d), " 17:2")


@query(
    "l11_vocabulary",
    "WITH f AS (SELECT unnest(range(1, 21)) AS place, unnest(['highlight', 'clear', 'show', 'mark', 'zoom', 'in', 'out', 'reset', 'spin', 'stop', 'abnormalities', 'findings', 'everything', 'and', 'left', 'right', 'upper', 'middle', 'lower', 'lobe']) AS word), w AS (SELECT p_partkey AS seq, unnest([lower(p_name), lower(p_type), 'upper', 'b7', '12']) AS part, unnest(range(5)) AS k FROM part), x AS (SELECT seq, k, unnest(string_split_regex(part, '[^a-z0-9]+')) AS word, generate_subscripts(string_split_regex(part, '[^a-z0-9]+'), 1) AS i FROM w), g AS (SELECT word, min((seq, k, i)) AS first FROM x WHERE word NOT IN ('', '12') AND word NOT IN (SELECT word FROM f) GROUP BY word) SELECT CAST(place AS INTEGER) AS place, word FROM f UNION ALL SELECT CAST(20 + n AS INTEGER), word FROM (SELECT word, row_number() OVER (ORDER BY first, word) AS n FROM g) WHERE n <= 44",
)
def l11(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws("_", "p_name", "p_type", F.lit("upper"), F.lit("b7"), F.lit("12"))
    return context.label_vocabulary(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), label.alias("label")))


#: Texts with identifiers and dates of every form, and what may be left of them, by customer number modulo their count. KEY stands for the customer's number.
FORMS = (
    ("Seen KEY on 2024-05-01, uid 1.2.840.10008.5.1", "Seen KEY on [date], uid [uid]"),
    ("2024/05/01 and 2024.05.01 and 20240501", "[date] and [date] and [date]"),
    ("2024-0501, 2024/05-01; x20240501 20240501x 120240501", "[date], [date]; x20240501 20240501x 120240501"),
    ("2024-13-01 2024-00-10 2024-05-32 1899-12-31 2100-01-01", "2024-13-01 2024-00-10 2024-05-32 1899-12-31 2100-01-01"),
    ("9.2.840.10008.5 0.1.2.3 0.1.2.3.4 12.1.2.3.4.5", "9.2.840.10008.5 0.1.2.3 [uid] 12.[uid]"),
    ("\t pKEY, (PKEY) PKEY-2 PKEYx _PKEY\n", "[redacted], ([redacted]) [redacted]-2 PKEYx _PKEY"),
    ("O'Neil \\E (a+b) von o'neil", "[redacted] [redacted] [redacted] von [redacted]"),
)


def forms_sql(column: str) -> str:
    quoted = ("'" + form[column == "clean"].replace("'", "''") + "'" for form in FORMS)
    cases = " ".join(f"WHEN {i} THEN replace({q}, 'KEY', CAST(c_custkey + 100 AS VARCHAR))" for i, q in enumerate(quoted))
    return f"CASE c_custkey % {len(FORMS)} {cases} END"


@query("d01_scrubbed", f"SELECT c_custkey, {forms_sql('clean')} AS clean FROM customer")
def d01(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("c_custkey") + 100).cast("string")
    text = F.coalesce(*(F.when(F.col("c_custkey") % len(FORMS) == i, F.replace(F.lit(raw), F.lit("KEY"), key)) for i, (raw, _) in enumerate(FORMS)))
    ids = deid.identifier_tokens(F.concat(F.lit(" P"), key), F.lit("O'Neil^(a+b) \\E^^jr"))
    names = F.concat(ids, F.array(F.lit("\\E")))
    return table(spark, d, "customer").select("c_custkey", deid.scrub(text, names).alias("clean"))


@query("d02_identifiers", "SELECT c_custkey, array_to_string([t FOR t IN list_distinct(list_prepend(concat('P', c_custkey), regexp_split_to_array(c_name, '[\\^\\s,]+'))) IF length(t) >= 3].list_sort(), ',') AS tokens FROM customer")
def d02(spark: SparkSession, d: str) -> DataFrame:
    found = deid.identifier_tokens(F.concat(F.lit("P"), F.col("c_custkey").cast("string")), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(found), ",").alias("tokens"))


#: Notes that hold a UID, a patient's id (three digits or more), or neither.
NOTE = "CASE o_orderkey % 3 WHEN 0 THEN concat('order ', o_orderkey, ' uid 1.2.840.10008.5') WHEN 1 THEN concat('seen by x', o_custkey, 'y') ELSE 'nothing to see' END"


@query("d04_violations", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND length(CAST(o_custkey AS VARCHAR)) >= 3)")
def d04(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("pid"), F.expr(NOTE).alias("text"))
    return deid.violations(o, "text", "pid").select("o_orderkey")


#: Notes whose identifiers scrubbing takes out.
OPEN_NOTE = "CASE o_orderkey % 3 WHEN 0 THEN 'uid 1.2.840.10008.5.1.4 of 2024.05.01' WHEN 1 THEN concat('seen by p', o_custkey + 100, ' on 2024/05/01') ELSE 'nothing to see' END"


@query("d04_asserted", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'uid [uid] of [date]' WHEN 1 THEN 'seen by [redacted] on [date]' ELSE 'nothing to see' END AS text FROM orders")
def d04b(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("P"), (F.col("o_custkey") + 100).cast("string")).alias("pid"), F.expr(OPEN_NOTE).alias("text"))
    clean = o.withColumn("text", deid.scrub(F.col("text"), deid.identifier_tokens(F.col("pid"), F.lit(None).cast("string"))))
    return deid.assert_deidentified(clean, "text", "pid").select("o_orderkey", "text")


@query("d05_synthetic", "SELECT o_orderkey, (o_orderkey % 4 = 0 OR o_custkey % 5 = 0) AS synthetic FROM orders")
def d05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, "A Phantom of the chest").when(F.col("o_orderkey") % 4 == 1, None).otherwise("chest")
    pid = F.when(F.col("o_custkey") % 5 == 0, "demo-1").otherwise("P-1")
    return o.select("o_orderkey", deid.is_synthetic(text, pid).alias("synthetic"))


@query("d03_d06_object_rows", f"{O} SELECT model_id, concat('O', obj_seq) AS ref, label, obj_type, volume_mm3, greatest(x1-x0, y1-y0, z1-z0) AS extent, cx, cy, cz, review_status FROM o")
def d06(spark: SparkSession, d: str) -> DataFrame:
    return deid.object_rows(objects(spark, d))


@query(
    "d03_refs",
    f"{O}, k AS (SELECT * REPLACE (CASE WHEN obj_seq = 4 THEN 'volume' ELSE obj_type END AS obj_type, CASE WHEN obj_seq = 5 THEN 'rejected' ELSE review_status END AS review_status) FROM o), pr AS (SELECT *, lag(model_id) OVER (PARTITION BY patient_id ORDER BY study_date, model_id) AS prior_id FROM (SELECT DISTINCT patient_id, model_id, study_date FROM o)) SELECT model_id, object_id, concat('O', obj_seq) AS ref FROM k WHERE obj_type <> 'volume' AND review_status <> 'rejected' UNION ALL SELECT pr.model_id, object_id, concat('P', obj_seq) FROM pr JOIN k ON k.model_id = prior_id WHERE obj_seq IN (2, 4, 5) AND obj_type <> 'volume'",
)
def d03(spark: SparkSession, d: str) -> DataFrame:
    """Links that call three objects of each prior resolved, one of them a volume and one rejected."""
    o = objects(spark, d)
    o = o.withColumns({"obj_type": F.when(F.col("obj_seq") == 4, "volume").otherwise(F.col("obj_type")), "review_status": F.when(F.col("obj_seq") == 5, "rejected").otherwise(F.col("review_status"))})
    priors = temporal.select_prior(temporal.models(o))
    gone = temporal.prior_objects(o, priors).where("obj_seq in (2, 4, 5)").select("model_id", "prior_id", "object_id", F.lit("resolved").alias("link_type"))
    other = temporal.prior_objects(o, priors).where("obj_seq = 1").select("model_id", "prior_id", "object_id", F.lit("changed_from").alias("link_type"))
    return deid.alias_refs(o, gone.unionByName(other)).select("model_id", "object_id", "ref")


@query("d09_object_keys", f"{O} SELECT object_id, substr(sha256(concat(model_id, ':', object_id)), 1, 24) AS key FROM o")
def d09(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("object_id", deid.object_key(F.col("model_id"), F.col("object_id")).alias("key"))


#: Bytes of a digest: few enough that models of every size fall under some step of the shortening.
BYTES = 1200
#: Objects of which one task makes the digests, on average: fewer than elsewhere, since it holds several sorted copies of them.
DIGESTED_A_TASK = 50_000


def digests(spark: SparkSession, d: str) -> DataFrame:
    """Relations are derived between refs, and refs are carried through the comparison, so all parts of a digest stay where their model is; only models and prior objects are dealt again."""
    o = whole_objects(spark, d, DIGESTED_A_TASK)
    rows, shown = deid.object_rows(o, "obj_seq"), deid.with_refs(o)
    near = graph.collapse_relations(spatial.derive_relationships(shown.withColumn("object_id", F.col("ref")))).select("model_id", F.col("source_id").alias("a"), F.col("type").alias("relation"), F.col("target_id").alias("b"), F.round("value", 1).alias("gap"))
    told = temporal.current_changes(deid.with_refs(o, every=True), temporal.select_prior(temporal.models(o)), ("ref",), object_tasks(spark, d, DIGESTED_A_TASK))
    changes = told.where("ref is not null").select("model_id", "ref", F.col("link_type").alias("change"), "volume_prior", "volume_now")
    notes = o.where("obj_seq = 1").select("model_id", F.col("object_id").alias("item_id"), F.lit("note").alias("title"), F.lit("O1").alias("about"), F.repeat("label", 20).alias("text"))
    return deid.model_digest(rows, near, changes, notes, BYTES)


@query("d07_d08_digests")
def d07(spark: SparkSession, d: str) -> DataFrame:
    return digests(spark, d)


@query("s03_frame_voxels", "SELECT vec_id AS series, label AS frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(embedding[y*8+x+1] AS DOUBLE) AS value FROM embeddings, range(8) a(y), range(8) b(x)")
def s03(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    frames = table(spark, d, "embeddings").select(F.col("vec_id").alias("series"), F.col("label").alias("frame"), rows.alias("pixels"))
    return writers.frames_to_voxels(frames).withColumn("value", F.col("value").cast("double"))


@query(
    "s11_search_documents",
    f"{O} SELECT 'patient_model' AS entity_type, CAST(model_id AS VARCHAR) AS entity_id, concat(string_agg(label, ' ' ORDER BY obj_seq), ' ', string_agg(concat(label, ' volume ', CAST(round(volume_mm3) AS BIGINT), ' surface ', CASE WHEN obj_seq = 2 THEN 'None' ELSE CAST(CAST(round(surface_area_mm2) AS BIGINT) AS VARCHAR) END), ' ' ORDER BY obj_seq)) AS search_text, string_agg(label, '; ' ORDER BY obj_seq) AS labels, string_agg(DISTINCT obj_type, ',' ORDER BY obj_type) AS types, string_agg(DISTINCT review_status, ',' ORDER BY review_status) AS states, count(*) AS object_count, count(*) - 1 AS relationship_count, count(*) FILTER (WHERE obj_seq % 2 = 0) AS context_count FROM o GROUP BY model_id",
)
def s11(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).withColumns({c: F.round(c).cast("long") for c in ("volume_mm3", "surface_area_mm2")})
    o = o.withColumn("surface_area_mm2", F.when(F.col("obj_seq") != 2, F.col("surface_area_mm2")))
    found = writers.search_documents(o, o.where("obj_seq > 1").select("model_id"), o.where("obj_seq % 2 = 0").select("model_id"))
    return found.withColumns({"labels": F.array_join("labels", "; "), "types": F.array_join("types", ","), "states": F.array_join("states", ",")})


@query("s11_study_documents", "SELECT 'study' AS entity_type, CAST(o_orderkey AS VARCHAR) AS entity_id, CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderstatus, ' ready') ELSE concat(o_orderpriority, ' ', o_orderstatus, ' ready') END AS search_text, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS description, o_orderstatus AS modality, 'ready' AS status, coalesce(n, 0) AS image_count, coalesce(s, 0) AS series_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey % 3) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def s11b(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("image_count"), F.count_distinct(F.col("l_suppkey") % 3).alias("series_count"))
    studies = table(spark, d, "orders").join(counts, "o_orderkey", "left")
    studies = studies.select(F.col("o_orderkey").alias("study_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("description"), F.col("o_orderstatus").alias("modality"), F.lit("ready").alias("status"), F.col("o_orderdate").alias("study_date"), "image_count", "series_count", F.lit("Doe^Jane").alias("patient_name"))
    return writers.study_documents(studies).drop("study_date", "model_id", "created_at")


@query("s10_context_bundles")
def s10(spark: SparkSession, d: str) -> DataFrame:
    o = dealt_objects(spark, d)
    bindings = o.where("obj_seq % 2 = 0").select("model_id", F.lit("object").alias("target_type"), F.col("object_id").alias("target_id"), F.concat(F.lit("binding:"), "object_id").alias("binding_id"))
    links = temporal.link_types(o, temporal.select_prior(temporal.models(o)), tasks=object_tasks(spark, d))
    return writers.export_context_bundles(o, spatial.nearest(o, 6), bindings, links)


@query(
    "s10_bundle_items",
    f"{O} SELECT model_id, object_id, near_id, CAST(rank AS INTEGER) AS rank, round(gap, 6) AS gap, binding_id FROM (SELECT a.model_id, a.object_id, b.object_id AS near_id, {gap_sql('a', 'b')} AS gap, CASE WHEN a.obj_seq % 2 = 0 THEN 'binding:' || a.object_id END AS binding_id, row_number() OVER (PARTITION BY a.model_id, a.obj_seq ORDER BY {gap_sql('a', 'b')}, b.obj_seq) AS rank FROM o a JOIN o b ON a.model_id=b.model_id AND a.obj_seq<>b.obj_seq WHERE NOT {contains_sql('b', 'a')}) WHERE rank <= 6",
)
def s10b(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON of the bundles says of nearby objects and bindings."""
    read = F.from_json("bundle", "nearby_objects array<struct<rank:int,near_id:string,gap:double>>, context_bindings array<struct<binding_id:string>>")
    listed = s10(spark, d).select("model_id", "object_id", read.alias("b")).select("model_id", "object_id", F.get("b.context_bindings", F.lit(0))["binding_id"].alias("binding_id"), F.inline("b.nearby_objects"))
    return listed.withColumn("gap", F.round("gap", 6))


@query("s12_artifacts", "SELECT o_orderkey AS artifact_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def s12(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payload"))
    return writers.list_artifacts(registry)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream."""
    schema = table(spark, d, "events").schema
    return streams.stream_table(spark, d, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, with a last event a year later so that the watermark closes every window that counts. Nothing closes that event's own window, so it is never emitted."""
    events = table(spark, d, "events")
    last = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 366 DAYS")).alias("last"))
    closing = last.select(*((F.col("last") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
    folder = streams.shared_folder(events)
    closing.write.parquet(folder)
    end = streams.stream_table(spark, folder, "*.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return event_stream(spark, d).unionByName(end)


@query("w02_stream_counts")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_once(streams.audit_counts(closed_stream(spark, d)))


@query("w06_stream_sessions")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_once(streams.sessions(closed_stream(spark, d)))


@query("w02_sliding_counts", "WITH k AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 900 * i AS start, event_type FROM events, range(4) r(i)) SELECT start, start + 3600 AS \"end\", event_type, count(*) AS n FROM k GROUP BY ALL")
def w02b(spark: SparkSession, d: str) -> DataFrame:
    found = streams.run_once(streams.audit_counts(closed_stream(spark, d), "1 hour", "15 minutes"))
    return found.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "event_type", "n")


@query(
    "w06_session_spans",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
)
def w06b(spark: SparkSession, d: str) -> DataFrame:
    found = streams.run_once(streams.sessions(closed_stream(spark, d)))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("w01_unique_arrivals", "SELECT user_id, event_type, count(DISTINCT (user_id, event_type)) AS n FROM events GROUP BY user_id, event_type")
def w01(spark: SparkSession, d: str) -> DataFrame:
    found = streams.unique_arrivals(event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days")
    return streams.run_once(found.select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w04_stream_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return streams.upsert_batches(event_stream(spark, d).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return streams.stream_table(spark, d, "orders.parquet", orders.schema).select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("study_date"))


@query("w05_stream_priors", "SELECT o_custkey AS patient_id, o_orderkey AS model_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior_id FROM orders")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return streams.enrich_prior(arrivals(spark, d))[0]


@query("w05_stream_links", f"{O}, pr AS (SELECT o_orderkey AS model_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior_id FROM orders), c AS (SELECT model_id, count(*) AS n FROM o GROUP BY model_id), t AS (SELECT pr.model_id, prior_id, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before FROM pr LEFT JOIN c a ON a.model_id = pr.model_id LEFT JOIN c b ON b.model_id = prior_id WHERE prior_id IS NOT NULL) SELECT model_id, prior_id, now AS current_objects, before AS prior_objects FROM t WHERE now + before > 0")
def w05b(spark: SparkSession, d: str) -> DataFrame:
    """Every object of both models is in one link: the matched ones in one together."""
    _, links = streams.enrich_prior(arrivals(spark, d), objects(spark, d))
    now, then = F.col("link_type") != "resolved", F.col("link_type") != "new"
    return links.groupBy("model_id", "prior_id").agg(F.count_if(now).alias("current_objects"), F.count_if(then).alias("prior_objects"))


@query("w03_stream_job_state", "SELECT user_id AS job_id, CASE arg_max(event_type, (ts, event_type)) WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, arg_max(event_type, (ts, event_type)) AS stage FROM events GROUP BY user_id")
def w03(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    updates = closed_stream(spark, d).select(F.coalesce("user_id", F.lit(-1)).alias("job_id"), status.alias("status"), F.coalesce("event_type", F.lit("")).alias("stage"), F.col("ts").alias("updated_at"))
    return streams.run_once(streams.job_state(updates, timeout="200 days"), settings=streams.ROCKS_DB).where("job_id >= 0").select("job_id", "status", "stage")
