"""Queries on context, bindings and utterances (C, L), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import context, utterances
from cohortspark.plans.fixtures import OBJECTS_SQL, objects, table
from cohortspark.plans.registry import query

#: Models that documents and benchmark passages are dealt to.
MODELS = 7


def items(spark: SparkSession, d: str) -> DataFrame:
    """Context items: documents, dealt to models."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") % MODELS).alias("model_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 10 == 3, "imagingstudy").otherwise("note").alias("type"), F.coalesce("source", F.lit("none")).alias("title"),
        F.concat_ws("-", F.lit(2024), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("15")).alias("date"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("codes"), F.lit("").alias("subject"),
    )


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Objects named by words of benchmark passages: two for the label, the third another term, the fourth and fifth a code."""
    words = F.split("text", " ")
    return table(spark, d, "benchmark").select(
        (F.col("item_id") % MODELS).alias("model_id"), F.col("item_id").alias("object_id"), F.col("item_id").alias("obj_seq"), F.array_join(F.slice(words, 1, 2), " ").alias("label"),
        F.array(F.get(words, F.lit(2))).alias("terms"), F.array_join(F.slice(words, 4, 2), " ").alias("code"),
    )


def studies(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "benchmark").select((F.col("item_id") % MODELS).alias("model_id")).distinct()
    return ids.select("model_id", F.concat(F.lit("the"), "model_id").alias("study_id"), F.concat(F.lit("P"), "model_id").alias("patient_id"))


ITEMS_SQL = f"""
it AS (SELECT doc_id % {MODELS} AS model_id, doc_id AS item_id, CASE WHEN doc_id % 10 = 3 THEN 'imagingstudy' ELSE 'note' END AS type, coalesce(source, 'none') AS title,
  concat('2024-', lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), '-15') AS date, coalesce(text, '') AS text, lower(concat_ws(' ', coalesce(source, 'none'), coalesce(text, ''), coalesce(lang, ''), '')) AS hay FROM documents),
ob AS (SELECT item_id % {MODELS} AS model_id, item_id AS object_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS label, lower(string_split(text, ' ')[3]) AS term, lower(array_to_string(string_split(text, ' ')[4:5], ' ')) AS code FROM benchmark),
pr AS (SELECT it.model_id, item_id, object_id, hay, ob.label, term, code, len([w FOR w IN regexp_split_to_array(ob.label, '[^a-z0-9]+') IF length(w) > 2 AND contains(hay, w)]) AS hits FROM it JOIN ob USING (model_id)),
sc AS (SELECT model_id, item_id, object_id, round(CASE WHEN code <> '' AND contains(hay, code) THEN 0.98::DOUBLE
    WHEN length(label) > 2 AND contains(hay, label) AND regexp_matches(hay, concat('(^|[^\\p{{L}}\\p{{N}}_])', regexp_escape(label), '($|[^\\p{{L}}\\p{{N}}_])')) THEN 0.92::DOUBLE
    WHEN length(term) > 2 AND contains(hay, term) AND regexp_matches(hay, concat('(^|[^\\p{{L}}\\p{{N}}_])', regexp_escape(term), '($|[^\\p{{L}}\\p{{N}}_])')) THEN 0.92::DOUBLE
    WHEN hits > 0 THEN least(0.82::DOUBLE, 0.46::DOUBLE + 0.12::DOUBLE * hits) ELSE 0 END, 3) AS score FROM pr),
be AS (SELECT model_id, item_id, object_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, object_id) AS n FROM sc WHERE score > 0) WHERE n = 1),
fb AS (SELECT it.model_id, item_id, CASE WHEN contains(hay, concat('the', model_id)) OR type = 'imagingstudy' THEN 'study' ELSE 'patient' END AS target_type FROM it WHERE item_id NOT IN (SELECT item_id FROM be) AND model_id IN (SELECT model_id FROM ob)),
bi AS (
  SELECT model_id, item_id, 'object' AS target_type, CAST(object_id AS VARCHAR) AS target_id, score, CASE WHEN score >= 0.98 THEN 'structured' ELSE 'text-extraction' END AS method, concat('binding:', item_id, ':', object_id) AS binding_id FROM be
  UNION ALL SELECT model_id, item_id, target_type, CASE target_type WHEN 'study' THEN concat('the', model_id) ELSE concat('P', model_id) END, 0.5::DOUBLE, 'manual', concat('binding:', item_id, ':', target_type) FROM fb)
"""
I = f"WITH {ITEMS_SQL}"  # noqa: E741


def with_text_ids(objects_: DataFrame) -> DataFrame:
    return objects_.withColumn("object_id", F.col("object_id").cast("string"))


def bindings(spark: SparkSession, d: str) -> DataFrame:
    return context.bind_context(items(spark, d), with_text_ids(catalogue(spark, d)), studies(spark, d))


@query("c04_binding_scores", f"{I} SELECT model_id, item_id, object_id, object_id AS obj_seq, score FROM sc WHERE score > 0")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return context.score_bindings(items(spark, d), catalogue(spark, d))


@query("c05_best_bindings", f"{I} SELECT * FROM be")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return context.bind_best(context.score_bindings(items(spark, d), catalogue(spark, d)))


@query("c06_bindings", f"{I} SELECT bi.*, it.title, substr(it.text, 1, 280) AS evidence, 'unreviewed' AS review_status FROM bi JOIN it USING (model_id, item_id)")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return bindings(spark, d)


def known_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that models have already: those of documents whose id ends in 0."""
    return items(spark, d).where("item_id % 10 = 0").select("model_id", F.concat(F.lit("source:"), "item_id").alias("source_id"), "title", F.substring("text", 1, 280).alias("excerpt"))


@query("c07_new_sources", f"{I} SELECT model_id, concat('source:', item_id) AS source_id, title, substr(text, 1, 280) AS excerpt FROM it WHERE item_id % 10 <> 0 AND model_id IN (SELECT model_id FROM ob)")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return context.attach_sources(bindings(spark, d), known_sources(spark, d))[0]


@query("c07_attached_bindings", f"{I} SELECT model_id, target_id AS object_id, string_agg(binding_id, ',' ORDER BY binding_id) AS bindings FROM bi WHERE target_type = 'object' GROUP BY ALL")
def c07b(spark: SparkSession, d: str) -> DataFrame:
    return context.attach_sources(bindings(spark, d), known_sources(spark, d))[1].withColumn("bindings", F.array_join("bindings", ","))


@query(
    "c08_context_queries",
    f"""{I}, q AS (SELECT item_id AS query_id, item_id % {MODELS} AS model_id, CASE WHEN item_id % 4 = 0 THEN 'no such text' ELSE lower(trim(string_split(text, ' ')[3])) END AS query, CAST(item_id AS VARCHAR) AS wanted FROM benchmark),
h AS (SELECT query_id, bi.model_id, binding_id, concat('source:', item_id) AS source_id, round(CASE WHEN wanted = target_id THEN 1.0::DOUBLE ELSE score END, 3) AS score FROM bi JOIN it USING (model_id, item_id) JOIN q ON q.model_id = bi.model_id
  LEFT JOIN ob ON ob.model_id = bi.model_id AND CAST(ob.object_id AS VARCHAR) = target_id WHERE contains(lower(concat_ws(' ', title, substr(text, 1, 280), coalesce(ob.label, ''))), query))
SELECT * FROM h UNION ALL
SELECT query_id, q.model_id, NULL, concat('source:', item_id), 0.25::DOUBLE FROM q JOIN it ON it.model_id = q.model_id WHERE query_id NOT IN (SELECT query_id FROM h) AND contains(lower(concat_ws(' ', title, substr(text, 1, 280))), query)""",
)
def c08(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % MODELS).alias("model_id"), F.when(F.col("item_id") % 4 == 0, "no such text").otherwise(F.get(F.split("text", " "), F.lit(2))).alias("query"), F.col("item_id").cast("string").alias("object_id"))
    sources = items(spark, d).select("model_id", F.concat(F.lit("source:"), "item_id").alias("source_id"), "title", F.substring("text", 1, 280).alias("excerpt"))
    return context.context_query(bindings(spark, d), sources, with_text_ids(catalogue(spark, d)), asked)


@query("c09_source_details", f"{I} SELECT model_id, concat('source:', item_id) AS source_id, title, substr(text, 1, 280) AS excerpt, binding_id AS bindings FROM it JOIN bi USING (model_id, item_id) WHERE item_id % 10 = 0")
def c09(spark: SparkSession, d: str) -> DataFrame:
    return context.source_detail(known_sources(spark, d), bindings(spark, d)).withColumn("bindings", F.array_join("bindings", ","))


@query(
    "c12_context_digest",
    f"""{I} SELECT it.model_id, item_id, title, type, CAST(date_diff('day', CAST(date AS DATE), DATE '2024-07-01') AS INTEGER) AS days_before_study, CASE WHEN target_type = 'object' THEN concat('O', target_id) END AS about,
substr(concat('[redacted] of [date], [date], [date], [date], not 2024-13-40, [uid]', rtrim(regexp_replace(regexp_replace(concat(' ', text), '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '\\b(19|20)\\d\\d[-/.]?(0[1-9]|1[012])[-/.]?(0[1-9]|[12]\\d|3[01])\\b', '[date]', 'g'))), 1, 600) AS text FROM it JOIN bi USING (model_id, item_id)""",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    refs = catalogue(spark, d).select("model_id", F.col("object_id").cast("string").alias("object_id"), F.concat(F.lit("O"), "object_id").alias("ref"))
    facts = studies(spark, d).select("model_id", F.lit("20240701").alias("study_date"), F.array(F.concat(F.lit("no-such-patient-"), "model_id")).alias("identifiers"))
    told = F.concat(F.lit(" No-such-patient-"), F.col("model_id").cast("string"), F.lit(" of 2024-05-01, 2024/05/01, 2024.05.01, 20240501, not 2024-13-40, 1.2.840.10008.5 "), "text")
    return context.context_digest(items(spark, d).withColumn("text", told), bindings(spark, d), refs, facts)


@query("a07_reviewed_bindings", f"{I} SELECT model_id, binding_id, CASE WHEN item_id % 6 = 0 THEN 'confirmed' WHEN item_id % 6 = 2 THEN 'rejected' ELSE 'unreviewed' END AS review_status FROM bi")
def a07(spark: SparkSession, d: str) -> DataFrame:
    own = bindings(spark, d)
    status = F.when(F.col("item_id") % 6 == 0, "confirmed").when(F.col("item_id") % 6 == 2, "rejected").otherwise("no such status")
    reviews = own.where("item_id % 2 = 0").select("model_id", "binding_id", status.alias("status"))
    return context.apply_binding_reviews(own, reviews).select("model_id", "binding_id", "review_status")


# --- utterances


def named_objects(spark: SparkSession, d: str) -> DataFrame:
    """The objects of a model under names with a type, a side and a number."""
    o = objects(spark, d)
    side = F.when(F.col("obj_seq") % 3 == 0, "_left").when(F.col("obj_seq") % 3 == 1, "_right").otherwise("")
    kind = F.when(F.col("obj_seq") == 7, "volume").otherwise(F.col("obj_type"))
    return o.select("model_id", "object_id", "obj_seq", kind.alias("obj_type"), F.concat(F.lower("label"), F.when(F.col("cx") % 2 == 0, "_widget").otherwise("_bolts"), side, F.when(F.col("obj_seq") > 3, F.concat(F.lit("_"), F.col("obj_seq"))).otherwise("")).alias("label"))


#: What is said of a model, by its number modulo 8; ``{t}`` is the name of its first object.
SAID = ("Show me the {t} widgets", "right {t} and the small BOLT", "Reset the view", "please highlight everything", "any suspicious findings, or the {t}", "clear", "the left and {t} plus fourth bolt", "Rotate it again", "Mark the wind-pipe, RIBS & backbone one!", "Zoom in on c first, um, {t} boxes")
#: What is left of them, the words that count, and what is asked for.
HEARD = (
    ("show me the {t} widgets", "show {t} widget", "highlight", None), ("right {t} and the small bolt", "right {t} small bolt", "unknown", None), ("reset the view", "reset view", "view", "reset_view"),
    ("please highlight everything", "highlight everything", "highlight", None), ("any suspicious findings or the {t}", "any suspiciou finding or {t}", "unknown", None), ("clear", "clear", "clear", None),
    ("the left and {t} plus 4 bolt", "left {t} plu 4 bolt", "unknown", None), ("rotate it again", "rotate it again", "view", "spin_on"),
    ("mark the trachea rib vertebrae 1", "mark trachea rib vertebrae 1", "highlight", None), ("zoom in on c1 um {t} boxes", "zoom c1 {t} box", "view", "zoom_in"),
)


def spoken(spark: SparkSession, d: str) -> DataFrame:
    first = objects(spark, d).groupBy("model_id").agg(F.min_by(F.lower("label"), "obj_seq").alias("t"))
    text = F.coalesce(*(F.when(F.col("model_id") % len(SAID) == i, F.replace(F.lit(s), F.lit("{t}"), F.col("t"))) for i, s in enumerate(SAID)))
    return first.select(F.col("model_id").alias("utterance_id"), "model_id", text.alias("text"))


#: Rules of the texts above, in the order in which they apply.
RULES = ((r"\bwind pipe\b", "trachea"), (r"\bbackbone\b", "vertebrae"), (r"\bribs\b", "rib"), (r"\bone\b", "1"), (r"\bfirst\b", "1"), (r"\bfourth\b", "4"), (r"\b([a-z]) ([0-9]{1,2})\b", r"\1\2"))


def normal_sql(text: str) -> str:
    out = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, by in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def heard_sql(place: int) -> str:
    told = ("NULL" if row[place] is None else f"replace('{row[place]}', '{{t}}', t)" for row in HEARD)
    return f"CASE model_id % {len(HEARD)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(told))} END"


def stem_sql(w: str) -> str:
    cut = lambda n: f"substr({w}, 1, length({w}) - {n})"
    return f"""CASE WHEN length({w}) > 3 AND suffix({w}, 'es') AND NOT suffix({w}, 'ees') THEN CASE WHEN regexp_matches({cut(2)}, '(s|x|ch|sh)$') THEN {cut(2)} ELSE {cut(1)} END
 WHEN length({w}) > 3 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN {cut(1)} ELSE {w} END"""


_SAID_SQL = " ".join(f"WHEN {i} THEN replace('{s}', '{{t}}', t)" for i, s in enumerate(SAID))
SPOKEN_SQL = f"""WITH {OBJECTS_SQL}, nm AS (SELECT model_id, object_id, obj_seq, CASE WHEN obj_seq = 7 THEN 'volume' ELSE obj_type END AS obj_type,
  concat(lower(label), CASE WHEN cx % 2 = 0 THEN '_widget' ELSE '_bolts' END, CASE obj_seq % 3 WHEN 0 THEN '_left' WHEN 1 THEN '_right' ELSE '' END, CASE WHEN obj_seq > 3 THEN concat('_', obj_seq) ELSE '' END) AS label FROM o),
ut AS (SELECT model_id, t, CASE model_id % {len(SAID)} {_SAID_SQL} END AS text FROM (SELECT model_id, arg_min(lower(label), obj_seq) AS t FROM o GROUP BY model_id)),
nu AS (SELECT model_id, {normal_sql("text")} AS n FROM ut),
vw AS (SELECT nu.*, {heard_sql(3)} AS action, {heard_sql(2)} = 'clear' AS clears, {heard_sql(2)} AS intent FROM nu JOIN ut USING (model_id))
"""


@query("l03_l04_tokens", f"{SPOKEN_SQL} SELECT model_id AS utterance_id, {heard_sql(0)} AS normal, {heard_sql(1)} AS words FROM ut")
def l03(spark: SparkSession, d: str) -> DataFrame:
    normal = spoken(spark, d).withColumn("normal", utterances.normalize_utterance(F.col("text")))
    return normal.select("utterance_id", "normal", F.array_join(utterances.tokens(F.col("normal")), " ").alias("words"))


@query("l10_intents", f"{SPOKEN_SQL} SELECT model_id AS utterance_id, {heard_sql(2)} AS intent, {heard_sql(3)} AS action FROM ut")
def l10(spark: SparkSession, d: str) -> DataFrame:
    return utterances.heard(spoken(spark, d)).select("utterance_id", F.col("said").alias("intent"), "action")


#: Words of the texts above that do not count.
UNHEARD = "'the', 'and', 'me', 'please', 'in', 'on', 'um'"
CLAUSES_SQL = f"""{SPOKEN_SQL}, cl AS (SELECT model_id, [c FOR c IN string_split_regex(n, ' (?:and|plus|also|as well as|along with|together with) ') IF trim(c) <> ''] AS cs FROM vw WHERE action IS NULL AND NOT clears),
ca AS (SELECT model_id, unnest(cs) AS own, generate_subscripts(cs, 1) AS clause, cs FROM cl),
tr AS (SELECT model_id, clause, 0 AS attempt, own AS words FROM ca UNION ALL SELECT model_id, clause, 1, concat(own, ' ', cs[clause + 1]) FROM ca WHERE clause < len(cs)),
kd AS (SELECT *, CASE WHEN regexp_matches(words, '\\beverything\\b') THEN 'everything' WHEN regexp_matches(words, '\\b(suspicious|findings)\\b') THEN 'abnormalities' END AS kind,
  [{stem_sql("w")} FOR w IN string_split(words, ' ') IF w <> '' AND w NOT IN ({UNHEARD})] AS said FROM tr),
lb AS (SELECT *, [w FOR w IN string_split(label, '_') IF w IN ('left', 'right')][1] AS side, [{stem_sql("w")} FOR w IN string_split(label, '_') IF w NOT IN ('left', 'right')] AS names FROM nm WHERE obj_type <> 'volume'),
mt AS (SELECT kd.model_id, clause, attempt, object_id, obj_seq, label, obj_type, kind, names, side, said, [w FOR w IN said IF w IN ('left', 'right')][1] AS side_said, len([w FOR w IN names IF list_contains(said, w)]) AS matched,
  [w FOR w IN said IF regexp_full_match(w, '[0-9]+')] AS n_said, [w FOR w IN names IF regexp_full_match(w, '[0-9]+')] AS n_own FROM kd JOIN lb USING (model_id)),
fi AS (SELECT DISTINCT model_id FROM nm WHERE obj_type IN ('finding', 'lesion')),
se AS (SELECT *, CASE WHEN kind = 'everything' THEN 1.0::DOUBLE
  WHEN kind = 'abnormalities' THEN CASE WHEN model_id IN (SELECT model_id FROM fi) THEN CASE WHEN obj_type IN ('finding', 'lesion') THEN 1.0 ELSE 0.0 END WHEN obj_type = 'region' OR regexp_matches(lower(label), 'high.intensity|nodule|lesion|mass|tumou?r|unlabeled') THEN 1.0 ELSE 0.0 END
  WHEN matched = 0 OR (side_said IS NOT NULL AND (side IS NULL OR side <> side_said)) OR (len(n_said) > 0 AND len(n_own) > 0 AND NOT list_has_any(n_said, n_own)) THEN 0.0
  ELSE matched / len(names) + CASE WHEN side_said = side THEN 0.25 ELSE 0.0 END END AS score FROM mt),
wi AS (SELECT *, max(score) OVER (PARTITION BY model_id, clause, attempt) AS best FROM se WHERE score > 0),
on_ AS (SELECT *, min(attempt) OVER (PARTITION BY model_id, clause) AS first FROM wi WHERE score >= best - 1e-9)"""


@query("l06_l08_resolved_clauses", f"{CLAUSES_SQL} SELECT model_id AS utterance_id, CAST(clause - 1 AS INTEGER) AS clause, object_id, round(score, 9) AS score FROM on_ WHERE attempt = first")
def l06(spark: SparkSession, d: str) -> DataFrame:
    wanted = utterances.heard(spoken(spark, d)).where("said not in ('view', 'clear')")
    return utterances.resolve_clauses(wanted, named_objects(spark, d)).select("utterance_id", "clause", "object_id", F.round("score", 9).alias("score"))


@query(
    "l09_resolved_utterances",
    f"""{CLAUSES_SQL}, tg AS (SELECT model_id, object_id, min((clause, CASE WHEN kind IS NULL THEN label ELSE '' END, obj_seq)) AS place FROM on_ WHERE attempt = first GROUP BY ALL)
SELECT vw.model_id AS utterance_id, CASE WHEN action IS NOT NULL THEN 'view' WHEN clears THEN 'clear' WHEN t.targets IS NULL THEN 'unknown' ELSE 'highlight' END AS intent, action, coalesce(t.targets, '') AS targets
FROM vw LEFT JOIN (SELECT model_id, string_agg(object_id, ',' ORDER BY place) AS targets FROM tg GROUP BY model_id) t USING (model_id)""",
)
def l09(spark: SparkSession, d: str) -> DataFrame:
    return utterances.resolve_utterances(spoken(spark, d), named_objects(spark, d)).withColumn("targets", F.array_join("targets", ","))


@query(
    "l12_display_labels",
    f"""{SPOKEN_SQL}, w AS (SELECT object_id, [CASE p WHEN 'vertebrae' THEN 'vertebra' WHEN 'clavicula' THEN 'clavicle' ELSE p END FOR p IN string_split(label, '_') IF p NOT IN ('left', 'right')] AS ws, [p FOR p IN string_split(label, '_') IF p IN ('left', 'right')][1] AS side FROM nm),
s AS (SELECT object_id, CASE WHEN side IS NULL THEN '' ELSE side || ' ' END || array_to_string(ws, ' ') AS t FROM w) SELECT object_id, upper(substr(t, 1, 1)) || substr(t, 2) AS shown FROM s""",
)
def l12(spark: SparkSession, d: str) -> DataFrame:
    return named_objects(spark, d).select("object_id", utterances.display_label(F.col("label")).alias("shown"))


@query(
    "l02_find_objects",
    "WITH q AS (SELECT p_partkey AS query_id, lower(p_name) AS query FROM part), w AS (SELECT DISTINCT query_id, unnest([x FOR x IN regexp_split_to_array(query, '\\s+') IF x <> '']) AS word FROM q), l AS (SELECT lower(concat(p_name, ' ', p_type, ' ', p_brand)) AS label, min(p_partkey) AS object_id FROM part GROUP BY 1), s AS (SELECT query_id, object_id, count(*) AS score FROM w JOIN l ON contains(label, word) GROUP BY ALL) SELECT query_id, object_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM s) WHERE rank <= 5",
)
def l02(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    labels = parts.select(F.col("p_partkey").alias("object_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"))
    return context.find_objects(labels, parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")))
