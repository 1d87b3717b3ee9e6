"""Context items and their binding to objects; label search (C, L1, L2, L11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.deid import scrub

#: Scores of a binding: by code, by label, at most and for each word found. Fixed values.
BY_CODE, BY_LABEL, MOST_BY_WORDS, ANY_WORD, EACH_WORD, BY_HAND = 0.98, 0.92, 0.82, 0.46, 0.12, 0.5
#: Resource fields with codes. Fixed values.
CODE_FIELDS = ("code", "coding", "category", "valueCodeableConcept", "reasonCode", "bodySite")
EVIDENCE_CHARS, CONTEXT_CHARS = 280, 600


def given(value: Column) -> Column:
    """An empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def flatten_text(body: Column) -> Column:
    """All scalars of a JSON text in order, with single spaces; a text that is no JSON is itself.

    One pattern reads names, strings, numbers and words from left to right, so quotes,
    commas and braces inside strings do not count.
    """
    pattern = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?[0-9][-+.0-9eE]*|true|false'
    found = F.filter(F.regexp_extract_all(body, F.lit(pattern), 0), lambda t: ~t.rlike(r':$'))
    scalars = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    nested = body.rlike(r"^\s*[\[{]") & F.try_parse_json(body).isNotNull()
    return F.when(nested, F.array_join(scalars, " ")).otherwise(F.coalesce(body, F.lit("")))


def code_text(body: Column) -> Column:
    """Text and codings (system, code, display) of a resource's CODE_FIELDS, in order."""

    def of(field: str) -> Column:
        value = F.get_json_object(body, f"$.{field}")
        codings = F.from_json(F.get_json_object(body, f"$.{field}.coding"), "array<struct<system:string,code:string,display:string>>")
        named = F.flatten(F.transform(codings, lambda c: F.array(c["system"], c["code"], c["display"])))
        concept = F.concat_ws(" ", given(flatten_text(F.get_json_object(body, f"$.{field}.text"))), given(F.array_join(F.filter(named, lambda x: x != ""), " ")))
        return given(F.when(value.startswith("["), flatten_text(value)).when(value.startswith("{"), concept))

    return F.concat_ws(" ", *map(of, CODE_FIELDS))


def normalize_context(resources: DataFrame, now: str) -> DataFrame:
    """FHIR-like resources (``seq, body`` JSON, and other columns that stay) as items ``item_id, type, title, date, text, codes, subject, raw``; ``now`` stands in for a missing date."""
    v = lambda path: given(F.get_json_object("body", path))
    kind = F.coalesce(v("$.resourceType"), v("$.type"), F.lit("context"))
    text = F.coalesce(v("$.text"), v("$.description"), v("$.valueString"), v("$.value"), v("$.content"), F.lit(""))
    others = [c for c in resources.columns if c not in ("seq", "body")]
    return resources.select(
        *others,
        F.coalesce(v("$.id"), F.concat(F.lit("source-"), F.col("seq").cast("string"))).alias("item_id"),
        F.lower(kind).alias("type"),
        F.coalesce(v("$.title"), v("$.code.text"), kind).alias("title"),
        F.coalesce(v("$.effectiveDateTime"), v("$.issued"), v("$.date"), F.lit(now)).alias("date"),
        flatten_text(text).alias("text"),
        code_text(F.col("body")).alias("codes"),
        flatten_text(F.coalesce(v("$.subject"), F.lit(""))).alias("subject"),
        F.col("body").alias("raw"),
    )


def haystack() -> Column:
    """What bindings look in: title, text, codes and subject in lower case."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "text", "codes", "subject"))))


def catalogues(objects: DataFrame) -> DataFrame:
    """``model_id, catalogue``: the objects of a model in order, with what is looked for: label, other terms, code, and the label's words of three letters or more."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    terms = F.filter(F.concat(F.array(lower(F.col("label"))), F.transform(F.coalesce("terms", F.array().cast("array<string>")), lower)), lambda t: F.length(t) > 2)
    words = F.filter(F.split(lower(F.col("label")), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    entry = F.struct("obj_seq", "object_id", terms.alias("terms"), given(lower(F.col("code"))).alias("code"), words.alias("words"))
    return objects.groupBy("model_id").agg(F.sort_array(F.collect_list(entry)).alias("catalogue"))


def binding_score(text: Column, o: Column) -> Column:
    """0.98 for the object's code, 0.92 for its label or another term as whole words, else by the label's words found; 0 for none. A pattern is tried only where the plain term stands in the text."""
    edge = r"[\p{L}\p{N}_]"
    whole = lambda t: F.rlike(text, F.concat(F.lit(rf"(?<!{edge})\Q"), t, F.lit(rf"\E(?!{edge})")))
    hits = F.size(F.filter(o["words"], lambda w: F.contains(text, w)))
    by_words = F.when(hits > 0, F.least(F.lit(MOST_BY_WORDS), ANY_WORD + EACH_WORD * hits)).otherwise(0.0)
    by_label = F.exists(o["terms"], lambda t: F.when(F.contains(text, t), whole(t)).otherwise(False))
    return F.when(o["code"].isNotNull() & F.contains(text, o["code"]), BY_CODE).when(by_label, BY_LABEL).otherwise(by_words)


def score_bindings(items: DataFrame, objects: DataFrame) -> DataFrame:
    """``model_id, item_id, object_id, obj_seq, score`` above 0 of items and the objects (``label, terms, code``) of their model.

    A model's objects are one row, so each text is read once, where it is, and no
    pairs of items and objects are shuffled.
    """
    met = items.select("model_id", "item_id", haystack().alias("text")).join(catalogues(objects), "model_id")
    scored = F.filter(F.transform("catalogue", lambda o: F.struct(F.round(binding_score(F.col("text"), o), 3).alias("score"), o["obj_seq"].alias("obj_seq"), o["object_id"].alias("object_id"))), lambda s: s["score"] > 0)
    return met.select("model_id", "item_id", F.explode(scored).alias("s")).select("model_id", "item_id", "s.object_id", "s.obj_seq", "s.score")


def bind_best(scored: DataFrame) -> DataFrame:
    """The best object of each item, the first of its model on ties."""
    best = F.max_by(F.struct("object_id", "score"), F.struct("score", -F.col("obj_seq"))).alias("b")
    return scored.groupBy("model_id", "item_id").agg(best).select("model_id", "item_id", "b.object_id", "b.score")


def bind_fallback(items: DataFrame, bound: DataFrame, models: DataFrame) -> DataFrame:
    """Items without an object: bound by hand to the study, where its id stands in the text or the item is an imaging study, else to the patient."""
    left = items.select("model_id", "item_id", "type", haystack().alias("text")).join(bound, ["model_id", "item_id"], "left_anti").join(models.select("model_id", "study_id", "patient_id"), "model_id")
    study = F.contains("text", F.lower(F.col("study_id").cast("string"))) | F.coalesce(F.col("type") == "imagingstudy", F.lit(False))
    target = F.when(study, F.col("study_id").cast("string")).otherwise(F.col("patient_id").cast("string"))
    return left.select("model_id", "item_id", F.when(study, "study").otherwise("patient").alias("target_type"), target.alias("target_id"), F.lit(BY_HAND).alias("score"), F.lit("manual").alias("method"))


def bind_context(items: DataFrame, objects: DataFrame, models: DataFrame) -> DataFrame:
    """A binding for each item: ``binding_id, model_id, item_id, target_type, target_id, score, method, title, evidence, review_status``."""
    best = bind_best(score_bindings(items, objects))
    method = F.when(F.col("score") >= BY_CODE, "structured").otherwise("text-extraction")
    direct = best.select("model_id", "item_id", F.lit("object").alias("target_type"), F.col("object_id").alias("target_id"), "score", method.alias("method"))
    every = direct.unionByName(bind_fallback(items, best, models))
    name = F.concat_ws(":", F.lit("binding"), "item_id", F.when(F.col("target_type") == "object", F.col("target_id")).otherwise(F.col("target_type")))
    texts = items.select("model_id", "item_id", "title", F.substring("text", 1, EVIDENCE_CHARS).alias("evidence"))
    return every.join(texts, ["model_id", "item_id"]).withColumns({"binding_id": name, "review_status": F.lit("unreviewed")})


def attach_sources(bindings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of the bindings that a model has not yet (``model_id, source_id, title, excerpt``, each once), and by object the bindings attached to it."""
    own = bindings.select("model_id", F.concat(F.lit("source:"), F.col("item_id").cast("string")).alias("source_id"), "title", F.col("evidence").alias("excerpt"))
    new = own.join(sources.select("model_id", "source_id"), ["model_id", "source_id"], "left_anti").groupBy("model_id", "source_id").agg(F.min_by(F.struct("title", "excerpt"), F.struct("title", "excerpt")).alias("s")).select("model_id", "source_id", "s.title", "s.excerpt")
    attached = bindings.where("target_type = 'object'").groupBy("model_id", F.col("target_id").alias("object_id")).agg(F.sort_array(F.collect_set("binding_id")).alias("bindings"))
    return new, attached


def context_query(bindings: DataFrame, sources: DataFrame, objects: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, model_id, binding_id, source_id, score`` for queries ``query_id, model_id, query, object_id``.

    A binding is found whose title, evidence or object's label holds the query; 1.0
    if it is bound to the object asked for, else its own score. Queries without any
    fall back on the model's sources, at 0.25.
    """
    asked = queries.select("query_id", "model_id", F.lower(F.trim(F.coalesce("query", F.lit("")))).alias("query"), F.col("object_id").alias("wanted"))
    labelled = bindings.join(objects.select("model_id", F.col("object_id").alias("target_id"), "label"), ["model_id", "target_id"], "left")
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "evidence", "label"))))
    source = F.concat(F.lit("source:"), F.col("item_id").cast("string")).alias("source_id")
    met = labelled.select("model_id", "binding_id", source, "target_id", "score", text.alias("text")).join(asked, "model_id").where(F.contains("text", "query"))
    hits = met.select("query_id", "model_id", "binding_id", "source_id", F.round(F.when(F.col("wanted") == F.col("target_id"), 1.0).otherwise(F.col("score")), 3).alias("score"))
    none = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    shown = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    others = none.join(sources.select("model_id", "source_id", shown.alias("text")), "model_id").where(F.contains("text", "query"))
    return hits.unionByName(others.select("query_id", "model_id", F.lit(None).cast("string").alias("binding_id"), "source_id", F.lit(0.25).alias("score")))


def source_detail(sources: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every source with its bindings in order."""
    own = bindings.groupBy("model_id", F.concat(F.lit("source:"), F.col("item_id").cast("string")).alias("source_id")).agg(F.sort_array(F.collect_list("binding_id")).alias("bindings"))
    return sources.join(own, ["model_id", "source_id"], "left").withColumn("bindings", F.coalesce("bindings", F.array().cast("array<string>")))


def day(value: Column) -> Column:
    """A date from ``YYYYMMDD`` or ``YYYY-MM-DD``; null for anything else."""
    text = F.substring(F.trim(value.cast("string")), 1, 10)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def context_digest(items: DataFrame, bindings: DataFrame, refs: DataFrame, facts: DataFrame) -> DataFrame:
    """What may be shown of each item: scrubbed title, type and text (at most CONTEXT_CHARS), days before the study, and the ref of the object it is bound to; ``facts`` has ``model_id, study_date, identifiers``."""
    about = bindings.where("target_type = 'object'").join(refs.select("model_id", F.col("object_id").alias("target_id"), "ref"), ["model_id", "target_id"]).select("model_id", "item_id", F.col("ref").alias("about"))
    known = items.join(facts, "model_id").join(about, ["model_id", "item_id"], "left")
    clean = lambda c, n: scrub(F.coalesce(F.col(c), F.lit("")), F.col("identifiers"), n)
    return known.select("model_id", "item_id", clean("title", 120).alias("title"), clean("type", 40).alias("type"), F.datediff(day(F.col("study_date")), day(F.col("date"))).alias("days_before_study"), "about", clean("text", CONTEXT_CHARS).alias("text"))


def apply_binding_reviews(bindings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Bindings with the status of their review (``model_id, binding_id, status``), where it is a known one; ``unreviewed`` takes a review back."""
    valid = reviews.where(F.col("status").isin("confirmed", "modified", "rejected", "unreviewed")).select("model_id", "binding_id", "status")
    return bindings.join(valid, ["model_id", "binding_id"], "left").withColumn("review_status", F.coalesce("status", "review_status")).drop("status")


def dedupe_items(items: DataFrame) -> DataFrame:
    """An identical item once: the one with the smallest id."""
    return items.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))


def search_context(items: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Items that hold a word of the query (three letters or more, else the query itself), first by id: a top-k report."""
    words = [w for w in query.lower().split() if len(w) > 2] or [query.lower()]
    found = F.lit(False)
    for w in words:
        found = found | F.col("haystack").contains(w)
    return items.where(found).orderBy("item_id").limit(limit).select("item_id")


def find_object(catalogue: DataFrame, query: str) -> DataFrame:
    """1.0 for an equal label, 0.7 for a label or an id that contains the query; an empty query finds all."""
    q = query.lower().strip()
    label, id_ = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.col("object_id").cast("string"))
    return catalogue.where(label.contains(q) | id_.contains(q)).select("object_id", F.when(label == q, 1.0).otherwise(0.7).alias("score"))


def find_objects(catalogue: DataFrame, queries: DataFrame, limit: int = 5, gram: int = 3) -> DataFrame:
    """``query_id, object_id, score, rank``: for each query the labels with most of its words, ties by id: a top-k report.

    A word stands anywhere in a label. Only different words, and different labels, are
    matched, by the word's first ``gram`` characters and those at every place of the label, an
    equi-join (shorter words by all of theirs). Queries with the same set of words are one
    class, and so are labels that hold the same of these words, of which the first
    ``limit`` ids are kept; classes meet by word and are ranked among one another, so no query
    ever meets a label.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")))
    asked = queries.select("query_id", words.alias("words"))
    sets = asked.select("words").distinct()
    known = sets.select(F.explode("words").alias("word")).distinct().withColumn("gram", F.substring("word", 1, gram))
    labels = catalogue.groupBy(F.lower("label").alias("label")).agg(F.min("object_id").alias("object_id"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("label"), F.lit(1))), lambda i: F.substring(F.col("label"), i, F.lit(n)))
    places = labels.select("label", "object_id", F.explode(F.array_distinct(F.flatten(F.array(*(at(n) for n in range(1, gram + 1)))))).alias("gram"))
    held = places.join(known, "gram").where(F.contains("label", "word")).groupBy("object_id").agg(F.sort_array(F.collect_set("word")).alias("held"))
    first = Window.partitionBy("held").orderBy("object_id")
    classes = held.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).groupBy("held").agg(F.sort_array(F.collect_list("object_id")).alias("ids"))

    shared = sets.withColumn("word", F.explode("words")).join(classes.withColumn("word", F.explode("held")), "word")
    scored = shared.groupBy("words", "held").agg(F.count(F.lit(1)).alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("words").orderBy(F.desc("score"), "object_id")
    best = scored.select("words", "score", F.explode("ids").alias("object_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(best, "words").select("query_id", "object_id", "score", "rank")


#: Words of every vocabulary, in this order. Fixed values.
COMMAND_WORDS = ("highlight", "clear", "show", "mark", "zoom", "in", "out", "reset", "spin", "stop", "abnormalities", "findings", "everything", "and", "left", "right", "upper", "middle", "lower", "lobe")


def label_vocabulary(catalogue: DataFrame, k: int = 64) -> DataFrame:
    """``place, word``: COMMAND_WORDS, then words of labels in order of their first place, without numbers, ``k`` in all: a top-k report."""
    words = catalogue.select("seq", F.posexplode(F.split(F.lower("label"), "[^a-z0-9]+")).alias("pos", "word")).where("word <> '' and not word rlike '^[0-9]+$'").where(~F.col("word").isin(*COMMAND_WORDS))
    own = words.groupBy("word").agg(F.min(F.struct("seq", "pos")).alias("at")).orderBy("at", "word").limit(max(0, k - len(COMMAND_WORDS)))
    fixed = catalogue.sparkSession.createDataFrame(list(enumerate(COMMAND_WORDS[:k], 1)), "place int, word string")
    return fixed.unionByName(own.select((F.row_number().over(Window.orderBy("at", "word")) + len(COMMAND_WORDS)).alias("place"), "word"))  # of k rows at most
