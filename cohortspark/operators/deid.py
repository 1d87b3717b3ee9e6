"""De-identification and digests (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of identifiers, over characters as Unicode defines them. A date has its parts joined by a hyphen, slash, dot or nothing, and a month and day that can be. Fixed values.
UID = r"(?U)\b[0-2](?:\.\d+){4,}\b"
DATE = r"(?U)\b(?:19|20)\d{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])\b"


def identifier_tokens(patient_id: Column, name: Column) -> Column:
    """The id and the parts of the name, from three characters on."""
    parts = F.concat(F.array(F.trim(F.coalesce(patient_id, F.lit("")))), F.split(F.coalesce(name, F.lit("")), r"[\^\s,]+"))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def quoted(token: Column) -> Column:
    """A pattern that matches just ``token``."""
    return F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def scrub(text: Column, identifiers: Column, limit: int | None = None) -> Column:
    """Control characters to spaces, none of which stay at the ends; identifiers (any case, not inside words), UIDs and dates to marks."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), r"(?U)^\s+|\s+$", "")
    own = F.array_join(F.transform(identifiers, quoted), "|")
    pattern = F.when(F.size(identifiers) > 0, F.concat(F.lit(r"(?iuU)(?<!\w)(?:"), own, F.lit(r")(?!\w)"))).otherwise(F.lit(r"$^"))
    out = F.regexp_replace(clean, pattern, F.lit("[redacted]"))
    out = F.regexp_replace(F.regexp_replace(out, UID, "[uid]"), DATE, "[date]")
    return F.substring(out, 1, limit) if limit else out


def violations(rows: DataFrame, text: str, patient_id: str) -> DataFrame:
    """Rows in which a UID or the patient's id (three characters or more, in any case) is left."""
    return rows.where(F.col(text).rlike(UID) | ((F.length(patient_id) >= 3) & F.contains(F.lower(text), F.lower(patient_id))))


def is_synthetic(description: Column, patient_id: Column) -> Column:
    return F.coalesce(F.lower(description).rlike("synthetic|phantom"), F.lit(False)) | F.coalesce(F.upper(patient_id).startswith("DEMO-"), F.lit(False))


def object_key(model_id: Column, object_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", model_id, object_id), 256), 1, 24)


def with_refs(objects: DataFrame, every: bool = False) -> DataFrame:
    """Objects that may be shown (no volumes, no rejected ones), with their ``ref``: ``O<n>`` by place in the model; if ``every``, the others too, without one."""
    ref = F.when((F.col("obj_type") != "volume") & (F.col("review_status") != "rejected"), F.concat(F.lit("O"), F.col("obj_seq").cast("string")))
    named = objects.withColumn("ref", ref)
    return named if every else named.where("obj_type <> 'volume' and review_status <> 'rejected'")


def alias_refs(objects: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``model_id, object_id, ref``: ``O<n>`` by place in the model; volumes and rejected objects have none. With ``links`` (``model_id, prior_id, object_id, link_type``) also ``P<n>``, by place in the prior, of prior objects that are resolved, but for volumes."""
    own = with_refs(objects).select("model_id", "object_id", "ref")
    if links is None:
        return own
    gone = links.where("link_type = 'resolved'").select("model_id", "prior_id", "object_id").distinct()
    before = objects.where("obj_type <> 'volume'").select(F.col("model_id").alias("prior_id"), "object_id", F.concat(F.lit("P"), F.col("obj_seq").cast("string")).alias("ref"))
    prior = gone.join(before, ["prior_id", "object_id"]).join(own.select("model_id", "object_id"), ["model_id", "object_id"], "left_anti")
    return own.unionByName(prior.select("model_id", "object_id", "ref"))


def object_rows(objects: DataFrame, *more: str) -> DataFrame:
    """What may be shown of each object, and the columns ``more``."""
    extent = F.greatest(*(F.col(f"{x}1") - F.col(f"{x}0") for x in "xyz"))
    return with_refs(objects).select("model_id", "ref", "label", "obj_type", "volume_mm3", extent.alias("extent"), "cx", "cy", "cz", "review_status", *more)


#: Regions kept at first and in need, context items and their characters in need, bytes of a digest. Fixed values.
REGIONS_KEPT, REGIONS_LEAST, CONTEXT_LEAST, CONTEXT_SHORT, DIGEST_BYTES = 8, 3, 5, 200, 12_000
FOCUS = ("finding", "lesion", "device")


def assert_deidentified(rows: DataFrame, text: str, patient_id: str) -> DataFrame:
    """The rows as they are; running them fails where a UID or a patient's id (three characters or more, in any case) is left."""
    own = F.length(patient_id) >= 3
    left = F.col(text).rlike(UID) | (own & F.contains(F.lower(text), F.lower(patient_id)))
    return rows.where(F.assert_true(~F.coalesce(left, F.lit(False)), F.lit("an identifier is left in the text")).isNull())


def model_digest(rows: DataFrame, relations: DataFrame, changes: DataFrame, context: DataFrame, max_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``model_id, level, digest``: a JSON of what may be shown of each model, at most ``max_bytes`` long where shortening can reach that.

    ``rows`` are ``model_id, obj_seq, ref, label, obj_type, volume_mm3, extent, review_status``;
    ``relations`` ``model_id, a, relation, b, gap`` (refs); ``changes`` ``model_id, ref, change,
    volume_prior, volume_now``; ``context`` ``model_id, item_id, title, about, text``. Of regions only the
    largest REGIONS_KEPT are shown. What is too long loses, one after the other: relations of
    other objects than findings (level 1), regions beyond REGIONS_LEAST (2), the measures of anatomy (3),
    context beyond CONTEXT_LEAST items and CONTEXT_SHORT characters (4), and anatomy from the last on,
    with all relations (5). A model's children meet as arrays, a row for each model.
    """
    listed = lambda df, name, *c: df.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    every = listed(rows, "objects", "obj_seq", "ref", "label", "obj_type", "volume_mm3", "extent", "review_status")
    for part, name, columns in ((relations, "relations", ("a", "relation", "b", "gap")), (changes, "changes", ("ref", "change", "volume_prior", "volume_now")), (context, "context", ("item_id", "title", "about", "text"))):
        every = every.join(listed(part, name, *columns), "model_id", "left")
    every = every.withColumns({n: F.coalesce(n, F.array().cast(every.schema[n].dataType)) for n in ("relations", "changes", "context")})

    def without(gone: Column, objects: str, links: str) -> tuple[Column, Column]:
        return F.filter(objects, lambda o: ~F.array_contains(gone, o["ref"])), F.filter(links, lambda r: ~F.array_contains(gone, r["a"]) & ~F.array_contains(gone, r["b"]))

    def regions_from(objects: str, n: int, by_size: bool) -> Column:
        regions = F.filter(objects, lambda o: o["obj_type"] == "region")
        order = F.sort_array(F.transform(regions, lambda o: F.struct((-F.coalesce(o["volume_mm3"], F.lit(0.0))).alias("v"), o["obj_seq"].alias("s"), o["ref"].alias("ref")))) if by_size else regions
        return F.slice(F.transform(order, lambda o: o["ref"]), n + 1, 1 << 30)

    def json(objects: str | Column, links: str, texts: str, gone: Column) -> Column:
        shown = F.col(objects) if isinstance(objects, str) else objects
        return F.to_json(F.struct(shown.alias("objects"), F.col(links).alias("relations"), "changes", F.col(texts).alias("context"), gone.alias("omitted")))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    d = every.withColumn("gone0", regions_from("objects", REGIONS_KEPT, True))
    o, r = without(F.col("gone0"), "objects", "relations")
    d = d.withColumns({"o0": o, "r0": r})
    focus = F.transform(F.filter("o0", lambda x: x["obj_type"].isin(*FOCUS)), lambda x: x["ref"])
    d = d.withColumn("focus", focus).withColumn("r1", F.filter("r0", lambda x: F.array_contains("focus", x["a"]) | F.array_contains("focus", x["b"])))
    d = d.withColumn("gone2", regions_from("o0", REGIONS_LEAST, False))
    o, r = without(F.col("gone2"), "o0", "r1")
    d = d.withColumns({"o2": o, "r2": r})
    bare = lambda x: F.struct(x["obj_seq"].alias("obj_seq"), x["ref"].alias("ref"), x["label"].alias("label"), *(F.when(x["obj_type"] != "anatomy", x[c]).alias(c) for c in ("obj_type", "volume_mm3", "extent", "review_status")))
    d = d.withColumn("o3", F.transform("o2", bare))
    cut = F.transform(F.slice("context", 1, CONTEXT_LEAST), lambda c: F.struct(c["item_id"].alias("item_id"), c["title"].alias("title"), c["about"].alias("about"), F.substring(c["text"], F.lit(1), F.lit(CONTEXT_SHORT)).alias("text")))
    d = d.withColumns({"c4": cut, "r5": F.filter("r2", lambda x: F.lit(False)), "shown": F.filter("o3", lambda x: x["obj_type"].isNotNull()), "rest": F.filter("o3", lambda x: x["obj_type"].isNull())})
    gone0, gone2 = F.size("gone0"), F.size("gone0") + F.size("gone2")
    base = F.octet_length(json("shown", "r5", "c4", gone2))
    # of the rest as many as fit: each is its JSON and a comma
    fits = F.aggregate("rest", F.struct(base.alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, x: F.when(a["open"] & (a["used"] + F.octet_length(F.to_json(x)) + 1 <= max_bytes), F.struct((a["used"] + F.octet_length(F.to_json(x)) + 1).alias("used"), (a["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(False).alias("open"))))

    def fitting(level: int, text: Column) -> Column:
        return let(text, lambda j: F.when(F.octet_length(j) <= max_bytes, F.struct(F.lit(level).alias("level"), j.alias("digest"))))

    # one after the other: a later form is made only where those before it are too long
    forms = [json("o0", "r0", "context", gone0), json("o0", "r1", "context", gone0), json("o2", "r2", "context", gone2), json("o3", "r2", "context", gone2), json("o3", "r2", "c4", gone2)]
    last = let(fits["n"], lambda n: F.struct(F.lit(5).alias("level"), json(F.concat("shown", F.slice("rest", F.lit(1), n)), "r5", "c4", gone2 + F.size("rest") - n).alias("digest")))
    chosen = d.select("model_id", F.coalesce(*(fitting(i, form) for i, form in enumerate(forms)), last).alias("chosen"))
    return chosen.select("model_id", "chosen.level", "chosen.digest")
