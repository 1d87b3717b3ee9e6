"""Longitudinal operators (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPT = 0.35


def normalize_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def models(objects: DataFrame) -> DataFrame:
    return objects.select("patient_id", "model_id", "study_date").distinct()


def select_prior(models_: DataFrame) -> DataFrame:
    """The model before each, by study date then id."""
    order = Window.partitionBy("patient_id").orderBy("study_date", "model_id")
    return models_.select("patient_id", "model_id", "study_date", F.lag("model_id").over(order).alias("prior_id"), F.lead("model_id").over(order).alias("next_id"), F.row_number().over(order).alias("place"), F.datediff("study_date", F.lag("study_date").over(order)).alias("interval_days"))


def build_timeline(models_: DataFrame) -> DataFrame:
    """A patient's models in order, as one row."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("study_date", "model_id"))), lambda m: m["model_id"])
    return models_.groupBy("patient_id").agg(F.array_join(ids, ",").alias("models"), F.count(F.lit(1)).alias("n_models"), F.datediff(F.max("study_date"), F.min("study_date")).alias("span_days"))


def match_score(same_label: Column, distance: Column) -> Column:
    """0.8 for equal labels, and up to 0.2 for closeness within a metre."""
    return F.when(same_label, 0.8).otherwise(0.0) + 0.2 * F.greatest(F.lit(0.0), 1 - distance / 1000)


def prior_objects(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """Objects of the prior of each model, with that ``model_id`` and their own as ``prior_id``, in the space of the model where it has a registration."""
    pairs = priors.where("prior_id is not null").select("model_id", "prior_id")
    before = objects.withColumnRenamed("model_id", "prior_id").join(pairs, "prior_id")
    return registered(before, registrations) if registrations is not None else before


def matched_groups(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None, measures: list[str], tasks: int | None = None) -> DataFrame:
    """``model_id, prior_id, norm_label`` with the ``current`` and ``before`` objects (``seq, id, cx, cy, cz`` and ``measures``) of a label, and the greedy ``links`` between them (``now, then, score``).

    Without equal labels a score stays below the threshold, so objects meet by label,
    in one grouping of both sides. Current objects choose in order of their model, each
    prior one once, best score and then first in order. Most labels have one
    candidate, or the choices of a label are folded in one expression over its few objects.
    Where ``objects`` are dealt by model to so many ``tasks``, only the prior ones are dealt again.
    """
    key = ["model_id", "prior_id", "norm_label"]
    named = objects.withColumn("norm_label", normalize_label(F.col("label")))
    pairs = priors.where("prior_id is not null").select("model_id", "prior_id")
    told = F.struct(F.col("obj_seq").alias("seq"), F.col("object_id").alias("id"), "cx", "cy", "cz", *(m for m in measures if m not in ("cx", "cy", "cz")))
    now = named.join(pairs, "model_id").select(*key, told.alias("now"))
    kind = now.schema["now"].dataType
    then = prior_objects(named, priors, registrations).select(*key, F.lit(None).cast(kind).alias("now"), told.cast(kind).alias("then"))
    if tasks:
        then = then.repartition(tasks, "model_id")
    both = now.withColumn("then", F.lit(None).cast(kind)).unionByName(then)
    groups = both.groupBy(*key).agg(F.sort_array(F.collect_list("now")).alias("current"), F.sort_array(F.collect_list("then")).alias("before"))
    link = f"array<struct<now:{kind.simpleString()},then:{kind.simpleString()},score:double>>"

    def score(a: Column, b: Column) -> Column:
        d = F.sqrt(sum(((a[f"c{x}"] - b[f"c{x}"]) * (a[f"c{x}"] - b[f"c{x}"]) for x in "xyz"), F.lit(0.0)))
        return match_score(F.lit(True), d)

    def choose(done: Column, a: Column) -> Column:
        free = F.filter("before", lambda b: ~F.exists(done, lambda x: x["then"]["id"] == b["id"]))
        best = F.array_max(F.transform(free, lambda b: F.struct(score(a, b).alias("score"), (-b["seq"]).alias("late"), b.alias("then"))))
        taken = F.array(F.struct(a.alias("now"), best["then"].alias("then"), best["score"].alias("score"))).cast(link)
        return F.when(best.isNull() | (best["score"] < ACCEPT), done).otherwise(F.concat(done, taken))

    none = F.array().cast(link)
    met = F.col("norm_label").isNotNull() & (F.size("current") > 0) & (F.size("before") > 0)
    return groups.withColumn("links", F.when(met, F.aggregate("current", none, choose)).otherwise(none))


def match_objects(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """Greedy links of current to prior objects: ``model_id, prior_id, object_id, prior_object_id, score``; see ``matched_groups``."""
    links = matched_groups(objects, priors, registrations, []).select("model_id", "prior_id", F.explode("links").alias("l"))
    return links.select("model_id", "prior_id", F.col("l.now.id").alias("object_id"), F.col("l.then.id").alias("prior_object_id"), "l.score")


def change_columns(a: str = "", b: str = "p_") -> dict[str, Column]:
    """Changes from prior ``b`` to current ``a``; percentages only of what was not 0."""
    percent = lambda now, then: F.when(then != 0, (now - then) / then * 100)
    distance = F.sqrt(sum(((F.col(f"{a}c{x}") - F.col(f"{b}c{x}")) * (F.col(f"{a}c{x}") - F.col(f"{b}c{x}")) for x in "xyz"), F.lit(0.0)))
    size = lambda p: F.greatest(*(F.col(f"{p}{x}1") - F.col(f"{p}{x}0") for x in "xyz"))
    return {
        "centroid_distance": distance,
        "volume_delta": F.col(f"{a}volume_mm3") - F.col(f"{b}volume_mm3"),
        "volume_percent": percent(F.col(f"{a}volume_mm3"), F.col(f"{b}volume_mm3")),
        "diameter_delta": size(a) - size(b),
        "diameter_percent": percent(size(a), size(b)),
        "surface_delta": F.col(f"{a}surface_area_mm2") - F.col(f"{b}surface_area_mm2"),
        "surface_percent": percent(F.col(f"{a}surface_area_mm2"), F.col(f"{b}surface_area_mm2")),
    }


def link_rows(groups: DataFrame) -> DataFrame:
    """Of ``matched_groups`` the links, the new objects and the lost ones: ``model_id, prior_id, l`` (``now``, ``then`` and ``score``)."""
    row = lambda now, then, score: F.struct(now.alias("now"), then.alias("then"), score.alias("score"))
    none = F.lit(None).cast(groups.schema["current"].dataType.elementType)
    new = F.transform(F.filter("current", lambda a: ~F.exists("links", lambda x: x["now"]["id"] == a["id"])), lambda a: row(a, none, F.lit(1.0)))
    lost = F.transform(F.filter("before", lambda b: ~F.exists("links", lambda x: x["then"]["id"] == b["id"])), lambda b: row(none, b, F.lit(1.0)))
    return groups.select("model_id", "prior_id", F.explode(F.concat("links", new, lost)).alias("l"))


def link_kind() -> Column:
    """Type of a link, from its ``single`` side or its changes."""
    return F.coalesce("single", F.when((F.abs("volume_percent") >= 20) | (F.col("centroid_distance") >= 50), "changed_from").otherwise("same_as_prior"))


def compared(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None, measures: list[str], tasks: int | None = None) -> DataFrame:
    """``model_id, prior_id, object_id, prior_object_id, single, confidence`` of every current and every lost prior object, with its ``measures`` and as ``p_`` those of the prior one. ``tasks`` as in ``matched_groups``."""
    rows = link_rows(matched_groups(objects, priors, registrations, measures, tasks))
    now, then = F.col("l.now.id"), F.col("l.then.id")
    return rows.select(
        "model_id", "prior_id", F.coalesce(now, then).alias("object_id"), F.coalesce(then, now).alias("prior_object_id"), F.when(then.isNull(), "new").when(now.isNull(), "resolved").alias("single"), F.col("l.score").alias("confidence"),
        *(F.col(f"l.now.{c}").alias(c) for c in measures), *(F.col(f"l.then.{c}").alias(f"p_{c}") for c in measures),
    )


def compare_models(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """Links of every current and every lost prior object, with changes and type: same_as_prior, changed_from, new, resolved. Models with a row of ``registrations`` (see ``rigid_transform``) are compared with their prior in their own space."""
    measures = ["cx", "cy", "cz", *(f"{x}{i}" for x in "xyz" for i in (0, 1)), "volume_mm3", "surface_area_mm2"]
    told = compared(objects, priors, registrations, measures).withColumns(change_columns())
    return told.select("model_id", "prior_id", "object_id", "prior_object_id", link_kind().alias("link_type"), "confidence", *change_columns())


def link_types(objects: DataFrame, priors: DataFrame, registrations: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The links of ``compare_models`` with their type and no changes: only what the type rests on is dealt out. ``tasks`` as in ``matched_groups``."""
    told = compared(objects, priors, registrations, ["cx", "cy", "cz", "volume_mm3"], tasks)
    told = told.withColumns({c: change_columns()[c] for c in ("centroid_distance", "volume_percent")})
    return told.select("model_id", "prior_id", "object_id", "prior_object_id", link_kind().alias("link_type"))


def current_changes(objects: DataFrame, priors: DataFrame, keep: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """``model_id, link_type, volume_prior, volume_now`` and the columns of ``keep`` of each current object that changed or is new: what ``change_report`` says of them, with no join back to the objects. ``tasks`` as in ``matched_groups``."""
    rows = link_rows(matched_groups(objects, priors, None, ["volume_mm3", *keep], tasks)).where("l.now is not null")
    measures = ("cx", "cy", "cz", "volume_mm3")
    told = rows.select("model_id", F.when(F.col("l.then").isNull(), "new").alias("single"), *(F.col(f"l.now.{c}").alias(c) for c in (*measures, *keep)), *(F.col(f"l.then.{c}").alias(f"p_{c}") for c in measures))
    told = told.withColumns({c: change_columns()[c] for c in ("centroid_distance", "volume_percent")}).withColumn("link_type", link_kind()).where("link_type <> 'same_as_prior'")
    return told.select("model_id", "link_type", F.when(F.col("link_type") != "new", F.col("p_volume_mm3")).alias("volume_prior"), F.col("volume_mm3").alias("volume_now"), *keep)


def change_counts(links: DataFrame) -> DataFrame:
    kinds = ["same_as_prior", "changed_from", "new", "resolved"]
    return links.groupBy("model_id").agg(*(F.count_if(F.col("link_type") == k).alias(k) for k in kinds))


def interpolate(linked: DataFrame, t: float) -> DataFrame:
    """Between prior (0) and current (1), for matched pairs with ``p_`` columns."""
    names = ["cx", "cy", "cz", "volume_mm3"]
    return linked.select("model_id", "object_id", *((F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * t).alias(c) for c in names))


def history(links: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Links with a wanted object (``model_id, object_id``) at either end, or all."""
    if wanted is None:
        return links
    ends = wanted.select("model_id", F.col("object_id").alias("wanted_id")).distinct()
    at = links.withColumn("wanted_id", F.explode(F.array_distinct(F.array("object_id", "prior_object_id"))))
    return at.join(ends, ["model_id", "wanted_id"], "left_semi").select(*links.columns).distinct()


def change_report(links: DataFrame, objects: DataFrame, registered_: bool = False) -> tuple[DataFrame, DataFrame]:
    """What changed, is new or is resolved, with the volume before and now (``centroid_shift`` only of registered models); and by model the number of unchanged objects."""
    volume = lambda model, of, name: objects.select(F.col("model_id").alias(model), F.col("object_id").alias(of), F.col("volume_mm3").alias(name))
    changed = links.where("link_type <> 'same_as_prior'")
    told = changed.join(volume("prior_id", "prior_object_id", "volume_prior"), ["prior_id", "prior_object_id"], "left").join(volume("model_id", "object_id", "volume_now"), ["model_id", "object_id"], "left")
    shift = F.col("centroid_distance") if registered_ else F.lit(None).cast("double")
    rows = told.select("model_id", "object_id", "link_type", "confidence", F.when(F.col("link_type") != "new", F.col("volume_prior")).alias("volume_prior"), F.when(F.col("link_type") != "resolved", F.col("volume_now")).alias("volume_now"), "volume_percent", "diameter_delta", shift.alias("centroid_shift"))
    return rows, links.groupBy("model_id").agg(F.count_if(F.col("link_type") == "same_as_prior").alias("unchanged"))


def prior_version(objects: DataFrame, links: DataFrame, priors: DataFrame) -> DataFrame:
    """``model_id, object_id, prior_id, version_id``: of every object of a model with a prior, the prior object that its first link points at, or without a link the one of the same id; null where the prior has none."""
    first = links.groupBy("model_id", "object_id").agg(F.min("prior_object_id").alias("linked_id"))
    pairs = priors.where("prior_id is not null").select("model_id", "prior_id")
    wanted = objects.select("model_id", "object_id").join(pairs, "model_id").join(first, ["model_id", "object_id"], "left").withColumn("version_id", F.coalesce("linked_id", "object_id"))
    known = objects.select(F.col("model_id").alias("prior_id"), F.col("object_id").alias("version_id"), F.lit(True).alias("known"))
    return wanted.join(known, ["prior_id", "version_id"], "left").select("model_id", "object_id", "prior_id", F.when(F.col("known"), F.col("version_id")).alias("version_id"))


def overlay(objects: DataFrame, priors: DataFrame) -> DataFrame:
    """Objects of a model and of its prior under that model, tagged ``current`` and ``prior``."""
    now = objects.select("model_id", "object_id", F.lit("current").alias("side"))
    return prior_objects(objects, priors).select("model_id", "object_id", F.lit("prior").alias("side")).unionByName(now)


def difference(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects of a model by ``style``: ``changed`` and ``new`` ones, ``resolved`` ones of its prior, and the others as ``baseline``."""
    styles = {"changed_from": "changed", "new": "new", "resolved": "resolved"}
    style = F.coalesce(*(F.when(F.col("link_type") == kind, name) for kind, name in styles.items()))
    # One grouping and no join: what comes dealt by model stays there.
    told = links.where(F.col("link_type").isin(*styles)).select("model_id", "object_id", style.alias("style"), (F.col("link_type") == "resolved").alias("gone"), F.lit(False).alias("own"))
    every = told.unionByName(objects.select("model_id", "object_id", F.lit(None).cast("string").alias("style"), F.lit(False).alias("gone"), F.lit(True).alias("own")))
    met = every.groupBy("model_id", "object_id", "gone").agg(F.collect_list("style").alias("styles"), F.count_if("own").cast("int").alias("n"))
    shown = F.when(F.size("styles") > 0, F.col("styles")).otherwise(F.array(F.lit("baseline")))
    return met.select("model_id", "object_id", F.explode(F.when(F.col("gone"), F.col("styles")).otherwise(F.flatten(F.array_repeat(shown, F.col("n"))))).alias("style"))


def rotation() -> list[list[Column]]:
    """The matrix of Euler angles ``rx ry rz``, in order z, y, x where ``axes`` is ``zyx``, else z, x, y."""
    s, c = {x: F.sin(f"r{x}") for x in "xyz"}, {x: F.cos(f"r{x}") for x in "xyz"}
    one, zero = F.lit(1.0), F.lit(0.0)
    turn = {
        "x": [[one, zero, zero], [zero, c["x"], -s["x"]], [zero, s["x"], c["x"]]],
        "y": [[c["y"], zero, s["y"]], [zero, one, zero], [-s["y"], zero, c["y"]]],
        "z": [[c["z"], -s["z"], zero], [s["z"], c["z"], zero], [zero, zero, one]],
    }
    times = lambda a, b: [[sum((a[i][k] * b[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    zyx, zxy = times(turn["z"], times(turn["y"], turn["x"])), times(turn["z"], times(turn["x"], turn["y"]))
    return [[F.when(F.col("axes") == "zyx", a).otherwise(b) for a, b in zip(p, q, strict=True)] for p, q in zip(zyx, zxy, strict=True)]


def with_rotation(rows: DataFrame, registrations: DataFrame) -> DataFrame:
    """Rows with the nine entries ``m00`` to ``m22`` of their model's rotation, null without a registration."""
    return rows.join(registrations, "model_id", "left").withColumns({f"m{i}{j}": m for i, row in enumerate(rotation()) for j, m in enumerate(row)})


def moved(point: list[Column]) -> list[Column]:
    """A point turned about ``ox oy oz`` and shifted by ``tx ty tz``."""
    off = [p - F.col(f"o{x}") for p, x in zip(point, "xyz", strict=True)]
    return [sum((F.col(f"m{i}{j}") * off[j] for j in range(3)), F.lit(0.0)) + F.col(f"o{x}") + F.col(f"t{x}") for i, x in enumerate("xyz")]


def registered(before: DataFrame, registrations: DataFrame) -> DataFrame:
    """Prior objects in the space of their ``model_id``: centroids moved, boxes those around their moved corners. A box' half extents under a rotation are its entries' sizes times the old ones."""
    r = with_rotation(before, registrations)
    centre = moved([(F.col(f"{x}0") + F.col(f"{x}1")) / 2 for x in "xyz"])
    half = [(F.col(f"{x}1") - F.col(f"{x}0")) / 2 for x in "xyz"]
    reach = [sum((F.abs(F.col(f"m{i}{j}")) * half[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    new = {f"c{x}": v for x, v in zip("xyz", moved([F.col(f"c{x}") for x in "xyz"]), strict=True)}
    for x, c, h in zip("xyz", centre, reach, strict=True):
        new |= {f"{x}0": c - h, f"{x}1": c + h}
    known = F.col("rx").isNotNull()
    return r.select(*(F.when(known, new[k]).otherwise(F.col(k)).alias(k) if k in new else F.col(k) for k in before.columns))


def rigid_transform(points: DataFrame, registrations: DataFrame) -> DataFrame:
    """Points ``model_id, cx, cy, cz`` under Euler3D parameters ``rx ry rz tx ty tz`` about ``ox oy oz``, in order z, y, x (``axes`` ``zyx``) or z, x, y; without a row, as they are."""
    new = dict(zip(("cx", "cy", "cz"), moved([F.col(f"c{x}") for x in "xyz"]), strict=True))
    known = F.col("rx").isNotNull()
    return with_rotation(points, registrations).select(*(F.when(known, new[k]).otherwise(F.col(k)).alias(k) if k in new else F.col(k) for k in points.columns))
