"""Relationship graph operators (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ends(edges: DataFrame) -> DataFrame:
    """``model_id, object_id, other_id`` and the edge, from either end."""
    ends = F.array(F.struct(F.col("source_id").alias("object_id"), F.col("target_id").alias("other_id")), F.struct(F.col("target_id").alias("object_id"), F.col("source_id").alias("other_id")))
    return edges.select("*", F.explode(ends).alias("e")).select("model_id", "e.object_id", "e.other_id", "source_id", "target_id", "type", "value")


def incident_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges with a wanted object (``model_id, object_id``) at either end, once each."""
    found = both_ends(edges).join(wanted, ["model_id", "object_id"], "left_semi")
    return found.select("model_id", "source_id", "target_id", "type", "value").distinct()


def neighbors(edges: DataFrame) -> DataFrame:
    return both_ends(edges).select("model_id", "object_id", "other_id").distinct()


def ancestors(edges: DataFrame, compat: bool = False) -> DataFrame:
    """``object_id`` and what contains it; ``compat`` takes contains and inside alike."""
    kinds = ["contains", "inside"] if compat else ["contains"]
    return edges.where(F.col("type").isin(kinds)).select("model_id", F.col("target_id").alias("object_id"), F.col("source_id").alias("ancestor_id")).distinct()


def descendants(edges: DataFrame, compat: bool = False) -> DataFrame:
    kinds = ["contains", "inside"] if compat else ["contains"]
    return edges.where(F.col("type").isin(kinds)).select("model_id", F.col("source_id").alias("object_id"), F.col("target_id").alias("descendant_id")).distinct()


def collapse_relations(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair: containment keeps its direction and hides overlap; near keeps its gap."""
    kept = edges.where("type <> 'inside'").withColumns({"low": F.least("source_id", "target_id"), "high": F.greatest("source_id", "target_id"), "order": F.when(F.col("type") == "contains", 0).when(F.col("type") == "intersects", 1).otherwise(2)})
    first = Window.partitionBy("model_id", "low", "high").orderBy("order", "source_id")
    one = kept.withColumn("n", F.row_number().over(first)).where("n = 1")
    return one.select("model_id", F.when(F.col("type") == "contains", F.col("source_id")).otherwise(F.col("low")).alias("source_id"), F.when(F.col("type") == "contains", F.col("target_id")).otherwise(F.col("high")).alias("target_id"), "type", "value")


def edge_ids_per_object(edges: DataFrame) -> DataFrame:
    """Outgoing edges of each object as ``type>target`` in alphabetical order."""
    return edges.groupBy("model_id", F.col("source_id").alias("object_id")).agg(F.array_sort(F.collect_list(F.concat_ws(">", "type", "target_id"))).alias("edges"))


def lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with ``found``; unknown ones as rows without the rest."""
    return wanted.join(rows.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


OPERATIONS = ("neighbors", "ancestors", "descendants", "relationships", "context", "prior_versions")


def results(asked: tuple[str, ...], edges: DataFrame, bindings: DataFrame, links: DataFrame) -> DataFrame:
    """``operation, model_id, object_id, result_id`` of the operations, for all objects."""
    row = lambda name, of, result: F.struct(F.lit(name).alias("operation"), of.alias("object_id"), result.alias("result_id"))
    source, target, edge = F.col("source_id"), F.col("target_id"), F.concat_ws(">", "source_id", "type", "target_id")
    inside = F.col("type") == "contains"
    told = {
        "neighbors": [row("neighbors", source, target), row("neighbors", target, source)],
        "ancestors": [F.when(inside, row("ancestors", target, source))],
        "descendants": [F.when(inside, row("descendants", source, target))],
        "relationships": [row("relationships", source, edge), row("relationships", target, edge)],
    }
    parts = []
    if of_edges := [x for name in asked for x in told.get(name, [])]:  # every edge tells all at once
        parts.append(edges.select("model_id", F.explode(F.array_compact(F.array(*of_edges))).alias("r")).select("r.operation", "model_id", "r.object_id", "r.result_id").distinct())
    if "context" in asked:
        parts.append(bindings.where("target_type = 'object'").select(F.lit("context").alias("operation"), "model_id", F.col("target_id").alias("object_id"), F.col("binding_id").alias("result_id")))
    if "prior_versions" in asked:
        parts.append(links.where("link_type in ('same_as_prior', 'changed_from')").select(F.lit("prior_versions").alias("operation"), "model_id", "object_id", F.col("prior_object_id").alias("result_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``results`` below a row without operation for each wanted object, which alone has ``wanted``: they meet in a grouping by object, so what comes dealt by model stays there."""
    marks = wanted.select(F.lit(None).cast("string").alias("operation"), "model_id", "object_id", F.lit(None).cast("string").alias("result_id"), F.lit(True).alias("wanted"))
    return rows.withColumn("wanted", F.lit(None).cast("boolean")).unionByName(marks)


def graph_query(operation: str, wanted: DataFrame, edges: DataFrame, bindings: DataFrame, links: DataFrame) -> DataFrame:
    """``operation, model_id, object_id, result_id`` for wanted objects (``model_id, object_id``); ``subgraph`` is all operations at once.

    Results are ids of objects, but edges (``source>type>target``) for relationships
    and bindings for context; prior versions are those that links point at.
    """
    if operation not in (*OPERATIONS, "subgraph"):
        raise ValueError(f"operation must be one of {', '.join(OPERATIONS)} or subgraph")
    rows = marked(results(OPERATIONS if operation == "subgraph" else (operation,), edges, bindings, links), wanted)
    known = rows.withColumn("wanted", F.max("wanted").over(Window.partitionBy("model_id", "object_id")))
    return known.where("wanted and operation is not null").select("model_id", "object_id", "operation", "result_id")


def subgraph(wanted: DataFrame, edges: DataFrame, bindings: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each wanted object, with the results of each operation as a sorted array."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("operation") == name, F.col("result_id")))).alias(name) for name in OPERATIONS]
    return marked(results(OPERATIONS, edges, bindings, links), wanted).groupBy("model_id", "object_id").agg(*lists, F.max("wanted").alias("wanted")).where("wanted").drop("wanted")
