"""Memories and capabilities as nodes of the code graph, and the edges that tie them to code; all derived, so that a rebuilt graph gets them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import text
from knowloom.operators import lifecycle
from knowloom.operators.memory import code_links
from knowloom.operators.search import active
from knowloom.tables import GRAPH_EDGES, GRAPH_NODES, conform

#: What these operators write into a graph.
DERIVED = ("rationale_for", "implements")


def _capability(path) -> F.Column:  # noqa: ANN001
    return F.concat(F.lit("spec:"), path)


def rationale_links(memories: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a document node for each memory whose path names a file, and its ``rationale_for`` edge to that file."""
    linked = code_links(memories, nodes)
    what = active(memories).select("project_id", F.col("id").alias("memory_id"), text.short_label(text.redact(F.col("what"))).alias("label"))
    docs = linked.select("project_id", "memory_id").distinct().join(what, ["project_id", "memory_id"])
    new = docs.select("project_id", F.col("memory_id").alias("id"), F.lit("document").alias("node_type"), "label", F.concat(F.lit("memory:"), "memory_id").alias("path"))
    edges = linked.select(F.col("edge_id").alias("id"), "project_id", F.col("memory_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("rationale_for").alias("relation_type"), F.lit("INFERRED").alias("confidence"))
    return conform(new, GRAPH_NODES), conform(edges, GRAPH_EDGES)


def capability_links(changes: DataFrame, nodes: DataFrame, memories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node for each capability that a change targets, and ``implements`` edges to it.

    Edges come from the file that a change's path names, and, with ``memories``, from each memory that is linked to a change and has a node in ``nodes``.
    """
    refs = changes.where("capability_path <> ''").select("project_id", F.col("id").alias("change_id"), "capability_path", text.node_path(F.col("where_path")).alias("path"))
    newest = refs.groupBy("project_id", "capability_path").agg(F.max("change_id").alias("change_id"))
    meta = F.to_json(F.struct(F.lit(True).alias("spec"), F.col("capability_path").alias("capability"), F.col("change_id").alias("related_change")))
    specs = newest.select("project_id", _capability(F.col("capability_path")).alias("id"), F.lit("spec").alias("node_type"), text.short_label(F.concat(F.lit("capability: "), "capability_path")).alias("label"), F.col("capability_path").alias("path"), meta.alias("metadata"))
    files = nodes.where("id = path").select("project_id", "path").distinct()
    pairs = refs.where("path <> ''").join(files, ["project_id", "path"]).select("project_id", F.col("path").alias("source_id"), _capability(F.col("capability_path")).alias("target_id"))
    if memories is not None:
        mine = active(memories).where("change_id <> ''").select("project_id", "change_id", F.col("id").alias("source_id"))
        known = nodes.select("project_id", F.col("id").alias("source_id")).distinct()
        told = mine.join(refs.select("project_id", "change_id", "capability_path"), ["project_id", "change_id"]).join(known, ["project_id", "source_id"], "left_semi")
        pairs = pairs.unionByName(told.select("project_id", "source_id", _capability(F.col("capability_path")).alias("target_id")))
    edges = pairs.distinct().select(F.concat("source_id", F.lit("->"), "target_id", F.lit("-implements")).alias("id"), "project_id", "source_id", "target_id", F.lit("implements").alias("relation_type"), F.lit("INFERRED").alias("confidence"))
    return conform(specs, GRAPH_NODES), conform(edges, GRAPH_EDGES)


def relinked(nodes: DataFrame, edges: DataFrame, memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with its links to memories and capabilities as the tables have them now; what a rebuild runs last."""
    docs, rationale = rationale_links(memories, nodes)
    whole = lifecycle.upsert(nodes, docs, ["project_id", "id"])
    caps, implements = capability_links(changes, whole, memories)
    kept = edges.where(~F.coalesce(F.col("relation_type").isin(*DERIVED), F.lit(False)))
    return lifecycle.upsert(whole, caps, ["project_id", "id"]), kept.unionByName(rationale, allowMissingColumns=True).unionByName(implements, allowMissingColumns=True)
