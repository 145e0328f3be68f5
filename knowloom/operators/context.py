"""Context of a code path: its node, what memory knows of it, who depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators import graph as G
from knowloom.operators.lifecycle import active_changes
from knowloom.operators.memory import first_of
from knowloom.operators.search import active
from knowloom.operators.specs import capability_digest


def community_paths(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(project_id, path): paths of the community of each node (project_id, id), or, where none is noted, of its folder."""
    tagged = nodes.where("node_type <> 'document' AND path <> ''").select("project_id", "path", F.coalesce(scalar.json_long(F.col("metadata"), "community_id"), F.lit(0)).alias("community"))
    mine = nodes.join(at.select(*G.NODE), G.NODE, "left_semi").select("project_id", F.col("path").alias("_path"), F.coalesce(scalar.json_long(F.col("metadata"), "community_id"), F.lit(0)).alias("_community"))
    folder = F.regexp_extract("_path", "^(.*)/[^/]*$", 1)
    both = tagged.join(mine.withColumn("_folder", folder), "project_id")
    near = F.when(F.col("_community") > 0, F.col("community") == F.col("_community")).otherwise((F.col("_folder") != "") & F.col("path").startswith(F.concat("_folder", F.lit("/"))))
    return both.where(near | (F.col("path") == F.col("_path"))).select("project_id", "path").distinct()


def graph_boosted(memories: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """(project_id, id, where_path, boosted): memories of a path, and those of its community marked as such; a semi join, however large the community."""
    at = G.resolve_paths(nodes, path)
    rows = active(memories).where("where_path IS NOT NULL")
    direct = F.lower("where_path").contains(path.lower())
    by_community = rows.join(community_paths(nodes, at).select("project_id", F.col("path").alias("where_path")), ["project_id", "where_path"], "left_semi").where(~direct)
    cols = ["project_id", "id", "where_path"]
    return rows.where(direct).select(*cols, F.lit(False).alias("boosted")).unionByName(by_community.select(*cols, F.lit(True).alias("boosted")))


def linked_memories(memories: DataFrame, nodes: DataFrame, edges: DataFrame, at: DataFrame, n: int = 5) -> DataFrame:
    """(project_id, rank, id, what, source): memories of each node's path first, then those that a ``rationale_for`` edge of the graph leads from, each once."""
    where = nodes.join(at.select(*G.NODE), G.NODE, "left_semi").select("project_id", F.col("id").alias("node_id"), "path")
    m = active(memories).withColumn("path", text.node_path(F.col("where_path")))
    by_path = m.join(where, ["project_id", "path"]).select("project_id", "id", F.lit(0).alias("source"))
    reasons = edges.where("relation_type = 'rationale_for'").select("project_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("id"))
    by_edge = reasons.join(where.select("project_id", "node_id"), ["project_id", "node_id"]).select("project_id", "id", F.lit(1).alias("source"))
    once = by_path.unionByName(by_edge).groupBy(*G.NODE).agg(F.min("source").alias("source"))
    full = once.join(active(memories).select(*G.NODE, "what", "created_at"), G.NODE)
    return first_of(full, ["project_id"], [F.col("source"), F.desc_nulls_last("created_at"), F.col("id")], min(max(n, 1), 20)).select("project_id", "rank", "id", text.redact(F.col("what")).alias("what"), "source")


def context_pack(nodes: DataFrame, edges: DataFrame, memories: DataFrame, path: str, n: int = 5, changes: DataFrame | None = None, capabilities: DataFrame | None = None) -> DataFrame:
    """(project_id, section, rank, id, detail): node, memories, dependents, dependencies and blast radius of a path, one frame for all projects.

    With ``changes`` the active ones of the path join in, with ``capabilities`` those that the node implements, ten at most of each.
    """
    at = G.resolve_paths(nodes, path)
    c = F.col
    deg = G.roles(G.degrees(nodes, edges)).join(at.select(*G.NODE), G.NODE, "left_semi")
    node = deg.select("project_id", F.lit("node").alias("section"), F.lit(1).alias("rank"), "id", F.concat_ws(" ", "role", "risk", c("fan_in").cast("string"), c("fan_out").cast("string")).alias("detail"))
    mem = linked_memories(memories, nodes, edges, at, n).select("project_id", F.lit("memory").alias("section"), "rank", "id", c("what").alias("detail"))
    near = G.neighbours(nodes, edges, 5).join(at.select(*G.NODE), G.NODE, "left_semi").select("project_id", c("side").alias("section"), "rank", c("other_id").alias("id"), c("relation_type").alias("detail"))
    blast = G.blast_radius(nodes, edges, at.select("project_id", c("id").alias("start_id")), 3, 10).select("project_id", F.lit("blast").alias("section"), "rank", "id", F.concat(c("depth").cast("string"), F.lit(" "), "relation_type").alias("detail"))
    out = node.unionByName(mem).unionByName(near).unionByName(blast)
    if changes is not None:
        out = out.unionByName(active_changes(changes, path).select("project_id", F.lit("change").alias("section"), "rank", "id", F.concat_ws(" ", "status", "title", "progress").alias("detail")))
    if capabilities is not None:
        mine = edges.where("relation_type = 'implements'").join(at.select("project_id", c("id").alias("source_id")), ["project_id", "source_id"], "left_semi")
        named = mine.select("project_id", F.regexp_replace("target_id", "^spec:", "").alias("capability_path")).distinct().join(capability_digest(capabilities), ["project_id", "capability_path"])
        top = first_of(named, ["project_id"], [c("capability_path")], 10)
        out = out.unionByName(top.select("project_id", F.lit("capability").alias("section"), "rank", c("capability_path").alias("id"), F.concat(c("n").cast("string"), F.lit(": "), "requirements").alias("detail")))
    return out
