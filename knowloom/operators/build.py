"""Code graphs from files: full builds, and syncs that parse only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import code
from knowloom.operators import code as C
from knowloom.runtime import cut
from knowloom.sources.extract import dependencies, extract
from knowloom.sources.files import MANIFESTS, file_nodes, symbol_nodes

NODE = ["project_id", "id"]


def _edge(df: DataFrame, relation: str, confidence: str | None = None) -> DataFrame:
    c = F.col
    conf = F.lit(confidence) if confidence else c("confidence")
    at = c("source_location") if "source_location" in df.columns else F.lit(None).cast("string")
    return df.select(F.concat_ws("-", "source_id", "target_id", F.lit(relation)).alias("id"), "project_id", "source_id", "target_id", F.lit(relation).alias("relation_type"), conf.alias("confidence"), at.alias("source_location"))


def edges_of(files: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave ``files``: contained symbols, imports and links, calls, manifest dependencies; ``nodes`` are those of the whole graph."""
    syms = C.symbols(nodes)
    here = nodes.join(files.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    inside = here.where("id <> path AND node_type <> 'package'").select("project_id", F.col("path").alias("source_id"), F.col("id").alias("target_id"))
    spots = found.where("kind = 'import'").groupBy("project_id", F.col("path").alias("source_path"), F.col("name").alias("imported")).agg(F.min("line").alias("line"))
    is_md = code.extension(F.col("source_path")) == ".md"
    imports = C.resolve_imports(spots.where(~is_md), nodes).join(spots, ["project_id", "source_path", "imported"])
    links = C.resolve_links(spots.where(is_md).select("project_id", "source_path", F.col("imported").alias("target")), nodes)
    calls = found.where("kind = 'call'").select("project_id", "path", "line", "col", F.col("name").alias("callee"))
    guessed = C.heuristic_calls(files, syms, found.where("kind = 'call'").select("project_id", "path"))
    called = C.all_calls(C.call_edges(calls, syms), guessed)
    out = _edge(inside, "contains", "EXTRACTED")
    out = out.unionByName(_edge(imports.select("project_id", F.col("source_path").alias("source_id"), "target_id", F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location")), "imports", "EXTRACTED"))
    out = out.unionByName(_edge(links.select("project_id", F.col("source_path").alias("source_id"), F.col("node_id").alias("target_id")), "references", "EXTRACTED"))
    out = out.unionByName(_edge(called.where("source_id <> target_id"), "calls"))
    return out.unionByName(_edge(dependencies(files.where(code.base_name(F.col("path")).isin(*MANIFESTS))), "depends_on", "INFERRED")).dropDuplicates(["project_id", "source_id", "target_id", "relation_type"])


def package_nodes(edges: DataFrame) -> DataFrame:
    """A node for each package that an edge leads to."""
    name = F.substring("target_id", F.lit(5), F.length("target_id"))
    rows = edges.where(F.col("target_id").startswith("pkg:")).select("project_id", F.col("target_id").alias("id"), F.lit("package").alias("node_type"), name.alias("label"), name.alias("path"), F.lit(None).cast("string").alias("metadata"))
    return rows.dropDuplicates(NODE)


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files`` (project_id, path, content, ...); each file is parsed once."""
    found = cut(extract(files), "found")
    own = cut(file_nodes(files).unionByName(symbol_nodes(found)), "nodes")
    edges = cut(edges_of(files, found, own), "edges")
    return own.unionByName(package_nodes(edges)), edges


def sync_graph(old_nodes: DataFrame, old_edges: DataFrame, old_files: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diff): the graph after files changed, by time and size, since ``old_files``.

    Projects of which more than 30 percent of the files changed, or none was tracked, are built anew; of the others only changed files
    are parsed, their nodes and leaving edges replaced, and nodes of deleted files dropped with all their edges.
    """
    diff = cut(C.snapshot_diff(old_files, files), "diff")
    full = C.rebuilds(diff, old_files).where("needs_full").select("project_id")
    touched = diff.where("status <> 'deleted'").select("project_id", "path")
    todo = cut(files.join(touched, ["project_id", "path"], "left_semi").unionByName(files.join(full, "project_id", "left_semi")).dropDuplicates(["project_id", "path"]), "todo")
    gone = diff.select("project_id", "path").unionByName(old_files.join(full, "project_id", "left_semi").select("project_id", "path")).distinct()
    kept = old_nodes.where("node_type <> 'package'").join(gone, ["project_id", "path"], "left_anti")
    found = cut(extract(todo), "found")
    nodes = cut(kept.unionByName(file_nodes(todo).unionByName(symbol_nodes(found))), "nodes")
    fresh = edges_of(todo, found, nodes)
    owner = F.substring_index("source_id", ":", 1)
    stay = old_edges.withColumn("path", owner).join(gone, ["project_id", "path"], "left_anti").drop("path")
    known = nodes.select("project_id", F.col("id").alias("target_id"))
    stay = stay.where(F.col("target_id").startswith("pkg:")).unionByName(stay.where(~F.col("target_id").startswith("pkg:")).join(known, ["project_id", "target_id"], "left_semi").select(*stay.columns))
    edges = cut(fresh.unionByName(stay.select(*fresh.columns)), "edges")
    return nodes.unionByName(package_nodes(edges)), edges, diff


def file_meta(files: DataFrame) -> DataFrame:
    """(project_id, path, mtime_ms, size): what the next sync compares with; it replaces what was kept of these projects."""
    return files.select("project_id", "path", "mtime_ms", "size").dropDuplicates(["project_id", "path"])


def replaced_meta(kept: DataFrame, files: DataFrame) -> DataFrame:
    """``kept`` with the rows of every project of ``files`` replaced by its files as they are now."""
    now = file_meta(files)
    return kept.join(now.select("project_id").distinct(), "project_id", "left_anti").unionByName(now)


def persist_insight(nodes: DataFrame, member: DataFrame, centrality: DataFrame) -> DataFrame:
    """``nodes`` with community and centrality added to their metadata."""
    rows = nodes.join(member, NODE, "left").join(centrality, NODE, "left")
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(meta, lambda k, _: ~k.isin("community_id", "betweenness_centrality"))
    added = F.map_filter(F.create_map(F.lit("community_id"), F.col("community").cast("string"), F.lit("betweenness_centrality"), F.col("centrality").cast("string")), lambda _, v: v.isNotNull())
    return rows.withColumn("metadata", F.to_json(F.map_concat(rest, added))).select(*nodes.columns)
