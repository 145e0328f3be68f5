"""Exports: JSON, chunks, notes, Cypher, a wiki, and an HTML view. Pages are columns of a frame until a sink writes them."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions import text
from knowloom.operators import graph as G
from knowloom.operators.memory import changed_since, first_of
from knowloom.operators.search import active
from knowloom.sinks.store import write_atomically


def memory_json(memories: DataFrame) -> DataFrame:
    """(path, content): one JSON document for each active memory, fields in alphabetical order, empty ones left out."""
    cols = sorted(c for c in memories.columns if c != "deleted_at")
    return active(memories).select(F.concat("id", F.lit(".json")).alias("path"), F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("content"))


def export_json(memories: DataFrame, path: str) -> int:
    """One indented file with all active memories, oldest first; for projects whose memories fit the driver."""
    rows = [json.loads(r["content"]) for r in memory_json(memories.orderBy("created_at", "id")).toLocalIterator()]
    write_atomically(path, json.dumps(rows, indent=2, ensure_ascii=False).encode())
    return len(rows)


#: Every so many syncs the whole table is written once more as one set.
WHOLE_EVERY = 10


def changed_chunks(memories: DataFrame, last_sync: datetime | None) -> DataFrame:
    """The chunks to write: all on the first sync, then those of rows created or seen since."""
    return memory_json(memories if last_sync is None else changed_since(memories, last_sync))


def writes_whole(syncs: int, last_sync: datetime | None, forced: bool = False) -> bool:
    """Whether a sync writes the whole set beside the chunks: the first one, a forced one, and every tenth."""
    return forced or last_sync is None or (syncs + 1) % WHOLE_EVERY == 0


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): statements that rebuild the graph, nodes first."""
    q = lambda c: F.concat(F.lit('"'), text.cypher_string(F.coalesce(c, F.lit(""))), F.lit('"'))
    c = F.col
    node = F.concat(F.lit("MERGE (n:"), text.cypher_label(c("node_type")), F.lit(" {id: "), q(c("id")), F.lit("}) SET n.label = "), q(c("label")), F.lit(", n.path = "), q(c("path")), F.lit(";"))
    edge = F.concat(F.lit("MATCH (a {id: "), q(c("source_id")), F.lit("}), (b {id: "), q(c("target_id")), F.lit("}) MERGE (a)-[:"), text.cypher_label(c("relation_type")), F.lit("]->(b);"))
    return nodes.select(F.lit(0).alias("kind"), node.alias("line")).unionByName(edges.select(F.lit(1).alias("kind"), edge.alias("line")))


def _bullets(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat(F.lit("- "), x)), "\n")


def memory_notes(memories: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(project_id, path, content): a note for each memory with links to the file it is about."""
    c = F.col
    part = lambda title, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"\n\n## {title}\n\n"), x)).otherwise("")
    name = F.concat(F.lit("memories/"), text.file_name(c("id")), F.lit(".md"))
    link = F.when(F.coalesce(text.node_path(c("where_path")), F.lit("")) != "", F.concat(F.lit("\n\nFile: [["), F.concat(F.lit("../files/"), text.file_name(text.node_path(c("where_path")))), F.lit("]]"))).otherwise("")
    page = F.concat(F.lit("# "), text.redact(c("what")), F.lit("\n\ncategory: "), F.coalesce("category", F.lit("")), link, part("Why", text.redact(c("why"))), part("Learned", text.redact(c("learned"))), F.lit("\n"))
    return active(memories).select("project_id", name.alias("path"), page.alias("content"))


def file_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, content): a note for each file or package with its symbols, dependencies and dependents."""
    files = nodes.where("node_type IN ('file', 'document', 'package')").select("project_id", "id", "label", "node_type")
    syms = nodes.where("node_type IN ('function', 'class', 'type', 'section', 'table')").groupBy("project_id", F.col("path").alias("id")).agg(_bullets(F.collect_set("label")).alias("symbols"))
    deps = edges.groupBy("project_id", F.col("source_id").alias("id")).agg(_bullets(F.collect_set(F.concat("relation_type", F.lit(" [["), text.file_name(F.col("target_id")), F.lit("]]")))).alias("uses"))
    users = edges.groupBy("project_id", F.col("target_id").alias("id")).agg(_bullets(F.collect_set(F.concat("relation_type", F.lit(" [["), text.file_name(F.col("source_id")), F.lit("]]")))).alias("used_by"))
    key = ["project_id", "id"]
    rows = files.join(syms, key, "left").join(deps, key, "left").join(users, key, "left")
    part = lambda title, x: F.when(F.col(x).isNotNull(), F.concat(F.lit(f"\n\n## {title}\n\n"), F.col(x))).otherwise("")
    folder = F.when(F.col("node_type") == "package", "packages/").otherwise("files/")
    page = F.concat(F.lit("# "), F.col("label"), part("Symbols", "symbols"), part("Depends on", "uses"), part("Used by", "used_by"), F.lit("\n"))
    return rows.select("project_id", F.concat(folder, text.file_name(F.col("id")), F.lit(".md")).alias("path"), page.alias("content"))


def simple_vault(memories: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, content): the plain form of the vault, a note for each node with the relations that leave it, and one for each memory."""
    c = F.col
    out = edges.groupBy("project_id", c("source_id").alias("id")).agg(_bullets(F.collect_set(F.concat("relation_type", F.lit(" [["), text.file_name(c("target_id")), F.lit("]]")))).alias("links"))
    page = F.concat(F.lit("# "), F.coalesce("label", "id"), F.lit("\n\ntype: "), F.coalesce("node_type", F.lit("")), F.lit("\npath: "), F.coalesce("path", F.lit("")), F.when(c("links").isNotNull(), F.concat(F.lit("\n\n## Relations\n\n"), c("links"))).otherwise(""), F.lit("\n"))
    notes = nodes.dropDuplicates(G.NODE).join(out, G.NODE, "left").select("project_id", F.concat(F.lit("nodes/"), text.file_name(c("id")), F.lit(".md")).alias("path"), page.alias("content"))
    return notes.unionByName(memory_notes(memories))


def wiki_pages(nodes: DataFrame, edges: DataFrame, member: DataFrame, centrality: DataFrame) -> DataFrame:
    """(project_id, path, content): an index with hubs and communities, and a page for each community with members and edges that leave it."""
    deg = G.degrees(nodes, edges)
    info = G.community_summary(nodes, member, centrality)
    cell = lambda x: text.wiki_label(F.coalesce(x.cast("string"), F.lit("")))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    page_name = lambda c: F.format_string("community-%03d.md", c)
    members = member.join(deg, G.NODE).join(nodes.select("project_id", "id", "label", "node_type").dropDuplicates(G.NODE), G.NODE).join(centrality, G.NODE)
    line = F.struct((-F.col("degree")).alias("o"), F.col("id").alias("k"), row(cell(F.col("label")), F.col("node_type"), F.col("fan_in").cast("string"), F.col("fan_out").cast("string"), F.format_number("centrality", 2), F.col("degree").cast("string")).alias("t"))
    lists = members.groupBy("project_id", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("members"))
    out = G.cross_edges(edges, nodes, member).select("project_id", "community", F.struct("rank", row(cell(F.col("source_id")), cell(F.col("target_id")), F.col("to_community").cast("string"), F.col("relation_type")).alias("t")).alias("x"))
    cross = out.groupBy("project_id", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("cross"))
    both = info.join(lists, ["project_id", "community"]).join(cross, ["project_id", "community"], "left")
    body = F.concat(
        F.lit("# Community "), F.col("community").cast("string"), F.lit(": "), cell(F.col("label")), F.lit("\n\n- Size: "), F.col("size").cast("string"), F.lit(" nodes\n- Mean betweenness: "), F.format_number("mean_centrality", 2),
        F.lit("\n\n## Members\n\n| Node | Type | In | Out | BC | Degree |\n|---|---|---|---|---|---|\n"), F.col("members"),
        F.when(F.col("cross").isNotNull(), F.concat(F.lit("\n\n## Leads to\n\n| Node | To | Community | Relation |\n|---|---|---|---|\n"), F.col("cross"))).otherwise(""), F.lit("\n"),
    )
    pages = both.select("project_id", page_name(F.col("community")).alias("path"), body.alias("content"))
    hubs = first_of(deg.where("degree > 10").join(nodes.select("project_id", "id", "label").dropDuplicates(G.NODE), G.NODE), ["project_id"], [F.desc("degree"), F.col("id")], 10)
    top = hubs.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row(cell(F.col("label")), F.col("degree").cast("string")).alias("t")))), lambda x: x["t"]), "\n").alias("hubs"))
    comms = info.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", row(F.col("community").cast("string"), cell(F.col("label")), F.col("size").cast("string"), cell(F.col("key_id"))).alias("t")))), lambda x: x["t"]), "\n").alias("comms"))
    counts = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).join(G.export_links(edges).groupBy("project_id").agg(F.count(F.lit(1)).alias("m")), "project_id", "left").fillna(0)
    index = counts.join(comms, "project_id", "left").join(top, "project_id", "left")
    text_ = F.concat(
        F.lit("# Graph\n\nNodes: "), F.col("n").cast("string"), F.lit(", edges: "), F.col("m").cast("string"),
        F.when(F.col("hubs").isNotNull(), F.concat(F.lit("\n\n## Hubs\n\n| Node | Degree |\n|---|---|\n"), F.col("hubs"))).otherwise(""),
        F.lit("\n\n## Communities\n\n| Id | Label | Size | Key node |\n|---|---|---|---|\n"), F.coalesce("comms", F.lit("")), F.lit("\n"),
    )
    return pages.unionByName(index.select("project_id", F.lit("index.md").alias("path"), text_.alias("content")))


def view_nodes(nodes: DataFrame, degree: DataFrame, member: DataFrame) -> DataFrame:
    """(project_id, id, label, size, community): what a graph view draws; sizes run from 10 to 60 with the degree."""
    most = degree.groupBy("project_id").agg(F.max("degree").alias("most"))
    size = F.least(F.lit(60.0), F.greatest(F.lit(10.0), 10 + 30 * F.col("degree") / F.greatest("most", F.lit(1))))
    return nodes.join(degree, G.NODE).join(most, "project_id").join(member, G.NODE, "left").select("project_id", "id", "label", size.alias("size"), F.coalesce("community", F.lit(0)).alias("community"))


def html_view(nodes: DataFrame, edges: DataFrame, member: DataFrame, path: str) -> int:
    """A self-contained page that lists and draws one project's graph; the size of the result is that of the page."""
    drawn = [r.asDict() for r in view_nodes(nodes, G.degrees(nodes, edges), member).orderBy("id").toLocalIterator()]
    links = [[r["source_id"], r["target_id"], r["relation_type"]] for r in G.export_links(edges).orderBy("source_id", "target_id").toLocalIterator()]
    data = json.dumps({"nodes": drawn, "links": links}).replace("</", "<\\/")
    page = """<!doctype html><meta charset="utf-8"><title>Graph</title><canvas id="c" width="1200" height="800"></canvas><script>const g=%s;
const n=g.nodes.length,p={};g.nodes.forEach((x,i)=>{const a=2*Math.PI*i/Math.max(1,n);p[x.id]=[600+360*Math.cos(a),400+360*Math.sin(a)]});
const c=document.getElementById("c").getContext("2d");c.strokeStyle="#bbb";g.links.forEach(l=>{const a=p[l[0]],b=p[l[1]];if(a&&b){c.beginPath();c.moveTo(...a);c.lineTo(...b);c.stroke()}});
g.nodes.forEach(x=>{c.fillStyle=`hsl(${x.community*47%%360},60%%,55%%)`;c.beginPath();c.arc(...p[x.id],x.size/6,0,7);c.fill();c.fillStyle="#222";c.fillText(x.label,...p[x.id])});</script>""" % data  # noqa: UP031
    write_atomically(path, page.encode())
    return len(drawn)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, line): nodes by id, then one link for each pair of nodes, as JSON lines."""
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", "node_type", "label", "path", "metadata")).alias("line"))
    links = G.export_links(edges.withColumn("project_id", F.lit(""))).select(F.lit("link").alias("kind"), F.concat_ws(" -> ", "source_id", "target_id").alias("id"), F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"))).alias("line"))
    return n.unionByName(links)


def within_budget(body: Column, tokens: Column | int) -> Column:
    """At most ``tokens`` * 4 characters, cut at the last line break, with a notice."""
    most = (F.lit(tokens) if isinstance(tokens, int) else tokens) * 4
    head = F.substring(body, F.lit(1), most)
    whole = F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(body) > most, F.concat(whole, F.lit("\n... [truncated to fit the token budget]"))).otherwise(body)


def token_estimate(body: Column) -> Column:
    return F.ceil(F.length(body) / 4)
