"""Dependency graphs: degrees, traversals, roles, centrality, communities, merge and health.

Graph tables hold the graphs of all projects; ids are unique within a project only, so (project_id, id) is the key throughout.
Traversals take any number of start nodes and advance all of them level by level; what a level adds is written to the
shared folder, so that plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.functions import scalar, text
from knowloom.operators.memory import first_of
from knowloom.runtime import Grown, broadcast_if_small, cut, hot_keys, is_empty, java_function, measured_bytes, release, salted_join, sized_join

NODE = ["project_id", "id"]
HUB_LEAST = 50
BLAST_HUB = 10


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row for each (project, source, target, relation), the least id with its confidence in capitals; edges without an end are left out."""
    whole = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    first = F.min(F.struct("id", F.upper("confidence").alias("confidence"), "source_location")).alias("e")
    return whole.groupBy("project_id", "source_id", "target_id", "relation_type").agg(first).select("project_id", "source_id", "target_id", "relation_type", "e.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, fan_in, fan_out, degree) of every node; parallel edges count each. Both directions are one aggregation."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = edges.select("project_id", F.explode(ends).alias("e")).groupBy("project_id", F.col("e.id").alias("id")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    out = nodes.select(*NODE).join(counted, NODE, "left").fillna(0, ["fan_in", "fan_out"])
    return out.withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def hub_thresholds(degree: DataFrame) -> DataFrame:
    """(project_id, hub_threshold): the degree at index n * 99 / 100 of the sorted degrees, 50 at least.

    Taken from the histogram of degrees, so that a project's nodes are never sorted in one task.
    """
    histogram = degree.groupBy("project_id", "degree").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("project_id")
    upto = histogram.withColumn("upto", F.sum("c").over(w.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return upto.where(F.col("upto") > F.floor(F.col("n") * 99 / 100)).groupBy("project_id").agg(F.greatest(F.lit(HUB_LEAST), F.min("degree")).alias("hub_threshold"))


def top_nodes(nodes: DataFrame, degree: DataFrame, n: int, without: tuple[str, ...] = ("package",)) -> DataFrame:
    """The ``n`` nodes of each project with the highest degree."""
    named = nodes.where(~F.col("node_type").isin(*without)).join(degree, NODE)
    return first_of(named, ["project_id"], [F.desc("degree"), F.col("id")], n).select("project_id", "rank", "id", "label", "node_type", "fan_in", "fan_out", "degree")


def find_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """(project_id, id): the node of each project that a query means: exact id, then path, label, and text within; the shortest, then least id."""
    c = F.col
    rank = F.when(c("id") == query, 5).when(c("path") == query, 4).when(c("label") == query, 3).when(c("id").contains(query) | c("label").contains(query), 2).otherwise(0)
    found = nodes.withColumn("_rank", F.coalesce(rank, F.lit(0))).where("_rank > 0")
    return first_of(found, ["project_id"], [F.desc("_rank"), F.length("id"), c("id")]).select(*NODE)


def resolve_paths(nodes: DataFrame, query: str) -> DataFrame:
    """As :func:`find_nodes` with the ranking of path lookups: id, path, label, path within, label within; then the least id."""
    c, low = F.col, query.lower()
    rank = F.when(c("id") == query, 0).when(c("path") == query, 1).when(c("label") == query, 2).when(F.lower("path").contains(low), 3).when(F.lower("label").contains(low), 4)
    return first_of(nodes.withColumn("_rank", rank).where("_rank IS NOT NULL"), ["project_id"], [c("_rank"), c("id")]).select(*NODE, "label", "node_type", "path")


def _arcs(edges: DataFrame, direction: str, relation: str | None) -> DataFrame:
    """(project_id, a, b): the steps that a traversal may take."""
    e = edges.where(F.col("relation_type") == relation) if relation else edges
    out = e.select("project_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    into = e.select("project_id", F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return (out if direction == "out" else into if direction == "in" else out.unionByName(into)).distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "all", relation: str | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(project_id, start_id, id, depth): nodes within ``depth`` steps of each start (project_id, start_id).

    ``hubs`` (project_id, id) are reached but not passed through, unless a start itself. Null starts are ignored. Arcs of nodes with a large
    share of them are spread in every level's join; what was reached stands in one growing table.
    """
    arcs = cut(_arcs(edges, direction, relation).withColumnRenamed("a", "id"), "arcs")
    hot, keys = cut(hot_keys(arcs, NODE), "hot"), ["project_id", "start_id", "id"]
    hubs = None if hubs is None else cut(hubs.select(*NODE), "hubs")
    seen = Grown(starts.where("start_id IS NOT NULL").select("project_id", "start_id", F.col("start_id").alias("id"), F.lit(0).alias("depth")).distinct(), "seen")
    for level in range(1, max(1, min(depth, 20)) + 1):
        known = seen.read()
        sending = known.where(F.col("depth") == level - 1)
        if hubs is not None and level > 1:
            sending = sending.join(hubs, NODE, "left_anti")
        step = sized_join(arcs, sending.drop("depth"), NODE, hot=hot).select("project_id", "start_id", F.col("b").alias("id")).distinct()
        new = cut(step.join(known, keys, "left_anti").withColumn("depth", F.lit(level)), "level")
        done = is_empty(new)
        seen.add(new)
        release(new)
        if done:
            break
    release(arcs)
    return seen.read()


def subgraph_edges(edges: DataFrame, reached: DataFrame, depth: int, direction: str = "all", relation: str | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(project_id, start_id, edge columns): every edge that the traversal behind ``reached`` looked at."""
    passed = reached.where(F.col("depth") < depth)
    if hubs is not None:
        passed = passed.join(hubs.select(*NODE).withColumn("_hub", F.lit(True)), NODE, "left").where("_hub IS NULL OR depth = 0").drop("_hub")
    e = edges.where(F.col("relation_type") == relation) if relation else edges
    at = lambda end: e.join(passed.select("project_id", "start_id", F.col("id").alias(end)), ["project_id", end]).select("project_id", "start_id", "source_id", "target_id", "relation_type", "confidence")
    found = at("source_id") if direction == "out" else at("target_id") if direction == "in" else at("source_id").unionByName(at("target_id"))
    return found.distinct()


def confidence_shares(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, confidence, n, percent) with whole percents; anything unknown counts as EXTRACTED."""
    kind = F.when(F.upper("confidence").isin("INFERRED", "AMBIGUOUS"), F.upper("confidence")).otherwise("EXTRACTED")
    by = edges.groupBy(*keys, kind.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return by.withColumn("percent", F.floor(100 * F.col("n") / total).cast("int"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 10) -> DataFrame:
    """(project_id, start_id, end_id, hops, path): a shortest directed path for each pair that has one; of several the one with the least ids from its end back.

    Every node reached from a start keeps the least of its predecessors one hop nearer, so a level is one row for each start and node;
    the paths are read off from their ends once the search is over. A start whose pairs are all found leaves the search.
    """
    arcs = cut(_arcs(edges, "out", None).withColumnRenamed("a", "id"), "arcs")
    hot, keys = cut(hot_keys(arcs, NODE), "hot"), ["project_id", "start_id", "id"]
    wanted = cut(pairs.select("project_id", "start_id", "end_id").dropna().distinct(), "pairs")
    first = wanted.select("project_id", "start_id", F.col("start_id").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hops")).distinct()
    seen = Grown(first, "paths")
    ends = wanted.withColumnRenamed("end_id", "id")
    for hops in range(1, max_hops + 1):
        known = seen.read()
        missing = ends.join(known, keys, "left_anti").select("project_id", "start_id").distinct()
        going = known.where(F.col("hops") == hops - 1).join(missing, ["project_id", "start_id"], "left_semi").select(*keys)
        step = sized_join(arcs, going, NODE, hot=hot).groupBy("project_id", "start_id", F.col("b").alias("id")).agg(F.min("id").alias("parent"))
        new = cut(step.join(known, keys, "left_anti").withColumn("hops", F.lit(hops)), "paths")
        done = is_empty(new)
        seen.add(new)
        release(new)
        if done:
            break
    release(arcs)
    back = seen.read()
    found = ends.join(back, keys).select("project_id", "start_id", F.col("id").alias("end_id"), "hops", F.array("id").alias("path"), F.col("parent").alias("at"))
    for _ in range(back.agg(F.max("hops")).first()[0] or 0):  # one row
        up = back.select("project_id", "start_id", F.col("id").alias("at"), F.col("parent").alias("next"))
        found = found.join(up, ["project_id", "start_id", "at"], "left").withColumn("path", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path"))).withColumn("at", F.col("next")).drop("next")
    return found.select("project_id", "start_id", "end_id", "hops", "path")


def blast_radius(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3, most: int = 15) -> DataFrame:
    """(project_id, start_id, rank, id, depth, relation_type, is_hub): who depends on each start, directly or through others.

    Level by level against the edges; within a level by the rank of the dependant's best parent, then its degree, then its id; the first
    ``most`` of a start are kept at every level. Rationale edges do not count as dependence.
    """
    depth, most = min(max(depth, 1), 5), min(max(most, 1), 50)
    ends = F.array_distinct(F.array("source_id", "target_id"))
    degree = edges.select("project_id", F.explode(ends).alias("id")).groupBy(*NODE).agg(F.count(F.lit(1)).alias("degree"))
    into = edges.where("relation_type <> 'rationale_for'").select("project_id", F.col("target_id").alias("parent"), F.col("source_id").alias("id"), "relation_type")
    into = cut(into.join(nodes.select(*NODE).distinct(), NODE, "left_semi").join(degree, NODE), "into")
    hot = cut(hot_keys(into, ["project_id", "parent"]), "hot")
    seen = cut(starts.select("project_id", "start_id", F.col("start_id").alias("id"), F.lit(0).alias("rank")).dropna().distinct(), "seen")
    frontier, out = seen, None
    for level in range(1, depth + 1):
        parents = frontier.select("project_id", "start_id", F.col("id").alias("parent"), F.col("rank").alias("parent_rank"))
        best = F.min(F.struct("parent_rank", "relation_type")).alias("b")
        step = sized_join(into, parents, ["project_id", "parent"], hot=hot).groupBy("project_id", "start_id", "id", "degree").agg(best)
        step = step.join(seen.select("project_id", "start_id", "id"), ["project_id", "start_id", "id"], "left_anti")
        so_far = seen.groupBy("project_id", "start_id").agg(F.max("rank").alias("_n"))
        ranked = first_of(step, ["project_id", "start_id"], [F.col("b.parent_rank"), F.desc("degree"), F.col("id")], most, "_r").join(so_far, ["project_id", "start_id"])
        ranked = ranked.withColumn("rank", F.col("_n") + F.col("_r")).where(F.col("rank") <= most)
        level_rows = cut(ranked.select("project_id", "start_id", "rank", "id", F.lit(level).alias("depth"), F.col("b.relation_type").alias("relation_type"), (F.col("degree") >= BLAST_HUB).alias("is_hub")), "blast")
        out = level_rows if out is None else out.unionByName(level_rows)
        frontier = level_rows
        seen = seen.unionByName(level_rows.select("project_id", "start_id", "id", "rank"))
        if is_empty(frontier):
            break
    return out


def roles(degree: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """(project_id, id, fan_in, fan_out, role, risk): what a node is to its graph and how risky it is to change."""
    d = degree if centrality is None else degree.join(centrality, NODE, "left")
    i, o = F.col("fan_in"), F.col("fan_out")
    bc = F.coalesce(F.col("centrality"), F.lit(0.0)) if centrality is not None else F.lit(0.0)
    god = (i > 10) | (o > 10) | (bc > 50)
    role = F.when(god, "god").when((i == 0) & (o > 0), "entry").when((i > 0) & (o == 0), "leaf").when((i > 0) & (o > 0), "intermediate").otherwise("isolated")
    return d.select(*NODE, "fan_in", "fan_out", role.alias("role"), F.when(god, "HIGH").when((i > 5) | (o > 8), "MEDIUM").otherwise("LOW").alias("risk"))


def neighbours(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """(project_id, id, side, rank, other_id, label, relation_type, confidence): up to ``n`` dependents and dependencies of each node."""
    e = edges.where("relation_type <> 'rationale_for'")
    side = lambda name, of, other: e.select("project_id", F.col(of).alias("id"), F.lit(name).alias("side"), F.col(other).alias("other_id"), "relation_type", "confidence")
    both = side("dependent", "target_id", "source_id").unionByName(side("dependency", "source_id", "target_id"))
    named = both.join(nodes.select("project_id", F.col("id").alias("other_id"), "label").dropDuplicates(["project_id", "other_id"]), ["project_id", "other_id"])
    return first_of(named, ["project_id", "id", "side"], [F.col("other_id"), F.col("relation_type")], n)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``edges`` of which an end is no node. Each distinct end is looked up once, whatever the number of its edges."""
    known = nodes.select(*NODE).distinct().withColumn("_ok", F.lit(True))
    end = lambda e: known.select("project_id", F.col("id").alias(e), F.col("_ok").alias(f"_{e}"))
    both = edges.join(end("source_id"), ["project_id", "source_id"], "left").join(end("target_id"), ["project_id", "target_id"], "left")
    return both.where("_source_id IS NULL OR _target_id IS NULL").drop("_source_id", "_target_id")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select("project_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.join(ends, NODE, "left_anti")


def health(projects: DataFrame, nodes: DataFrame, edges: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(project_id, nodes, edges, self_loops, dangling, orphans, stale_bindings, healthy); orphans alone do not make a graph unhealthy."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    out = projects.select(F.col("id").alias("project_id"))
    parts = [count(nodes, "nodes"), count(edges, "edges"), count(edges.where("source_id = target_id"), "self_loops"), count(dangling_edges(nodes, edges), "dangling"), count(orphan_nodes(nodes, edges), "orphans")]
    parts.append(count(bindings, "stale_bindings") if bindings is not None else projects.select(F.col("id").alias("project_id"), F.lit(0).cast("bigint").alias("stale_bindings")))
    for p in parts:
        out = out.join(p, "project_id", "left")
    return out.fillna(0).withColumn("healthy", F.col("self_loops") + F.col("dangling") + F.col("stale_bindings") == 0)


# -- centrality and communities ---------------------------------------------

#: Arc visits (sources times arcs, by connected part of a project) that one task takes, and the tasks that a project is dealt to at most: its coded arcs are copied to each.
VISITS_A_TASK, MOST_TASKS = 250_000_000, 64
#: The kernel: walks from many sources over arrays.
PATH_SHARES = os.path.join(os.path.dirname(__file__), "PathShares.java")


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that each of ``n`` vertices is connected with by arcs a -> b, whatever their direction."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        np.minimum.at(least, before, least.copy())
        least = least[least]
        if (least == before).all():
            return least


def _coded(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """One row for a project with arcs: its ids that have arcs, in order, its arcs as the kernel takes them, by places of the ids, and the visits they take."""
    ids = pa.chunked_array([nodes["id"].unique().sort()])
    a, b = (pc.index_in(edges[e], value_set=ids.chunk(0), skip_nulls=True).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for e in ("source_id", "target_id"))
    known = (a >= 0) & (b >= 0)
    used, codes = np.unique(np.concatenate([a[known], b[known]]), return_inverse=True)
    ids, n, (a, b) = ids.chunk(0).take(pa.array(used)), len(used), codes.reshape(2, -1)
    part = connected(n, a, b)
    visits = np.bincount(part[np.unique(a)], minlength=n).astype(float) @ np.bincount(part[a], minlength=n)
    packed = np.concatenate([[n], np.stack([a, b], 1).ravel()]).astype("<i4").tobytes()
    listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
    row = pa.table({"project_id": pa.array(nodes["project_id"][:1].to_pylist() or [None], pa.string()), "ids": listed, "arcs": pa.array([packed], pa.binary()), "visits": pa.array([visits], pa.float64())})
    return row.slice(0, min(n, 1))  # none for a project without arcs


def coded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, ids, arcs, visits): the graph of each project as numbers, for :func:`betweenness` and :func:`communities`; edges to unknown nodes do not count.

    Ends are looked up where the project is coded, so nodes and edges are exchanged once each, by project. The graph of one project must fit a worker.
    """
    ends = edges.select("project_id", "source_id", "target_id").where("project_id IS NOT NULL").groupBy("project_id")
    by = nodes.select(*NODE).where("project_id IS NOT NULL AND id IS NOT NULL").groupBy("project_id").cogroup(ends)
    return cut(by.applyInArrow(_coded, "project_id string, ids array<string>, arcs binary, visits double"), "coded")


def _added(graph: pa.Table, parts: pa.Table) -> pa.Table:
    """(project_id, id, centrality) of a project from what the tasks found, added up in their order."""
    total = sum(np.frombuffer(x, "<f8") for x in parts.sort_by("part")["shares"].to_pylist())
    some = np.flatnonzero(total)
    ids = graph["ids"].combine_chunks().flatten().take(pa.array(some))
    return pa.table({"project_id": pa.repeat(graph["project_id"][0], len(some)), "id": ids, "centrality": pa.array(total[some], pa.float64())})


def betweenness(nodes: DataFrame, edges: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """(project_id, id, centrality): directed, unweighted, not normalised; exact.

    The sources of a project are dealt to as many tasks as its work fills, MOST_TASKS at most, each of which gets the project's arcs as numbers: the
    copies stay in proportion to the arcs. ``graph``: what :func:`coded` gives of both, where a caller has it.
    """
    spark = nodes.sparkSession
    java_function(spark, "knowloom_path_shares", PATH_SHARES, T.BinaryType())
    ids, graph = nodes.select(*NODE).distinct(), coded(nodes, edges) if graph is None else graph
    tasks = F.greatest(F.lit(1), F.least(F.lit(MOST_TASKS), F.ceil(F.col("visits") / VISITS_A_TASK))).cast("int")
    work = graph.select("project_id", "arcs", tasks.alias("tasks"), (-F.col("visits") / tasks).alias("turn")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    every = graph.agg(F.coalesce(F.sum(tasks), F.lit(1)).alias("tasks")).first()["tasks"]  # one row
    # a partition for each, the longest first
    dealt = work.repartitionByRange(every, "turn", "project_id", "part")
    shares = dealt.select("project_id", "part", F.call_function("knowloom_path_shares", "arcs", "part", "tasks").alias("shares"))
    found = graph.select("project_id", "ids").groupBy("project_id").cogroup(shares.groupBy("project_id")).applyInArrow(_added, "project_id string, id string, centrality double")
    return ids.join(found, NODE, "left").fillna(0.0, ["centrality"])


#: Rounds of moving within a level, and levels of contraction, at most.
MOST_ROUNDS, MOST_LEVELS = 8, 5
#: A project of at most so many arcs is worked on in one task; larger ones in rounds of joins. The outcome is the same.
LOCAL_ARCS = 4_000_000


def _undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, a, b, w): both directions of the edges between two different known nodes, parallel ones added up."""
    ids = nodes.select(*NODE).distinct()
    known = edges.where(F.col("source_id") != F.col("target_id")).groupBy("project_id", "source_id", "target_id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    for end in ("source_id", "target_id"):
        known = known.join(ids.withColumnRenamed("id", end), ["project_id", end], "left_semi")
    ends = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    return known.select("project_id", F.explode(ends).alias("e"), "w").groupBy("project_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum("w").alias("w"))


def _moved(arcs: DataFrame, hot: DataFrame, members: DataFrame, member_bytes: int, turn: int, by_modularity: bool) -> DataFrame:
    """``members`` (project_id, id, k, m2, community) after one synchronous round, with ``moved``: whether it moved or would on its turn.

    Every vertex weighs the communities of its neighbours; about half of them, another half each turn, may move, so that neighbours do not
    change places for ever. Of two vertices that are alone the one with the greater label moves.
    """
    c = F.col
    near = sized_join(arcs, members.select("project_id", c("id").alias("b"), c("community").alias("to")), ["project_id", "b"], hot=hot, small_bytes=member_bytes)
    near = near.groupBy("project_id", c("a").alias("id"), "to").agg(F.sum("w").alias("links"))
    if by_modularity:
        held = members.groupBy("project_id", "community").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))  # no more rows than members
        mine = sized_join(members, held, ["project_id", "community"], small_bytes=member_bytes)
        other = held.select("project_id", c("community").alias("to"), c("tot").alias("to_tot"), c("size").alias("to_size"))
        options = sized_join(near, other, ["project_id", "to"], small_bytes=member_bytes).join(mine, NODE)
        own = c("to") == c("community")
        gain = c("links") - c("k") * (c("to_tot") - F.when(own, c("k")).otherwise(0.0)) / c("m2")
        allowed = ~own & ~((c("size") == 1) & (c("to_size") == 1) & (c("to") > c("community")))
        best = options.groupBy("project_id", "id", "k", "m2", "community", "tot").agg(F.min(F.when(allowed, F.struct((-gain).alias("o"), "to"))).alias("best"), F.max(F.when(own, gain)).alias("stay"))
        stay = F.coalesce("stay", -c("k") * (c("tot") - c("k")) / c("m2"))
    else:
        options = near.join(members, NODE)
        best = options.groupBy("project_id", "id", "k", "m2", "community").agg(F.min(F.struct((-c("links")).alias("o"), "to")).alias("best"), F.max(F.when(c("to") == c("community"), c("links"))).alias("stay"))
        stay = F.coalesce("stay", F.lit(0.0)) - F.when(c("best.to") < c("community"), 1e-6).otherwise(0.0)  # of equal labels the least
    on_turn = F.md5(F.concat_ws("|", "project_id", "id", F.lit(str(turn)))) < "8"
    go = c("best").isNotNull() & (-c("best.o") > stay + 1e-9)
    # every member has an arc, so none is lost
    return best.select("project_id", "id", "k", "m2", F.when(go & on_turn, c("best.to")).otherwise(c("community")).alias("community"), F.coalesce(go, F.lit(False)).alias("moved"))


def _settled(arcs: DataFrame, members: DataFrame, by_modularity: bool, level: int) -> tuple[DataFrame, bool]:
    """Rounds of moving until no vertex wants to, and whether any did."""
    hot, any_move = cut(hot_keys(arcs, ["project_id", "b"]), "hot"), False
    size = measured_bytes(members)
    for turn in range(MOST_ROUNDS):
        after = cut(_moved(arcs, hot, members, size, turn + level * MOST_ROUNDS, by_modularity), "members")
        still = is_empty(after.where("moved"))
        release(members)
        members, any_move = after, any_move or not still
        if still:
            break
    release(hot)
    return members, any_move


def _in_rounds(arcs: DataFrame, by_modularity: bool) -> DataFrame:
    """(project_id, id, community) of all vertices of ``arcs`` by rounds of joins over all their projects."""
    k = arcs.groupBy("project_id", F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    m2 = broadcast_if_small(cut(arcs.groupBy("project_id").agg(F.sum("w").alias("m2")), "weights"))
    members = cut(k.join(m2, "project_id").select("project_id", "id", "k", "m2", F.col("id").alias("community")), "members")
    levels: list[DataFrame] = []
    for level in range(MOST_LEVELS if by_modularity else 1):
        members, any_move = _settled(arcs, members, by_modularity, level)
        levels.append(members)
        if not any_move or not by_modularity:
            break
        side = lambda x, y: members.select("project_id", F.col("id").alias(x), F.col("community").alias(y))  # noqa: B023, E731
        size = measured_bytes(members)
        between = sized_join(sized_join(arcs, side("a", "ca"), ["project_id", "a"], small_bytes=size), side("b", "cb"), ["project_id", "b"], small_bytes=size).where("ca <> cb")
        arcs = cut(between.groupBy("project_id", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "arcs")
        if is_empty(arcs):
            break
        linked = arcs.select("project_id", F.col("a").alias("id")).distinct()
        grown = members.groupBy("project_id", F.col("community").alias("id")).agg(F.sum("k").alias("k"), F.max("m2").alias("m2")).join(linked, NODE, "left_semi")
        members = cut(grown.withColumn("community", F.col("id")), "members")
    top = levels[-1].select(*NODE, "community")
    for lower in reversed(levels[:-1]):
        up = top.select("project_id", F.col("id").alias("community"), F.col("community").alias("_top"))
        top = sized_join(lower.select(*NODE, "community"), up, ["project_id", "community"], "left", small_bytes=measured_bytes(up)).select(*NODE, F.coalesce("_top", "community").alias("community"))
    return cut(top, "communities")


def _turns(project: str, ids: np.ndarray, turn: int) -> np.ndarray:
    """Which vertices may move in a turn, by the digest that the rounds of joins use."""
    return np.array([hashlib.md5(f"{project}|{i}|{turn}".encode()).digest()[0] < 128 for i in ids], bool)


def settle(project: str, ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, by_modularity: bool) -> np.ndarray:
    """The community of each vertex of one project, as an index into ``ids``, which are in order; arcs a -> b of weight w in both directions.

    The rounds of :func:`_in_rounds` over arrays: same moves, same turns, same contraction.
    """
    n, m2 = len(ids), w.sum()
    k, home, here = np.bincount(a, w, n), np.arange(n), np.arange(n)
    for level in range(MOST_LEVELS if by_modularity else 1):
        com, any_move = np.arange(n), False
        alive = np.zeros(n, bool)
        alive[a] = True
        for turn in range(MOST_ROUNDS):
            pairs, back = np.unique(a * n + com[b], return_inverse=True)
            links, v, to = np.bincount(back, w), pairs // n, pairs % n
            own = to == com[v]
            stay = np.zeros(n)
            if by_modularity:
                tot, size = np.bincount(com[alive], k[alive], n), np.bincount(com[alive], minlength=n)
                score = links - k[v] * (tot[to] - np.where(own, k[v], 0.0)) / m2
                stay = -k * (tot[com] - k) / m2
                allowed = ~own & ~((size[com[v]] == 1) & (size[to] == 1) & (to > com[v]))
            else:
                score, allowed = links, np.ones(len(v), bool)
            stay[v[own]] = score[own]
            order = np.lexsort((to[allowed], -score[allowed], v[allowed]))
            first = np.flatnonzero(np.diff(v[allowed][order], prepend=-1))
            who, best, gain = v[allowed][order][first], to[allowed][order][first], score[allowed][order][first]
            least = stay[who] if by_modularity else stay[who] - np.where(best < com[who], 1e-6, 0.0)
            go = gain > least + 1e-9
            if not go.any():
                break
            any_move = True
            who, best = who[go], best[go]
            on = _turns(project, ids[who], turn + level * MOST_ROUNDS)
            com = com.copy()
            com[who[on]] = best[on]
        here = com[here]
        if not any_move or not by_modularity:
            break
        a, b = com[a], com[b]
        pairs, back = np.unique((a * n + b)[a != b], return_inverse=True)
        w = np.bincount(back, w[a != b])
        a, b = pairs // n, pairs % n
        k = np.bincount(com[alive], k[alive], n)
        if not len(a):
            break
    return home[here]


def _settled_here(by_modularity: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The communities (project_id, id, community) of rows of :func:`coded`; parallel arcs add up, loops do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, listed, packed in zip(*(batch[c] for c in ("project_id", "ids", "arcs")), strict=True):
                ids, packed = listed.values, np.frombuffer(packed.as_buffer(), "<i4").astype(np.int64)
                n, (a, b) = int(packed[0]), packed[1:].reshape(-1, 2).T
                a, b = a[a != b], b[a != b]
                if not len(a):
                    continue
                pairs, w = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
                found = settle(project.as_py(), ids.to_numpy(zero_copy_only=False), pairs // n, pairs % n, w.astype(float), by_modularity)
                yield pa.record_batch({"project_id": pa.repeat(project, n), "id": ids, "community": ids.take(pa.array(found))})

    return run


def communities(nodes: DataFrame, edges: DataFrame, method: str = "modularity", local_arcs: int = LOCAL_ARCS, graph: DataFrame | None = None) -> DataFrame:
    """(project_id, id, community): communities of each project, numbered from 1 by their least node id.

    ``method`` is modularity, local moving and contraction in turn until nothing moves, or propagation, the label most frequent among the
    neighbours. Projects of up to ``local_arcs`` arcs are settled in a task each, larger ones in rounds of joins and aggregations over
    (project, node), with the same outcome, so a project may have any size. The outcome is deterministic.
    Nodes without edges are communities of their own; edges to unknown nodes and to themselves do not count; an empty graph gives an empty result.
    ``graph``: what :func:`coded` gives of both, where a caller has it.
    """
    by_modularity = method != "propagation"
    whole = graph is not None
    if not whole:
        size = edges.where("source_id <> target_id").groupBy("project_id").agg((2 * F.count(F.lit(1))).alias("n"))
    else:
        size = graph.select("project_id", (F.octet_length("arcs") / 4 - 1).alias("n"))  # an arc is there once, as two numbers
    large = cut(size.where(F.col("n") > local_arcs).select("project_id"), "large")
    small = graph.join(broadcast_if_small(large), "project_id", "left_anti") if whole else coded(nodes, edges.join(broadcast_if_small(large), "project_id", "left_anti"))
    ways = small.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).first()["n"]  # one row
    # a partition for each, the largest first
    dealt = small.repartitionByRange(ways, -F.octet_length("arcs"), "project_id").select("project_id", "ids", "arcs")
    top = dealt.mapInArrow(_settled_here(by_modularity), "project_id string, id string, community string")
    if not is_empty(large):
        arcs = _undirected(nodes, edges.join(broadcast_if_small(large), "project_id", "left_semi"))
        top = top.unionByName(_in_rounds(cut(arcs, "arcs"), by_modularity))
    every = nodes.select(*NODE).distinct().join(top, NODE, "left").select(*NODE, F.coalesce("community", "id").alias("community"))
    return relabelled(cut(every, "communities"))


def relabelled(member: DataFrame) -> DataFrame:
    """``member`` (project_id, id, community) with the communities of each project numbered from 1 by their least id."""
    least = member.groupBy("project_id", "community").agg(F.min("id").alias("least"))
    number = least.withColumn("number", F.row_number().over(Window.partitionBy("project_id").orderBy("least")).cast("long"))
    number = cut(number.drop("least"), "numbers")
    return sized_join(member.select(*NODE, "community"), number, ["project_id", "community"]).select(*NODE, F.col("number").alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(project_id, modularity) of a division into communities; edges with an end outside it do not count."""
    end = lambda e, c: member.select("project_id", F.col("id").alias(e), F.col("community").alias(c))
    inner = edges.join(end("source_id", "a"), ["project_id", "source_id"]).join(end("target_id", "b"), ["project_id", "target_id"])
    m = inner.groupBy("project_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    total = inner.select("project_id", F.explode(F.array("a", "b")).alias("c")).groupBy("project_id", "c").agg(F.count(F.lit(1)).alias("d"))
    spread = total.join(m, "project_id").groupBy("project_id").agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("s"))
    return m.join(spread, "project_id").select("project_id", (F.col("inside") / F.col("m") - F.col("s")).alias("modularity"))


def surprising(edges: DataFrame, degree: DataFrame, member: DataFrame, centrality: DataFrame, n: int = 10) -> DataFrame:
    """(project_id, rank, source_id, target_id, relation_type, score): edges that bridge communities between nodes of low degree and high centrality."""
    info = degree.select(*NODE, "degree").join(member, NODE).join(centrality, NODE, "left").fillna(0.0, ["centrality"])
    end = lambda e, p: info.select("project_id", F.col("id").alias(e), *[F.col(c).alias(f"{p}_{c}") for c in ("degree", "community", "centrality")])
    links = edges.groupBy("project_id", "source_id", "target_id").agg(F.min("relation_type").alias("relation_type"))
    both = links.join(end("source_id", "s"), ["project_id", "source_id"]).join(end("target_id", "t"), ["project_id", "target_id"]).where("s_community <> t_community")
    score = (F.col("s_centrality") + F.col("t_centrality")) / F.greatest(F.col("s_degree") + F.col("t_degree"), F.lit(1))
    scored = both.withColumn("score", score).where("score > 0")
    return first_of(scored, ["project_id"], [F.desc("score"), F.col("source_id"), F.col("target_id")], n).select("project_id", "rank", "source_id", "target_id", "relation_type", "s_community", "t_community", "score")


def community_summary(nodes: DataFrame, member: DataFrame, centrality: DataFrame) -> DataFrame:
    """(project_id, community, size, mean_centrality, key_id, label): the most central node, and the label of the most central file, else of any node."""
    label = text.clean_label(F.col("label"), F.col("node_type") == "file")
    rows = member.join(centrality, NODE).join(nodes.select(*NODE, "node_type", label.alias("label")).dropDuplicates(NODE), NODE)
    top = lambda ok, what: F.max_by(F.when(ok, F.col(what)), F.when(ok, F.struct("centrality", F.col("id"))))
    named = F.col("label") != ""
    return rows.groupBy("project_id", "community").agg(
        F.count(F.lit(1)).alias("size"), F.avg("centrality").alias("mean_centrality"), F.max_by("id", F.struct("centrality", "id")).alias("key_id"),
        F.coalesce(top(named & (F.col("node_type") == "file"), "label"), top(named, "label"), F.concat(F.lit("community_"), F.first("community"))).alias("label"),
    )


def cross_edges(edges: DataFrame, nodes: DataFrame, member: DataFrame, n: int = 20) -> DataFrame:
    """(project_id, community, rank, source_id, target_id, relation_type, to_community): up to ``n`` edges that leave each community, by source label."""
    end = lambda e, c: member.select("project_id", F.col("id").alias(e), F.col("community").alias(c))
    named = nodes.select("project_id", F.col("id").alias("source_id"), "label").dropDuplicates(["project_id", "source_id"])
    out = edges.join(end("source_id", "community"), ["project_id", "source_id"]).join(end("target_id", "to_community"), ["project_id", "target_id"]).where("community <> to_community")
    return first_of(out.join(named, ["project_id", "source_id"]), ["project_id", "community"], [F.col("label"), F.col("source_id"), F.col("target_id"), F.col("relation_type")], n).select("project_id", "community", "rank", "source_id", "target_id", "relation_type", "to_community")


def extension_mode(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(project_id, community, ext): the file extension most frequent in a community, the least of equal ones."""
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    by = nodes.where("node_type = 'file'").select(*NODE, ext.alias("ext")).join(member, NODE).groupBy("project_id", "community", "ext").agg(F.count(F.lit(1)).alias("n"))
    return first_of(by, ["project_id", "community"], [F.desc("n"), F.col("ext")]).select("project_id", "community", "ext")


# -- merge -------------------------------------------------------------------


def merge_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, node_type, label, path, metadata): the union by id; metadata merge key by key, the right side wins, all else the left."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    tag = lambda df, k: df.select("id", F.struct("node_type", "label", "path", "metadata").alias(k))
    both = tag(left, "l").join(tag(right, "r"), "id", "full_outer")
    l, r = as_map(F.col("l.metadata")), as_map(F.col("r.metadata"))
    merged = F.map_concat(F.map_filter(l, lambda k, _: ~F.array_contains(F.map_keys(r), k)), r)
    pick = lambda c: F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return both.select("id", pick("node_type"), pick("label"), pick("path"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("metadata"))


def fold_nodes(nodes: DataFrame) -> DataFrame:
    """(id, node_type, label, path, metadata): the graphs of all projects merged in the order of their ids, as :func:`merge_nodes` does with two."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    row = F.struct("project_id", "node_type", "label", "path", "metadata")
    by = nodes.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    over = lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(as_map(x["metadata"])), k)), as_map(x["metadata"]))
    merged = F.aggregate("rows", F.create_map().cast("map<string,string>"), over)
    first = F.col("rows")[0]
    return by.select("id", *[first[c].alias(c) for c in ("node_type", "label", "path")], F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("metadata"))


def merge_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, id, confidence, source_location): the union, one row a relation, the left side's if it has one."""
    tagged = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    first = F.min(F.struct("_side", "id", "confidence", "source_location")).alias("e")
    return tagged.groupBy("source_id", "target_id", "relation_type").agg(first).select("source_id", "target_id", "relation_type", "e.id", "e.confidence", "e.source_location")


def export_links(edges: DataFrame) -> DataFrame:
    """(project_id, source_id, target_id, relation_type): one row for each pair of nodes, the least relation of parallel ones."""
    return edges.groupBy("project_id", "source_id", "target_id").agg(F.min("relation_type").alias("relation_type"))


def token_estimate(nodes: DataFrame, response_tokens: Column) -> DataFrame:
    """(project_id, raw_tokens, savings): four tokens a line of code, 50 lines where none are noted, against a response's size."""
    loc = F.coalesce(scalar.json_long(F.col("metadata"), "loc"), F.lit(50))
    raw = nodes.groupBy("project_id").agg((F.sum(loc) * 4).alias("raw_tokens"))
    return raw.withColumn("savings", F.round(F.col("raw_tokens") / response_tokens, 0))
