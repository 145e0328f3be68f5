"""Consolidating pairwise matches into groups.

Connected components by low-diameter decomposition: every vertex draws an exponentially distributed shift,
clusters grow from the vertices with the largest shifts, each cluster contracts to one vertex, and the
edges between clusters form the next, smaller level. The assignments of all levels are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.runtime import SALT_WAYS, cut, hot_keys, is_empty, release, salted_join

#: Mean of a vertex's shift, in hops. Larger: fewer levels, more growing steps in each.
MEAN_SHIFT = 4.0
#: Shifts are cut off here, so that a cluster's radius, and with it the number of growing steps, is at most this.
MAX_SHIFT = 8
#: A vertex of fewer arcs is no burden to a task.
HUB_ARCS = 10_000


def relation_links(relations: DataFrame, memories: DataFrame) -> DataFrame:
    """Distinct undirected links (src < dst) between two memories of the judging row's project.

    A link is a row of relation_type relates_to or supersedes, letter case, blanks, ``_`` and ``-``
    disregarded. Null, blank and equal ends, unknown memories and rows without project give no link.
    Repeated and reversed rows count once; they are merged before the joins.
    """
    kind = F.regexp_replace(F.lower("relation_type"), r"[\s\u00a0_-]+", "")
    rel = relations.where(kind.isin("relatesto", "supersedes") & (F.col("source_id") != F.col("target_id"))).select(
        "project_id", F.least("source_id", "target_id").alias("src"), F.greatest("source_id", "target_id").alias("dst")
    )
    known = memories.select("project_id", "id").dropna().distinct()
    for end in ("src", "dst"):
        rel = salted_join(rel.distinct(), known.withColumnRenamed("id", end), ["project_id", end], "left_semi")
    return rel.select("src", "dst").distinct()


def shifts(vertices: DataFrame, level: int, seed: int) -> DataFrame:
    """(v, score): minus an exponential shift drawn from the vertex's name, so that a repeated task draws it again."""
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "v"), 11) + F.lit(1)) / F.lit(float(2**53))
    return vertices.select("v", (-F.least(F.lit(float(MAX_SHIFT)), -F.log(draw) * MEAN_SHIFT)).alias("score"))


def hubs(edges: DataFrame) -> list[str]:
    """Vertices with more than a 200th of all arcs, and HUB_ARCS at least: at most 200 by arithmetic, and mostly none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return sorted(r["v"] for r in hot_keys(ends, ["v"], least=HUB_ARCS).collect())


def grow_clusters(edges: DataFrame, hot: list[str], level: int, seed: int) -> DataFrame:
    """(v, center) for every vertex of ``edges``: the center with the least distance minus shift.

    No path longer than MAX_SHIFT can win against a vertex's own shift, so that many steps are exact.
    A step sends a vertex's best offer along its arcs, one of which leads back to itself at no cost, and keeps the least
    offer at each vertex; offers to a hub are merged on the sending side first, and the arcs of ``hot`` vertices lie in
    SALT_WAYS parts, to each of which their offer goes. All steps form one plan, linear in their number, that shuffles the arcs once.
    """
    a, b, hop = F.col("src"), F.col("dst"), F.lit(1.0)
    ends = F.array(F.struct(a.alias("v"), b.alias("to"), hop.alias("cost")), F.struct(b.alias("v"), a.alias("to"), hop.alias("cost")))
    ways = edges.select(F.explode(ends).alias("w")).select("w.*")
    arcs = ways.unionByName(ways.select("v", F.col("v").alias("to"), F.lit(0.0).alias("cost")).distinct())
    on, spread = ["v"], lambda state: state
    if hot:
        is_hot = F.col("v").isin(hot)
        arcs = arcs.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("to"), F.lit(SALT_WAYS)).cast("int")).otherwise(F.lit(0)))
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT_WAYS - 1))).otherwise(F.array(F.lit(0)))
        on, spread = ["v", "part"], lambda state: state.withColumn("part", F.explode(parts))
    arcs = cut(arcs, "arcs")
    state = shifts(arcs.where("cost = 0"), level, seed).withColumn("center", F.col("v"))
    for _ in range(MAX_SHIFT):
        sent = arcs.join(spread(state), on).select(F.col("to").alias("v"), F.struct((F.col("score") + F.col("cost")).alias("score"), "center").alias("offer"))
        state = sent.groupBy("v").agg(F.min("offer").alias("best")).select("v", "best.score", "best.center")
    clusters = cut(state.select("v", "center"), "clusters")
    release(arcs)
    return clusters


def contracted(edges: DataFrame, at: DataFrame, hot: list[str]) -> DataFrame:
    """(src, dst): the distinct edges between the clusters of ``at`` (v, center), src < dst; ``hot`` ends are spread in the joins."""
    out = edges
    for end, name in (("src", "a"), ("dst", "b")):
        side = at.select(F.col("v").alias(end), F.col("center").alias(name))
        known = at.sparkSession.createDataFrame([(v,) for v in hot], f"{end} string") if hot else None
        out = salted_join(out, side, [end], hot=known) if hot else out.join(side, end)
    return out.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def connected_groups(links: DataFrame, seed: int = 17) -> DataFrame:
    """(id, group_id) for every end of ``links`` (src, dst): group_id is the least id reached through links.

    Ids are strings. Links with a null end and self links are ignored: an id that occurs in no other link
    has no row. Repeated and reversed links count once. An empty input gives an empty result. Other columns
    of ``links`` are not looked at. Every level is written to the shared folder.
    """
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    edges = cut(links.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct(), "links")
    levels: list[DataFrame] = []
    while not is_empty(edges):
        hot = hubs(edges)
        at = grow_clusters(edges, hot, len(levels), seed)
        levels.append(at)
        smaller = cut(contracted(edges, at, hot), "links")
        release(edges)
        edges = smaller
    if not levels:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("group_id"))
    root = levels[-1]
    for at in reversed(levels[:-1]):
        up = root.select(F.col("v").alias("center"), F.col("center").alias("top"))
        root = at.join(up, "center", "left").select("v", F.coalesce("top", "center").alias("center"))
    root = cut(root, "roots")
    release(edges, *levels)
    least = root.groupBy("center").agg(F.min("v").alias("group_id"))
    return salted_join(root, least, ["center"]).select(F.col("v").alias("id"), "group_id")
