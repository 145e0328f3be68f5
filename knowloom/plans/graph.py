"""Graph operators over the graphs of all projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowloom.operators import graph as G
from knowloom.operators import memory as M
from knowloom.plans import sqltext as q
from knowloom.runtime import cut
from knowloom.tables import table

DEPTH, MOST = 3, 15
FIND = "gate"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_nodes").dropDuplicates(["project_id", "id"])


def _edges(s: SparkSession, d: str) -> DataFrame:
    return G.clean_edges(table(s, d, "graph_edges"))


def _deg(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(_nodes(s, d), _edges(s, d))


def _starts(s: SparkSession, d: str) -> DataFrame:
    return G.top_nodes(_nodes(s, d), _deg(s, d), 1).select("project_id", F.col("id").alias("start_id"))


def _hubs(s: SparkSession, d: str) -> DataFrame:
    deg = _deg(s, d)
    return deg.join(G.hub_thresholds(deg), "project_id").where("degree >= hub_threshold").select("project_id", "id")


def _given(s: SparkSession, d: str) -> DataFrame:
    """The communities that modularity finds."""
    return G.communities(_nodes(s, d), _edges(s, d))


def _central(s: SparkSession, d: str) -> DataFrame:
    """Betweenness, rounded, so that sums in another order agree."""
    return G.betweenness(_nodes(s, d), _edges(s, d)).withColumn("centrality", F.round("centrality", 4))


def _links(s: SparkSession, d: str) -> DataFrame:
    """The edges without what only describes them, written once for all steps that read them."""
    return cut(_edges(s, d).select("project_id", "source_id", "target_id", "relation_type"), "links")


def _insight(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`_given` and :func:`_central` of one coded graph."""
    graph = G.coded(nodes, edges)
    return G.communities(nodes, edges, graph=graph), G.betweenness(nodes, edges, graph).withColumn("centrality", F.round("centrality", 4))


def surprising(s: SparkSession, d: str) -> DataFrame:
    nodes, links = _nodes(s, d), _links(s, d)
    return G.surprising(links, G.degrees(nodes, links), *_insight(nodes, links)).withColumn("score", F.round("score", 6))


def bfs_nodes(s: SparkSession, d: str) -> DataFrame:
    return G.bfs(_edges(s, d), _starts(s, d), DEPTH, "all", hubs=_hubs(s, d))


def bfs_out(s: SparkSession, d: str) -> DataFrame:
    return G.bfs(_edges(s, d), _starts(s, d), DEPTH, "out", relation="calls")


def bfs_edges(s: SparkSession, d: str) -> DataFrame:
    hubs, edges = _hubs(s, d), _edges(s, d)
    return G.subgraph_edges(edges, G.bfs(edges, _starts(s, d), DEPTH, "all", hubs=hubs), DEPTH, "all", hubs=hubs)


def path_lengths(s: SparkSession, d: str) -> DataFrame:
    ends = _nodes(s, d).where("node_type = 'file'").select("project_id", F.col("id").alias("end_id"))
    return G.shortest_paths(_edges(s, d), _starts(s, d).join(ends, "project_id")).withColumn("path", F.array_join("path", " > "))


def blast(s: SparkSession, d: str) -> DataFrame:
    return G.blast_radius(_nodes(s, d), _edges(s, d), _starts(s, d), DEPTH, MOST)


def health(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "graph_nodes")
    files = n.where("node_type IN ('file', 'document')").select("project_id", "path")
    return G.health(table(s, d, "projects"), n, table(s, d, "graph_edges"), M.stale_bindings(table(s, d, "memories"), files))


def two_sides(s: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The tables of all projects in two halves by project id, each folded into one graph: the sides of a merge that every row takes part in."""
    t = _nodes(s, d) if name == "graph_nodes" else _edges(s, d)
    half = t.select("project_id").distinct().withColumn("half", F.ntile(2).over(Window.orderBy("project_id")))
    t = t.join(F.broadcast(half), "project_id")
    sides = tuple(t.where(F.col("half") == k).drop("half") for k in (1, 2))
    return tuple(G.fold_nodes(x) for x in sides) if name == "graph_nodes" else tuple(x.drop("project_id") for x in sides)


QUERIES = {
    "flt_15_resolve": lambda s, d: G.resolve_paths(_nodes(s, d), FIND).select("project_id", "id"),
    "flt_16_find": lambda s, d: G.find_nodes(_nodes(s, d), FIND),
    "agg_09_degrees": _deg,
    "agg_10_hub_thresholds": lambda s, d: G.hub_thresholds(_deg(s, d)),
    "agg_13_confidence": lambda s, d: G.confidence_shares(_edges(s, d), "project_id"),
    "agg_14_tokens": lambda s, d: G.token_estimate(_nodes(s, d), F.lit(1000)),
    "agg_15_communities": lambda s, d: G.community_summary(_nodes(s, d), *_insight(_nodes(s, d), _edges(s, d))).withColumn("mean_centrality", F.round(F.col("mean_centrality") * F.col("size"), 4) / F.col("size")),
    "agg_16_extension": lambda s, d: G.extension_mode(_nodes(s, d), _given(s, d)),
    "agg_17_edge_pairs": lambda s, d: G.export_links(_edges(s, d)).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")),
    "agg_18_health": health,
    "srt_05_god_nodes": lambda s, d: G.top_nodes(_nodes(s, d), _deg(s, d), 10),
    "srt_06_hotspots": lambda s, d: G.top_nodes(_nodes(s, d), _deg(s, d), 3, ("document", "package")),
    "join_03_neighbours": lambda s, d: G.neighbours(_nodes(s, d), _edges(s, d)),
    "join_09_dangling": lambda s, d: G.dangling_edges(_nodes(s, d), _edges(s, d)).select("project_id", "source_id", "target_id", "relation_type"),
    "join_09_orphans": lambda s, d: G.orphan_nodes(_nodes(s, d), _edges(s, d)).select("project_id", "id"),
    "gra_01_bfs": bfs_nodes,
    "gra_01_bfs_out": bfs_out,
    "gra_01_edges": bfs_edges,
    "gra_02_paths": path_lengths,
    "gra_03_blast": blast,
    "gra_04_propagation": lambda s, d: G.communities(_nodes(s, d), _edges(s, d), "propagation"),
    "gra_05_communities": lambda s, d: G.communities(_nodes(s, d), _edges(s, d)),
    "gra_05_modularity": lambda s, d: G.modularity(_edges(s, d), _given(s, d)).withColumn("modularity", F.round("modularity", 6)),
    "gra_06_betweenness": _central,
    "gra_08_surprising": surprising,
    "gra_09_roles": lambda s, d: G.roles(_deg(s, d)),
    "win_08_cross_edges": lambda s, d: G.cross_edges(_edges(s, d), _nodes(s, d), _given(s, d)),
    "set_04_merge_nodes": lambda s, d: G.merge_nodes(*two_sides(s, d, "graph_nodes")),
    "set_04_merge_edges": lambda s, d: G.merge_edges(*two_sides(s, d, "graph_edges")).select("source_id", "target_id", "relation_type", "id"),
    "snk_08_links": lambda s, d: G.export_links(_edges(s, d)),
}

_N = "n AS (SELECT project_id, id, any_value(node_type) AS node_type, any_value(label) AS label, any_value(path) AS path, any_value(metadata) AS metadata FROM graph_nodes GROUP BY project_id, id)"
_E = "e AS (SELECT project_id, source_id, target_id, relation_type, min(id) AS id, min(upper(confidence)) AS confidence FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL)"
_D = """d AS (SELECT n.project_id, n.id, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM n
    LEFT JOIN (SELECT project_id, target_id AS id, count(*) AS c FROM e GROUP BY ALL) i ON i.project_id = n.project_id AND i.id = n.id
    LEFT JOIN (SELECT project_id, source_id AS id, count(*) AS c FROM e GROUP BY ALL) o ON o.project_id = n.project_id AND o.id = n.id)"""
_BASE = f"WITH RECURSIVE {_N}, {_E}, {_D}"
_H = "h AS (SELECT project_id, greatest(50, list_sort(list(degree))[least(len(list(degree)) * 99 // 100, len(list(degree)) - 1) + 1]) AS hub_threshold FROM d GROUP BY project_id)"
_S = "st AS (SELECT d.project_id, d.id AS start_id FROM d JOIN n USING (project_id, id) WHERE node_type <> 'package' QUALIFY row_number() OVER (PARTITION BY d.project_id ORDER BY degree DESC, d.id) = 1)"
_HUB = "hub AS (SELECT d.project_id, d.id FROM d JOIN h USING (project_id) WHERE degree >= hub_threshold)"
_ARCS = "arc AS (SELECT project_id, source_id AS a, target_id AS b FROM e UNION SELECT project_id, target_id, source_id FROM e)"
_WALK = f"""w(project_id, start_id, id, depth) AS (SELECT project_id, start_id, start_id, 0 FROM st UNION
    SELECT w.project_id, w.start_id, b, depth + 1 FROM w JOIN arc ON arc.project_id = w.project_id AND arc.a = w.id WHERE depth < {DEPTH} AND (depth = 0 OR NOT EXISTS (SELECT 1 FROM hub WHERE hub.project_id = w.project_id AND hub.id = w.id))),
    r AS (SELECT project_id, start_id, id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY ALL)"""
#: Undirected weights, the start of the rounds of :func:`knowloom.operators.graph.settle`.
_UN = """un AS MATERIALIZED (SELECT project_id, a, b, sum(w)::DOUBLE AS w FROM (SELECT project_id, unnest([source_id, target_id]) AS a, unnest([target_id, source_id]) AS b, w FROM
    (SELECT e.project_id, source_id, target_id, count(*) AS w FROM e JOIN n x ON x.project_id = e.project_id AND x.id = source_id JOIN n y ON y.project_id = e.project_id AND y.id = target_id WHERE source_id <> target_id GROUP BY ALL)) GROUP BY ALL),
    m2 AS MATERIALIZED (SELECT project_id, sum(w) AS m2 FROM un GROUP BY 1)"""


def _round_sql(arcs: str, before: str, after: str, turn: int, by_modularity: bool) -> str:
    """One round over ``arcs`` from members ``before`` (project_id, id, k, community) to ``after``."""
    near = f"SELECT u.project_id, u.a AS id, m.community AS dest, sum(u.w) AS links FROM {arcs} u JOIN {before} m ON m.project_id = u.project_id AND m.id = u.b GROUP BY ALL"
    if by_modularity:
        held = f"SELECT project_id, community, sum(k) AS tot, count(*) AS size FROM {before} GROUP BY ALL"
        gain = "links - m.k * (t.tot - CASE WHEN dest = m.community THEN m.k ELSE 0 END) / m2"
        best = f"""SELECT m.project_id, m.id, m.k, m.community, max(CASE WHEN dest = m.community THEN {gain} END) AS own, any_value(-m.k * (h.tot - m.k) / m2) AS alone,
            min({{'o': -({gain}), 't': dest}}) FILTER (dest <> m.community AND NOT (h.size = 1 AND t.size = 1 AND dest > m.community)) AS best
            FROM near JOIN {before} m ON m.project_id = near.project_id AND m.id = near.id JOIN held h ON h.project_id = m.project_id AND h.community = m.community JOIN held t ON t.project_id = near.project_id AND t.community = dest JOIN m2 ON m2.project_id = m.project_id GROUP BY m.project_id, m.id, m.k, m.community"""
        stay = "coalesce(own, alone)"
    else:
        held = "SELECT 1"
        best = f"SELECT m.project_id, m.id, m.k, m.community, max(CASE WHEN dest = m.community THEN links END) AS own, min({{'o': -links, 't': dest}}) AS best FROM near JOIN {before} m ON m.project_id = near.project_id AND m.id = near.id GROUP BY m.project_id, m.id, m.k, m.community"
        stay = "coalesce(own, 0) - CASE WHEN best.t < community THEN 1e-6 ELSE 0 END"
    return f"""{after} AS MATERIALIZED (WITH near AS MATERIALIZED ({near}), held AS MATERIALIZED ({held}), pick AS ({best})
        SELECT project_id, id, k, CASE WHEN best IS NOT NULL AND -best.o > {stay} + 1e-9 AND md5(project_id || '|' || id || '|{turn}') < '8' THEN best.t ELSE community END AS community FROM pick)"""


def _rounds_sql(by_modularity: bool) -> str:
    """CTEs that end in g (project_id, id, community): all rounds and levels written out."""
    ctes, arcs = [_UN], "un"
    ctes.append("s0 AS MATERIALIZED (SELECT project_id, a AS id, sum(w) AS k, a AS community FROM un GROUP BY project_id, a)")
    at, lasts = "s0", []
    for level in range(G.MOST_LEVELS if by_modularity else 1):
        for turn in range(G.MOST_ROUNDS):
            new = f"s{level}_{turn}"
            ctes.append(_round_sql(arcs, at, new, turn + level * G.MOST_ROUNDS, by_modularity))
            at = new
        lasts.append(at)
        if by_modularity and level < G.MOST_LEVELS - 1:
            ctes.append(f"un{level} AS MATERIALIZED (SELECT u.project_id, x.community AS a, y.community AS b, sum(u.w) AS w FROM {arcs} u JOIN {at} x ON x.project_id = u.project_id AND x.id = u.a JOIN {at} y ON y.project_id = u.project_id AND y.id = u.b WHERE x.community <> y.community GROUP BY ALL)")
            arcs = f"un{level}"
            ctes.append(f"c{level} AS MATERIALIZED (SELECT project_id, community AS id, sum(k) AS k, community FROM {at} m WHERE EXISTS (SELECT 1 FROM {arcs} u WHERE u.project_id = m.project_id AND u.a = m.community) GROUP BY project_id, community)")
            at = f"c{level}"
    joins = " ".join(f"LEFT JOIN {t} l{i} ON l{i}.project_id = n.project_id AND l{i}.id = " + (f"l{i - 1}.community" if i else "n.id") for i, t in enumerate(lasts))
    top = "coalesce(" + ", ".join(f"l{i}.community" for i in reversed(range(len(lasts)))) + ", n.id)"
    ctes.append(f"top AS (SELECT n.project_id, n.id, {top} AS c FROM n {joins})")
    ctes.append("lst AS (SELECT project_id, c, row_number() OVER (PARTITION BY project_id ORDER BY min(id)) AS community FROM top GROUP BY project_id, c)")
    ctes.append("g AS MATERIALIZED (SELECT top.project_id, id, community FROM top JOIN lst ON lst.project_id = top.project_id AND lst.c = top.c)")
    return ", ".join(ctes)


_G = _rounds_sql(True)
#: Betweenness from all pairs: distances, then path counts by level, then the share of each vertex between each pair.
_B = """ar AS MATERIALIZED (SELECT e.project_id, source_id AS a, target_id AS b, count(*)::DOUBLE AS w FROM e JOIN n x ON x.project_id = e.project_id AND x.id = source_id JOIN n y ON y.project_id = e.project_id AND y.id = target_id GROUP BY ALL),
    ws(project_id, s, v, depth) AS (SELECT DISTINCT project_id, a, a, 0 FROM ar UNION SELECT ws.project_id, s, ar.b, depth + 1 FROM ws JOIN ar ON ar.project_id = ws.project_id AND ar.a = ws.v WHERE depth < 40),
    ds AS MATERIALIZED (SELECT project_id, s, v, min(depth) AS depth FROM ws GROUP BY ALL),
    sg(project_id, s, v, depth, sigma) AS (SELECT project_id, s, v, 0, 1.0::DOUBLE FROM ds WHERE depth = 0 UNION ALL
      SELECT q.project_id, q.s, q.v, q.depth, q.sigma FROM (SELECT sg.project_id, sg.s, ar.b AS v, sg.depth + 1 AS depth, sum(sg.sigma * ar.w) AS sigma FROM sg JOIN ar ON ar.project_id = sg.project_id AND ar.a = sg.v GROUP BY ALL) q
      JOIN ds ON ds.project_id = q.project_id AND ds.s = q.s AND ds.v = q.v AND ds.depth = q.depth),
    bt AS (SELECT x.project_id, x.v AS id, sum(x.sigma * y.sigma / z.sigma) AS c FROM sg x JOIN sg y ON y.project_id = x.project_id AND y.s = x.v JOIN sg z ON z.project_id = x.project_id AND z.s = x.s AND z.v = y.v AND z.depth = x.depth + y.depth
      WHERE x.s <> x.v AND y.v <> x.v AND y.v <> x.s GROUP BY ALL),
    bc AS MATERIALIZED (SELECT n.project_id, n.id, round(coalesce(c, 0), 4) AS centrality FROM n LEFT JOIN bt ON bt.project_id = n.project_id AND bt.id = n.id)"""
_FIRSTN = "CAST(row_number() OVER (PARTITION BY project_id ORDER BY degree DESC, id) AS INT) AS rank"


def blast_ctes(most: int = MOST) -> list[str]:
    """CTEs l1 .. of the levels of dependants of st (project_id, start_id) in n and e."""
    ctes = [
        "dg AS (SELECT project_id, id, count(*) AS degree FROM (SELECT project_id, unnest(list_distinct([source_id, target_id])) AS id FROM e) GROUP BY ALL)",
        "inn AS (SELECT e.project_id, target_id AS parent, source_id AS id, relation_type, degree FROM e JOIN dg ON dg.project_id = e.project_id AND dg.id = source_id WHERE relation_type <> 'rationale_for' AND EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = source_id))",
        "l0 AS (SELECT project_id, start_id, start_id AS id, 0 AS rank, 0 AS depth, NULL AS relation_type, false AS is_hub FROM st)",
    ]
    for k in range(1, DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(k))
        ctes.append(f"s{k} AS ({seen})")
        ctes.append(f"""c{k} AS (SELECT p.project_id, p.start_id, i.id, degree, min(p.rank) AS pr, arg_min(i.relation_type, (p.rank, i.relation_type)) AS rel FROM l{k - 1} p JOIN inn i ON i.project_id = p.project_id AND i.parent = p.id
            WHERE NOT EXISTS (SELECT 1 FROM s{k} s WHERE s.project_id = p.project_id AND s.start_id = p.start_id AND s.id = i.id) GROUP BY p.project_id, p.start_id, i.id, degree)""")
        ctes.append(f"""l{k} AS (SELECT project_id, start_id, id, rank, depth, relation_type, is_hub FROM (SELECT project_id, start_id, id, CAST(row_number() OVER (PARTITION BY project_id, start_id ORDER BY pr, degree DESC, id) + (SELECT max(rank) FROM s{k} s WHERE s.project_id = c{k}.project_id AND s.start_id = c{k}.start_id) AS INT) AS rank,
            {k} AS depth, rel AS relation_type, degree >= 10 AS is_hub FROM c{k}) WHERE rank <= {most})""")
    return ctes


_LEVELS = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, DEPTH + 1))


_FIND_RANK = f"CASE WHEN id = '{FIND}' THEN 5 WHEN path = '{FIND}' THEN 4 WHEN label = '{FIND}' THEN 3 WHEN contains(id, '{FIND}') OR contains(label, '{FIND}') THEN 2 ELSE 0 END"
_RES_RANK = f"CASE WHEN id = '{FIND}' THEN 0 WHEN path = '{FIND}' THEN 1 WHEN label = '{FIND}' THEN 2 WHEN contains(lower(path), '{FIND}') THEN 3 WHEN contains(lower(label), '{FIND}') THEN 4 END"
_LABEL = f"CASE WHEN node_type = 'file' THEN substring({q.trim('label')}, 1, 50) ELSE {q.trim('string_split(substring(' + q.trim('label') + ', 1, 50), chr(10))[1]')} END"
_SCORE = "(sb.centrality + tb.centrality) / greatest(sd.degree + td.degree, 1)"

SQL = {
    "flt_15_resolve": f"{_BASE} SELECT project_id, id FROM (SELECT *, {_RES_RANK} AS r FROM n) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY r, id) = 1",
    "flt_16_find": f"{_BASE} SELECT project_id, id FROM (SELECT *, {_FIND_RANK} AS r FROM n) WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY r DESC, length(id), id) = 1",
    "agg_09_degrees": f"{_BASE} SELECT * FROM d",
    "agg_10_hub_thresholds": f"{_BASE}, {_H} SELECT * FROM h",
    "agg_13_confidence": f"{_BASE} SELECT *, CAST(floor(100 * n / sum(n) OVER (PARTITION BY project_id)) AS INT) AS percent FROM (SELECT project_id, CASE WHEN confidence IN ('INFERRED', 'AMBIGUOUS') THEN confidence ELSE 'EXTRACTED' END AS confidence, count(*) AS n FROM e GROUP BY 1, 2)",
    "agg_14_tokens": f"{_BASE} SELECT project_id, CAST(sum(coalesce(CASE WHEN json_valid(metadata) THEN CAST(floor(TRY_CAST(json_extract_string(metadata, '$.loc') AS DOUBLE)) AS BIGINT) END, 50)) * 4 AS BIGINT) AS raw_tokens, round(raw_tokens / 1000) AS savings FROM n GROUP BY project_id",
    "agg_15_communities": f"""{_BASE}, {_G}, {_B}, r AS (SELECT g.*, centrality AS c, node_type, {_LABEL} AS lab FROM g JOIN bc USING (project_id, id) JOIN n USING (project_id, id))
        SELECT project_id, community, count(*) AS size, round(sum(c), 4) / count(*) AS mean_centrality, arg_max(id, (c, id)) AS key_id, coalesce(arg_max(lab, (c, id)) FILTER (node_type = 'file' AND lab <> ''), arg_max(lab, (c, id)) FILTER (lab <> ''), 'community_' || community) AS label FROM r GROUP BY project_id, community""",
    "agg_16_extension": rf"{_BASE}, {_G} SELECT project_id, community, ext FROM (SELECT g.project_id, community, regexp_extract(path, '(\.[^./]*)$', 1) AS ext, count(*) AS k FROM g JOIN n USING (project_id, id) WHERE node_type = 'file' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project_id, community ORDER BY k DESC, ext) = 1",
    "agg_17_edge_pairs": f"{_BASE} SELECT project_id, count(DISTINCT (source_id, target_id)) AS n FROM e GROUP BY project_id",
    "agg_18_health": f"""WITH b AS (SELECT project_id, id, {q.trim('unnest(string_split(where_path, $$,$$))')} AS path FROM memories WHERE deleted_at IS NULL AND where_path <> ''),
        sb AS (SELECT DISTINCT project_id, id FROM b WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.project_id = b.project_id AND n.path = b.path AND node_type IN ('file', 'document'))),
        c AS (SELECT p.id AS project_id, (SELECT count(*) FROM graph_nodes n WHERE n.project_id = p.id) AS nodes, (SELECT count(*) FROM graph_edges e WHERE e.project_id = p.id) AS edges, (SELECT count(*) FROM graph_edges e WHERE e.project_id = p.id AND source_id = target_id) AS self_loops,
          (SELECT count(*) FROM graph_edges e WHERE e.project_id = p.id AND (NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.project_id = e.project_id AND n.id = e.source_id) OR NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.project_id = e.project_id AND n.id = e.target_id))) AS dangling,
          (SELECT count(*) FROM graph_nodes n WHERE n.project_id = p.id AND NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.project_id = n.project_id AND e.source_id = n.id) AND NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.project_id = n.project_id AND e.target_id = n.id)) AS orphans,
          (SELECT count(*) FROM sb WHERE sb.project_id = p.id) AS stale_bindings FROM projects p)
        SELECT *, self_loops + dangling + stale_bindings = 0 AS healthy FROM c""",
    "srt_05_god_nodes": f"{_BASE} SELECT project_id, {_FIRSTN}, id, label, node_type, fan_in, fan_out, degree FROM n JOIN d USING (project_id, id) WHERE node_type <> 'package' QUALIFY rank <= 10",
    "srt_06_hotspots": f"{_BASE} SELECT project_id, {_FIRSTN}, id, label, node_type, fan_in, fan_out, degree FROM n JOIN d USING (project_id, id) WHERE node_type NOT IN ('document', 'package') QUALIFY rank <= 3",
    "join_03_neighbours": f"""{_BASE}, x AS (SELECT project_id, target_id AS id, 'dependent' AS side, source_id AS other_id, relation_type, confidence FROM e WHERE relation_type <> 'rationale_for' UNION ALL SELECT project_id, source_id, 'dependency', target_id, relation_type, confidence FROM e WHERE relation_type <> 'rationale_for')
        SELECT x.project_id, x.id, side, other_id, label, relation_type, confidence, CAST(row_number() OVER (PARTITION BY x.project_id, x.id, side ORDER BY other_id, relation_type) AS INT) AS rank FROM x JOIN n ON n.project_id = x.project_id AND n.id = x.other_id QUALIFY rank <= 5""",
    "join_09_dangling": f"{_BASE} SELECT project_id, source_id, target_id, relation_type FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.source_id) OR NOT EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.target_id)",
    "join_09_orphans": f"{_BASE} SELECT project_id, id FROM d WHERE degree = 0",
    "gra_01_bfs": f"{_BASE}, {_H}, {_S}, {_HUB}, {_ARCS}, {_WALK} SELECT * FROM r",
    "gra_01_bfs_out": f"""{_BASE}, {_S}, w(project_id, start_id, id, depth) AS (SELECT project_id, start_id, start_id, 0 FROM st UNION SELECT w.project_id, w.start_id, target_id, depth + 1 FROM w JOIN e ON e.project_id = w.project_id AND e.source_id = w.id AND relation_type = 'calls' WHERE depth < {DEPTH})
        SELECT project_id, start_id, id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY ALL""",
    "gra_01_edges": f"""{_BASE}, {_H}, {_S}, {_HUB}, {_ARCS}, {_WALK}, p AS (SELECT * FROM r WHERE depth < {DEPTH} AND (depth = 0 OR NOT EXISTS (SELECT 1 FROM hub WHERE hub.project_id = r.project_id AND hub.id = r.id)))
        SELECT DISTINCT e.project_id, start_id, source_id, target_id, relation_type, confidence FROM e JOIN p ON p.project_id = e.project_id AND (p.id = source_id OR p.id = target_id)""",
    "gra_02_paths": f"""{_BASE}, {_S}, w(project_id, start_id, id, depth) AS (SELECT project_id, start_id, start_id, 0 FROM st UNION SELECT w.project_id, w.start_id, target_id, depth + 1 FROM w JOIN e ON e.project_id = w.project_id AND e.source_id = w.id WHERE depth < 10),
        ds AS MATERIALIZED (SELECT project_id, start_id, id, min(depth) AS depth FROM w GROUP BY ALL),
        pa AS MATERIALIZED (SELECT x.project_id, x.start_id, x.id, x.depth, min(y.id) AS parent FROM ds x JOIN e ON e.project_id = x.project_id AND e.target_id = x.id JOIN ds y ON y.project_id = x.project_id AND y.start_id = x.start_id AND y.id = e.source_id AND y.depth = x.depth - 1 GROUP BY ALL),
        bk(project_id, start_id, end_id, hops, here, path) AS (SELECT ds.project_id, start_id, ds.id, depth, ds.id, ds.id FROM ds JOIN n ON n.project_id = ds.project_id AND n.id = ds.id AND node_type = 'file' UNION ALL
          SELECT bk.project_id, bk.start_id, end_id, hops, parent, parent || ' > ' || path FROM bk JOIN pa ON pa.project_id = bk.project_id AND pa.start_id = bk.start_id AND pa.id = bk.here)
        SELECT project_id, start_id, end_id, CAST(hops AS INT) AS hops, path FROM bk WHERE here = start_id""",
    "gra_03_blast": f"{_BASE}, {_S}, {', '.join(blast_ctes())} {_LEVELS}",
    "gra_04_propagation": f"{_BASE}, {_rounds_sql(False)} SELECT * FROM g",
    "gra_05_communities": f"{_BASE}, {_G} SELECT * FROM g",
    "gra_06_betweenness": f"{_BASE}, {_B} SELECT * FROM bc",
    "gra_05_modularity": f"""{_BASE}, {_G}, i AS (SELECT e.project_id, a.community AS a, b.community AS b FROM e JOIN g a ON a.project_id = e.project_id AND a.id = source_id JOIN g b ON b.project_id = e.project_id AND b.id = target_id),
        m AS (SELECT project_id, count(*) AS m, count(*) FILTER (a = b) AS inside FROM i GROUP BY ALL), t AS (SELECT project_id, c, count(*) AS k FROM (SELECT project_id, unnest([a, b]) AS c FROM i) GROUP BY ALL)
        SELECT m.project_id, round(any_value(inside / m) - sum((k / (2 * m)) * (k / (2 * m))), 6) AS modularity FROM m JOIN t USING (project_id) GROUP BY m.project_id""",
    "gra_08_surprising": f"""{_BASE}, {_G}, {_B}, l AS (SELECT project_id, source_id, target_id, min(relation_type) AS relation_type FROM e GROUP BY ALL),
        x AS (SELECT l.*, sg.community AS s_community, tg.community AS t_community, {_SCORE} AS score FROM l JOIN d sd ON sd.project_id = l.project_id AND sd.id = source_id JOIN d td ON td.project_id = l.project_id AND td.id = target_id
          JOIN bc sb ON sb.project_id = l.project_id AND sb.id = source_id JOIN bc tb ON tb.project_id = l.project_id AND tb.id = target_id
          JOIN g sg ON sg.project_id = l.project_id AND sg.id = source_id JOIN g tg ON tg.project_id = l.project_id AND tg.id = target_id WHERE sg.community <> tg.community)
        SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, source_id, target_id) AS INT) AS rank, source_id, target_id, relation_type, s_community, t_community, round(score, 6) AS score FROM x WHERE score > 0 QUALIFY rank <= 10""",
    "gra_09_roles": f"""{_BASE} SELECT project_id, id, fan_in, fan_out, CASE WHEN fan_in > 10 OR fan_out > 10 THEN 'god' WHEN fan_in = 0 AND fan_out > 0 THEN 'entry' WHEN fan_in > 0 AND fan_out = 0 THEN 'leaf' WHEN fan_in > 0 THEN 'intermediate' ELSE 'isolated' END AS role,
        CASE WHEN fan_in > 10 OR fan_out > 10 THEN 'HIGH' WHEN fan_in > 5 OR fan_out > 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d""",
    "win_08_cross_edges": f"""{_BASE}, {_G} SELECT e.project_id, a.community, CAST(row_number() OVER (PARTITION BY e.project_id, a.community ORDER BY label, source_id, target_id, relation_type) AS INT) AS rank, source_id, target_id, relation_type, b.community AS to_community
        FROM e JOIN g a ON a.project_id = e.project_id AND a.id = source_id JOIN g b ON b.project_id = e.project_id AND b.id = target_id JOIN n ON n.project_id = e.project_id AND n.id = source_id WHERE a.community <> b.community QUALIFY rank <= 20""",
    "set_04_merge_nodes": f"""{_BASE}, f AS (SELECT id, arg_min({{'t': node_type, 'l': label, 'p': path}}, project_id) AS r FROM n GROUP BY id),
        kv AS (SELECT id, project_id, unnest(json_keys(metadata)) AS k, metadata FROM n WHERE json_valid(metadata) AND json_type(metadata) = 'OBJECT'),
        v AS (SELECT id, k, arg_max({{'v': json_extract_string(metadata, '$."' || k || '"')}}, project_id).v AS v FROM kv GROUP BY id, k),
        m AS (SELECT id, string_agg(to_json(k) || ':' || coalesce(to_json(v)::VARCHAR, 'null'), ',' ORDER BY k) AS m FROM v GROUP BY id)
        SELECT f.id, r.t AS node_type, r.l AS label, r.p AS path, '{{' || coalesce(m, '') || '}}' AS metadata FROM f LEFT JOIN m ON m.id = f.id""",
    "set_04_merge_edges": f"{_BASE}, h AS (SELECT project_id, ntile(2) OVER (ORDER BY project_id) AS half FROM (SELECT DISTINCT project_id FROM e)) SELECT source_id, target_id, relation_type, arg_min(id, (half, id)) AS id FROM e JOIN h ON h.project_id = e.project_id GROUP BY ALL",
    "snk_08_links": f"{_BASE} SELECT project_id, source_id, target_id, min(relation_type) AS relation_type FROM e GROUP BY ALL",
}
