"""Code graph joins, Markdown structure, context, exports and specification deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowloom.functions import text
from knowloom.operators import code as C
from knowloom.operators import context as X
from knowloom.operators import graph as G
from knowloom.operators import specs
from knowloom.plans import graph as P
from knowloom.plans import sqltext as q
from knowloom.runtime import cut
from knowloom.sinks import exports
from knowloom.sources.extract import extract
from knowloom.tables import MEMORIES, table


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Call sites, as the edges note them: file, line and the called name."""
    e = table(s, d, "graph_edges").where("relation_type = 'calls' AND source_location IS NOT NULL AND source_id LIKE '%:%' AND target_id LIKE '%:%'")
    return e.select("project_id", F.substring_index("source_id", ":", 1).alias("path"), F.regexp_extract("source_location", r"L(\d+)", 1).cast("bigint").alias("line"), F.substring_index("target_id", ":", -1).alias("callee")).distinct()


def _syms(s: SparkSession, d: str) -> DataFrame:
    return C.symbols(P._nodes(s, d))


def callers(s: SparkSession, d: str) -> DataFrame:
    return C.containing_symbol(_calls(s, d), _syms(s, d))


def _imports(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "graph_edges").where("relation_type IN ('imports', 'depends_on') AND source_id IS NOT NULL AND target_id IS NOT NULL AND source_id NOT LIKE '%:%'")
    by_id = e.select("project_id", F.col("source_id").alias("source_path"), F.col("target_id").alias("imported"))
    near = e.select("project_id", F.col("source_id").alias("source_path"), F.concat(F.lit("./"), F.regexp_replace(F.substring_index("target_id", "/", -1), r"\.[^.]*$", "")).alias("imported"))
    return by_id.unionByName(near).distinct()


def imports(s: SparkSession, d: str) -> DataFrame:
    return C.resolve_imports(_imports(s, d), P._nodes(s, d))


def snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as files: sizes as noted, and as they are; each lacks one kind."""
    docs = table(s, d, "documents").select(F.coalesce("source", F.lit("?")).alias("project_id"), F.col("doc_id").cast("string").alias("path"), "kind", "n_chars", F.length("text").alias("size"), F.unix_millis("created_at").alias("mtime_ms"))
    side = lambda size, kind: docs.where(F.col("kind") != kind).select("project_id", "path", "mtime_ms", F.col(size).cast("bigint").alias("size"))
    return side("n_chars", "postmortem"), side("size", "journal")


def diff(s: SparkSession, d: str) -> DataFrame:
    return C.snapshot_diff(*snapshots(s, d))


def rebuilds(s: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(s, d)
    return C.rebuilds(C.snapshot_diff(old, new), old)


def markdown(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("project_id"), F.lit("a.md").alias("path"), F.col("text").alias("content"))
    found = extract(docs).where("kind = 'symbol' AND type = 'section'")
    return found.select(F.col("project_id").cast("bigint").alias("doc_id"), F.col("name").alias("title"), "line", F.col("meta").cast("int").alias("level"))


def links(s: SparkSession, d: str) -> DataFrame:
    """The links of a page for each edge between files: its ends as Markdown and as wiki links, among brackets that are none."""
    e = table(s, d, "graph_edges").where("source_id IS NOT NULL AND target_id IS NOT NULL AND NOT contains(source_id || target_id, ':') AND trim(source_id) <> '' AND trim(target_id) <> ''").select("id", "source_id", "target_id").distinct()
    page = F.concat(F.lit("# Edge\n[no] (x) [a]( [from]("), "source_id", F.lit(") to [["), "target_id", F.lit("|that]] [x]\n```mermaid\n[no](no)\n```\n[again]("), "target_id", F.lit(")"))
    pages = e.select(F.concat_ws(">", "source_id", "target_id", "id").alias("project_id"), F.lit("a.md").alias("path"), page.alias("content")).distinct()
    return extract(pages).where("kind = 'import'").select(F.col("project_id").alias("edge"), "name", "line")


def spec_steps(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, deltas) as all memories with a change state them; what happens to a requirement follows from the length of its name.

    A name of length 5n stays as it is, 5n + 1 is modified, 5n + 2 removed, 5n + 3 renamed, 5n + 4 added.
    """
    name = text.redact(text.trim_space(F.coalesce("what", F.lit(""))))
    rows = memories.where("change_id <> ''").select("project_id", F.coalesce("topic_key", F.lit("general")).alias("capability_path"), name.alias("requirement"), text.redact(F.coalesce("why", F.lit(""))).alias("body"))
    rows = rows.where("requirement <> ''").groupBy("project_id", "capability_path", "requirement").agg(F.min("body").alias("body")).withColumn("k", F.length("requirement") % 5)
    none = F.lit(None).cast(f"array<{specs.SCENARIO}>")
    op = F.when(F.col("k") == 1, "MODIFIED").when(F.col("k") == 2, "REMOVED").when(F.col("k") == 3, "RENAMED").otherwise("ADDED")
    deltas = rows.where("k > 0").select("project_id", "capability_path", "requirement", op.alias("op"), F.when(F.col("k") == 3, F.concat("requirement", F.lit(" v2"))).alias("rename_to"), F.when(F.col("k") == 1, F.concat(F.lit("Changed. "), "body")).otherwise(F.col("body")).alias("body"), none.alias("scenarios"), F.lit(0).alias("sort_order"))
    return rows.where("k < 4").drop("k").withColumn("scenarios", none), deltas


def merged_steps(s: SparkSession, d: str) -> DataFrame:
    state, _ = specs.merge_deltas(*(cut(x, "specs") for x in spec_steps(table(s, d, "memories"))))
    return state.select("project_id", "capability_path", "requirement", "body", F.array_join("rfc2119", ",").alias("words"))


def spec_history(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, deltas) as all memories with a change state them: the first change of a capability is its current state, what comes later changes it.

    A later row of a known name is MODIFIED, one of a new name ADDED, or RENAMED if it has the body of a current requirement (one each); a name whose newest row is deleted is REMOVED.
    """
    cap, row, order = ["project_id", "capability_path"], ["project_id", "capability_path", "requirement"], F.struct("created_at", "id")
    name = text.redact(text.trim_space(F.coalesce("what", F.lit(""))))
    rows = memories.where("change_id <> ''").select("project_id", F.coalesce("topic_key", F.lit("general")).alias("capability_path"), name.alias("requirement"), F.coalesce("why", F.lit("")).alias("body"), "change_id", F.col("deleted_at").isNotNull().alias("gone"), "created_at", "id")
    rows = rows.join(rows.groupBy(*cap).agg(F.min_by("change_id", order).alias("first")), cap)
    rows = rows.withColumn("sort_order", F.row_number().over(Window.partitionBy(*cap).orderBy("created_at", "id"))).withColumn("old", F.col("change_id") == F.col("first"))
    current = rows.where("old").groupBy(*row).agg(F.min_by("body", "sort_order").alias("body"), F.min("sort_order").alias("at"))
    later = rows.join(current.select(*row, "at"), row, "left").where("at IS NULL OR sort_order > at")
    new = later.where("at IS NULL").groupBy(*row).agg(F.min_by("body", "sort_order").alias("body"), F.min("sort_order").alias("sort_order"))
    pairs = current.where("trim(body) <> ''").select(*row, "body").join(new.select(*cap, F.col("requirement").alias("rename_to"), "body", "sort_order").where("rename_to <> ''"), [*cap, "body"])
    one = pairs.groupBy(*cap, "body").agg(F.min("requirement").alias("requirement"), F.min_by("rename_to", "sort_order").alias("rename_to"), F.min("sort_order").alias("sort_order"))
    renamed = one.where("requirement <> ''").select(*row, F.lit("RENAMED").alias("op"), "rename_to", F.lit("").alias("body"), "sort_order")
    taken = renamed.select(*cap, F.col("rename_to").alias("requirement"), F.col("sort_order"))
    first = new.select(*row, "sort_order").withColumn("is_first", F.lit(True))
    op = F.when(F.col("is_first"), "ADDED").otherwise("MODIFIED")
    said = later.join(taken, [*row, "sort_order"], "left_anti").join(first, [*row, "sort_order"], "left").select(*row, op.alias("op"), F.lit(None).cast("string").alias("rename_to"), "body", "sort_order")
    gone = rows.groupBy(*row).agg(F.max_by("gone", "sort_order").alias("gone"), F.max("sort_order").alias("sort_order")).where("gone")
    removed = gone.select(*row, F.lit("REMOVED").alias("op"), F.lit(None).cast("string").alias("rename_to"), F.lit("").alias("body"), "sort_order")
    none = F.lit(None).cast(f"array<{specs.SCENARIO}>")
    return current.drop("at").withColumn("scenarios", none), renamed.unionByName(said).unionByName(removed).withColumn("scenarios", none)


def merged(s: SparkSession, d: str) -> DataFrame:
    state, _ = specs.merge_deltas(*(cut(x, "specs") for x in spec_history(table(s, d, "memories"))))
    return state.select("project_id", "capability_path", "requirement", "body", F.array_join("rfc2119", ",").alias("words"))


def wiki(s: SparkSession, d: str) -> DataFrame:
    nodes, links = P._nodes(s, d), P._links(s, d)
    return exports.wiki_pages(nodes, links, *P._insight(nodes, links))


QUERIES = {
    "join_14_imports": imports,
    "join_16_callers": callers,
    "join_17_calls": lambda s, d: C.call_edges(_calls(s, d), _syms(s, d)),
    "join_19_contained": lambda s, d: C.contained(P._nodes(s, d)),
    "join_20_snapshot_diff": diff,
    "join_20_rebuilds": rebuilds,
    "win_06_spans": lambda s, d: C.symbol_spans(_syms(s, d)).select("project_id", "id", "line", "last"),
    "src_08_headings": markdown,
    "src_05_links": links,
    "sea_09_graph_boost": lambda s, d: X.graph_boosted(table(s, d, "memories"), P._nodes(s, d), "gate"),
    "dml_18_merge_deltas": merged_steps,
    "dml_18_merge_history": merged,
    "snk_01_json": lambda s, d: exports.memory_json(table(s, d, "memories")),
    "snk_05_cypher": lambda s, d: exports.cypher(P._nodes(s, d), P._edges(s, d)),
    "snk_06_view": lambda s, d: exports.view_nodes(P._nodes(s, d), P._deg(s, d), P._given(s, d)).withColumn("size", F.round("size", 6)),
    "snk_07_wiki": wiki,
    "snk_03_notes": lambda s, d: exports.file_notes(P._nodes(s, d), P._edges(s, d)),
    "snk_15_budget": lambda s, d: table(s, d, "documents").select("doc_id", exports.within_budget(F.col("text"), 200).alias("cut")),
}


_SYM = f"""sy AS (SELECT project_id, path, id, label, coalesce(CASE WHEN json_valid(metadata) THEN CAST(floor(TRY_CAST(json_extract_string(metadata, '$.line') AS DOUBLE)) AS BIGINT) END, 0) AS line, {q.language_group('path')} AS grp FROM n WHERE node_type IN ('function', 'class'))"""
_CALL = r"""ca AS (SELECT DISTINCT project_id, string_split(source_id, ':')[1] AS path, CAST(regexp_extract(source_location, 'L(\d+)', 1) AS BIGINT) AS line, string_split(target_id, ':')[-1] AS callee FROM graph_edges WHERE relation_type = 'calls' AND source_location IS NOT NULL AND source_id LIKE '%:%' AND target_id LIKE '%:%')"""
_CALLER = "cl AS (SELECT ca.*, (SELECT arg_max(id, (sy.line, id)) FROM sy WHERE sy.project_id = ca.project_id AND sy.path = ca.path AND sy.line <= ca.line) AS caller_id FROM ca)"
_SUFFIX = ", ".join(q.quote(x) for x in C.SUFFIXES)
_SNAP = "docs AS (SELECT coalesce(source, '?') AS project_id, CAST(doc_id AS VARCHAR) AS path, kind, n_chars, length(text) AS size, epoch_ms(created_at) AS t FROM documents), o AS (SELECT project_id, path, t, CAST(n_chars AS BIGINT) AS z FROM docs WHERE kind <> 'postmortem'), w AS (SELECT project_id, path, t, CAST(size AS BIGINT) AS z FROM docs WHERE kind <> 'journal'), df AS (SELECT coalesce(o.project_id, w.project_id) AS project_id, coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'deleted' WHEN o.t IS DISTINCT FROM w.t OR o.z IS DISTINCT FROM w.z THEN 'changed' END AS status FROM o FULL JOIN w ON o.project_id = w.project_id AND o.path = w.path)"
_ESC = {"\\": "\\\\", '"': '\\"', "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}


def _cy(c: str) -> str:
    c = f"coalesce({c}, '')"
    for a, b in _ESC.items():
        c = f"replace({c}, {f'chr({ord(a)})' if ord(a) < 32 else q.quote(a)}, {q.quote(b)})"
    return f"'\"' || {c} || '\"'"


_TIMES = ("created_at", "last_seen_at", "review_after")
_PLAIN = ("duplicate_count", "pinned", "revision_count")


def _field(c: str) -> str:
    if c in _TIMES:
        value = f"'\"' || strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us({c}) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z\"'"
    else:
        value = f"CAST({c} AS VARCHAR)" if c in _PLAIN else f"to_json({c})::VARCHAR"
    return f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || {value} END"


_JSON = "'{' || array_to_string(list_filter([" + ", ".join(_field(c) for c in sorted(MEMORIES.names) if c != "deleted_at") + "], lambda x: x IS NOT NULL), ',') || '}'"
_FILE = "translate({}, '/\\:*?\"<>|', '_________')"


def _bullet_list(keys: str, line: str, rows: str) -> str:
    return f"SELECT project_id, {keys} AS id, array_to_string(list_sort(list(DISTINCT '- ' || {line})), chr(10)) AS t FROM {rows} GROUP BY ALL"


SQL = {
    "snk_01_json": f"SELECT id || '.json' AS path, {_JSON} AS content FROM memories WHERE deleted_at IS NULL",
    "snk_03_notes": f"""{P._BASE}, sy AS ({_bullet_list("path", "label", "n WHERE node_type IN ('function', 'class', 'type', 'section', 'table') AND label IS NOT NULL")}),
        us AS ({_bullet_list("source_id", "relation_type || ' [[' || " + _FILE.format("target_id") + " || ']]'", "e")}), ub AS ({_bullet_list("target_id", "relation_type || ' [[' || " + _FILE.format("source_id") + " || ']]'", "e")})
        SELECT n.project_id, CASE WHEN node_type = 'package' THEN 'packages/' ELSE 'files/' END || {_FILE.format("n.id")} || '.md' AS path, '# ' || label || coalesce(chr(10) || chr(10) || '## Symbols' || chr(10) || chr(10) || sy.t, '') || coalesce(chr(10) || chr(10) || '## Depends on' || chr(10) || chr(10) || us.t, '')
          || coalesce(chr(10) || chr(10) || '## Used by' || chr(10) || chr(10) || ub.t, '') || chr(10) AS content
        FROM n LEFT JOIN sy ON sy.project_id = n.project_id AND sy.id = n.id LEFT JOIN us ON us.project_id = n.project_id AND us.id = n.id LEFT JOIN ub ON ub.project_id = n.project_id AND ub.id = n.id WHERE node_type IN ('file', 'document', 'package')""",
    "join_16_callers": f"{P._BASE}, {_SYM}, {_CALL}, {_CALLER} SELECT project_id, path, line, callee, caller_id FROM cl",
    "join_17_calls": f"""{P._BASE}, {_SYM}, {_CALL}, {_CALLER},
        r AS (SELECT cl.project_id, caller_id, line, coalesce((SELECT min(id) FROM sy WHERE sy.project_id = cl.project_id AND sy.path = cl.path AND sy.label = callee),
            (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM sy WHERE sy.project_id = cl.project_id AND sy.label = callee AND sy.id <> caller_id AND sy.grp <> '' AND sy.grp = {q.language_group('cl.path')})) AS target_id FROM cl WHERE caller_id IS NOT NULL)
        SELECT project_id, caller_id AS source_id, target_id, 'L' || min(line) AS source_location FROM r WHERE target_id IS NOT NULL GROUP BY ALL""",
    "join_19_contained": f"{P._BASE} SELECT p.project_id, p.id AS source_id, c.id AS target_id FROM n p JOIN n c ON c.project_id = p.project_id AND c.path = p.id AND starts_with(c.id, p.id || ':') WHERE p.node_type IN ('document', 'sql')",
    "join_20_snapshot_diff": f"WITH {_SNAP} SELECT * FROM df WHERE status IS NOT NULL",
    "join_20_rebuilds": f"WITH {_SNAP}, t AS (SELECT project_id, count(*) AS n FROM o GROUP BY 1), c AS (SELECT project_id, count(*) AS k FROM df WHERE status IS NOT NULL GROUP BY 1) SELECT project_id, coalesce(coalesce(k, 0) / n > 0.3, true) AS needs_full FROM t FULL JOIN c USING (project_id)",
    "join_14_imports": rf"""{P._BASE}, r0 AS (SELECT project_id, source_id AS s, target_id AS t FROM graph_edges WHERE relation_type IN ('imports', 'depends_on') AND source_id IS NOT NULL AND target_id IS NOT NULL AND source_id NOT LIKE '%:%'),
        im AS (SELECT project_id, s, t AS i FROM r0 UNION SELECT project_id, s, './' || regexp_replace(string_split(t, '/')[-1], '\.[^.]*$', '') FROM r0),
        ca AS (SELECT *, unnest(CASE WHEN starts_with(i, './') THEN list_transform([{_SUFFIX}], lambda x: (CASE WHEN contains(s, '/') THEN regexp_replace(s, '/[^/]*$', '') || '/' ELSE '' END) || substring(i, 3) || x) ELSE [] END || [i]) AS id, unnest(range(CASE WHEN starts_with(i, './') THEN {len(C.SUFFIXES) + 1} ELSE 1 END)) AS pos FROM im),
        b AS (SELECT ca.project_id, s, i, arg_min(ca.id, pos) AS target FROM ca JOIN n ON n.project_id = ca.project_id AND n.id = ca.id GROUP BY ALL)
        SELECT * FROM (SELECT im.project_id, im.s AS source_path, im.i AS imported, CASE WHEN target IS NOT NULL THEN 'file' WHEN NOT regexp_matches(im.i, '^[./]') AND NOT regexp_matches(im.i, '[ \t\n\r]') AND trim(im.i) <> '' THEN 'package' END AS kind,
          CASE WHEN target IS NOT NULL THEN target WHEN NOT regexp_matches(im.i, '^[./]') THEN 'pkg:' || im.i END AS target_id FROM im LEFT JOIN b ON b.project_id = im.project_id AND b.s = im.s AND b.i = im.i) WHERE kind IS NOT NULL""",
    "win_06_spans": f"{P._BASE}, {_SYM} SELECT project_id, id, line, lead(line) OVER (PARTITION BY project_id, path ORDER BY line, id) - 1 AS last FROM sy",
    "src_05_links": """WITH e AS (SELECT DISTINCT source_id || '>' || target_id || '>' || id AS edge, source_id AS s, target_id AS t FROM graph_edges WHERE id IS NOT NULL AND NOT contains(source_id || target_id, ':') AND trim(source_id) <> '' AND trim(target_id) <> '')
        SELECT edge, s AS name, 2 AS line FROM e UNION ALL SELECT edge, t, 2 FROM e UNION ALL SELECT edge, t, 6 FROM e""",
    "src_08_headings": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
        f AS (SELECT *, starts_with({q.trim('s')}, '```') AS is_fence, sum(CAST(starts_with({q.trim('s')}, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM l),
        m AS (SELECT *, max(CASE WHEN is_fence THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS open_line FROM f),
        o AS (SELECT doc_id, line AS open_line, lower({q.trim("substring(" + q.trim('s') + ", 4)")}) AS lang FROM l)
        SELECT m.doc_id, {q.trim("regexp_extract(s, '^(#{1,6})[[:space:]]+(.+)$', 2)")} AS title, CAST(line AS INT) AS line, length(regexp_extract(s, '^(#{{1,6}})[[:space:]]+(.+)$', 1))::INT AS level
        FROM m LEFT JOIN o ON o.doc_id = m.doc_id AND o.open_line = m.open_line WHERE NOT is_fence AND regexp_matches(s, '^#{{1,6}}[[:space:]]+.+$') AND title <> '' AND NOT (k % 2 = 1 AND coalesce(lang, '') = 'mermaid')""",
    "dml_18_merge_deltas": f"""WITH r AS (SELECT project_id, coalesce(topic_key, 'general') AS capability_path, {q.redact(q.trim("coalesce(what, '')"))} AS requirement, {q.redact("coalesce(why, '')")} AS body FROM memories WHERE change_id <> ''),
        u AS (SELECT project_id, capability_path, requirement, min(body) AS body, length(requirement) % 5 AS k FROM r WHERE requirement <> '' GROUP BY ALL),
        x AS (SELECT project_id, capability_path, CASE WHEN k = 3 THEN requirement || ' v2' ELSE requirement END AS requirement, CASE WHEN k = 1 THEN 'Changed. ' || body ELSE body END AS body FROM u WHERE k <> 2)
        SELECT *, array_to_string({q.rfc2119('body')}, ',') AS words FROM x""",
    "snk_05_cypher": f"""{P._BASE} SELECT 0 AS kind, 'MERGE (n:' || upper(translate(node_type, '- /.', '____')) || ' {{id: ' || {_cy('id')} || '}}) SET n.label = ' || {_cy('label')} || ', n.path = ' || {_cy('path')} || ';' AS line FROM n
        UNION ALL SELECT 1, 'MATCH (a {{id: ' || {_cy('source_id')} || '}}), (b {{id: ' || {_cy('target_id')} || '}}) MERGE (a)-[:' || upper(translate(relation_type, '- /.', '____')) || ']->(b);' FROM e""",
    "snk_15_budget": "SELECT doc_id, CASE WHEN length(text) > 800 THEN (CASE WHEN contains(substring(text, 1, 800), chr(10)) THEN regexp_replace(substring(text, 1, 800), '\\n[^\\n]*$', '') ELSE substring(text, 1, 800) END) || chr(10) || '... [truncated to fit the token budget]' ELSE text END AS cut FROM documents",
    "snk_06_view": f"{P._BASE}, {P._G}, x AS (SELECT project_id, max(degree) AS most FROM d GROUP BY 1) SELECT d.project_id, d.id, label, round(least(60.0, greatest(10.0, 10 + 30 * degree / greatest(most, 1)::DOUBLE)), 6)::DOUBLE AS size, community FROM d JOIN n USING (project_id, id) JOIN g USING (project_id, id) JOIN x ON x.project_id = d.project_id",
    "sea_09_graph_boost": f"""{P._BASE}, t0 AS (SELECT *, CASE WHEN id = 'gate' THEN 0 WHEN path = 'gate' THEN 1 WHEN label = 'gate' THEN 2 WHEN contains(lower(path), 'gate') THEN 3 WHEN contains(lower(label), 'gate') THEN 4 END AS r FROM n),
        s0 AS (SELECT project_id, path AS p, regexp_extract(path, '^(.*)/[^/]*$', 1) AS f FROM t0 WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY r, id) = 1),
        cp AS (SELECT DISTINCT n.project_id, n.path FROM n JOIN s0 ON s0.project_id = n.project_id WHERE node_type <> 'document' AND path <> '' AND ((f <> '' AND starts_with(path, f || '/')) OR path = p))
        SELECT project_id, id, where_path, NOT contains(lower(where_path), 'gate') AS boosted FROM memories m WHERE deleted_at IS NULL AND where_path IS NOT NULL AND (contains(lower(where_path), 'gate') OR EXISTS (SELECT 1 FROM cp WHERE cp.project_id = m.project_id AND cp.path = m.where_path))""",
}
