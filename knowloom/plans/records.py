"""Saves, sessions, prompts, changes and links applied to the tables, and sources read from files that are written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.operators import build as B
from knowloom.operators import changes as H
from knowloom.operators import code as C
from knowloom.operators import context as X
from knowloom.operators import graph as G
from knowloom.operators import lifecycle as L
from knowloom.operators import links, sessions, specs
from knowloom.operators import memory as M
from knowloom.plans import graph as P
from knowloom.plans import sqltext as q
from knowloom.plans.code import _FILE, _JSON, _SNAP, _bullet_list, snapshots
from knowloom.plans.functions import NOW
from knowloom.plans.lifecycle import _late
from knowloom.plans.memory import WEEK_AGO, placed
from knowloom.plans.more import _CH, _PROGRESS, _RQ, _changes, _requirements
from knowloom.runtime import cut, shared_path
from knowloom.sinks import exports
from knowloom.sources import memories as IN
from knowloom.sources.extract import dependencies, extract
from knowloom.sources.files import file_nodes
from knowloom.tables import CHANGES, MEMORIES, conform, table


def _mem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories")


# -- saves, sessions, prompts, changes ------------------------------------------


def saved(s: SparkSession, d: str) -> DataFrame:
    """The store after the saves of the last 60 days."""
    incoming, current = _late(s, d)
    rows = L.save(incoming.withColumn("created_at", F.col("created_at")), current, WEEK_AGO)[0]
    return rows.select("project_id", "id", "topic_key", "what", "revision_count", "duplicate_count", "created_at")


def started(s: SparkSession, d: str) -> DataFrame:
    """A session for each prompt without one."""
    asks = table(s, d, "user_prompts").where("session_id IS NULL").select("project_id", F.col("content").alias("goal"), F.lit(".").alias("directory"), F.concat(F.lit("s-"), "id").alias("id"))
    return sessions.start_sessions(table(s, d, "sessions"), asks, NOW).select("project_id", "id", "goal", "status", "started_at")


def ended(s: SparkSession, d: str) -> DataFrame:
    """Every session asked to end with its own goal as the summary; only active ones do."""
    t = table(s, d, "sessions")
    return sessions.end_sessions(t, t.select("project_id", "id", F.col("goal").alias("summary")), NOW).select("project_id", "id", "status", "summary", "ended_at")


def summarised(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "sessions")
    none = F.lit(None).cast("string")
    reports = t.where("goal IS NOT NULL").select("project_id", "id", "goal", F.col("directory").alias("discoveries"), F.col("status").alias("accomplished"), none.alias("next_steps"), F.col("id").alias("files"))
    return sessions.summarise_sessions(t, reports).select("project_id", "id", "goal", "summary")


def captured(s: SparkSession, d: str) -> DataFrame:
    """All prompts captured again under new ids."""
    t = table(s, d, "user_prompts")
    return sessions.capture_prompts(t, t.select("project_id", "session_id", "content", F.concat(F.lit("n-"), "id").alias("id")), NOW).select("project_id", "id", "session_id", "content", "created_at")


def passive(s: SparkSession, d: str) -> DataFrame:
    """All prompts noted as journal entries in an empty store."""
    notes = table(s, d, "user_prompts").select("project_id", F.col("content").alias("what"), F.lit("noted").alias("why"), "session_id", "id")
    return sessions.capture_passive(conform(_mem(s, d), MEMORIES).limit(0), notes, NOW)[0].select("project_id", "id", "category", "learned", "duplicate_count")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """A change for each session that has a goal, its slug from the goal's first words; the same words twice in a project collide."""
    t = table(s, d, "sessions").where("goal IS NOT NULL")
    slug = F.regexp_replace(F.lower(F.substring("goal", 1, 12)), "[^a-z0-9]+", "-")
    return conform(t.select("id", "project_id", slug.alias("slug"), F.col("goal").alias("title"), F.col("summary").alias("what")), CHANGES)


def created(s: SparkSession, d: str) -> DataFrame:
    none = conform(_changes(s, d), CHANGES).limit(0)
    made, refused = H.create_changes(none, _requests(s, d), NOW)
    out = made.select("project_id", "slug", F.lit("made").alias("outcome")).unionByName(refused.select("project_id", "slug", F.col("problem").alias("outcome")))
    return out.groupBy("project_id", "slug", "outcome").agg(F.count(F.lit(1)).alias("n"))


def edited(s: SparkSession, d: str) -> DataFrame:
    """All changes with a new goal from their title, the capability of every other one set, and moved on by their state."""
    c = conform(_changes(s, d), CHANGES)
    rows = H.update_changes(c, c.select("project_id", "id", F.concat(F.lit("Goal: "), "title").alias("goal")), NOW)
    rows = H.set_capability(rows, c.where(F.length("title") % 2 == 0).select("project_id", "id", F.when(F.length("title") % 4 == 0, "core").alias("capability_path")), NOW)
    to = F.when(F.col("status") == "draft", "proposed").when(F.col("status") == "validated", "applied").otherwise("nonsense")
    return H.move_changes(rows, c.select("project_id", "id", to.alias("to_status")), NOW).select("project_id", "id", "goal", "capability_path", "status", "archived_at")


def linked(s: SparkSession, d: str) -> DataFrame:
    """Memories linked to a change of their topic's name."""
    asks = _mem(s, d).where("topic_key <> ''").select("project_id", F.col("id").alias("memory_id"), F.concat(F.lit("c/"), "topic_key").alias("change_id"))
    return H.link_memories(_mem(s, d), asks).select("project_id", "id", "change_id")


def _deltas(s: SparkSession, d: str) -> DataFrame:
    """What each change adds: the requirements of its memories, one of each name in a capability."""
    rows = _requirements(s, d).where("requirement <> ''").groupBy("project_id", "change_id", "requirement").agg(F.min("body").alias("body"))
    none = F.lit(None).cast(f"array<{specs.SCENARIO}>")
    return rows.select("project_id", "change_id", F.lit("ADDED").alias("op"), "requirement", F.lit(None).cast("string").alias("rename_to"), "body", none.alias("scenarios"), F.lit(0).alias("sort_order"))


def committed(s: SparkSession, d: str) -> DataFrame:
    """All changes with a status of their own capability committed to an empty specification: what became of them, and of a decision for no change."""
    c = conform(_changes(s, d), CHANGES).withColumn("capability_path", F.col("id"))
    rows = c.select("project_id", F.concat(F.lit("d-"), "id").alias("id"), F.lit("decision").alias("category"), F.col("title").alias("what"), F.concat(F.lit("decision/"), "id").alias("topic_key"), F.col("id").alias("change_id"))
    rows = rows.unionByName(rows.where(F.length("change_id") % 2 == 0).withColumns({"change_id": F.concat(F.lit("no-"), "change_id"), "topic_key": F.concat(F.lit("no/"), "topic_key"), "id": F.concat(F.lit("n"), "id")}))
    none = s.createDataFrame([], f"project_id string, capability_path string, requirement string, body string, scenarios array<{specs.SCENARIO}>")
    tables = {"memories": conform(_mem(s, d), MEMORIES).limit(0), "changes": c, "deltas": cut(_deltas(s, d), "deltas"), "capabilities": none}
    new, problems = H.commit_changes(tables, conform(rows, MEMORIES), NOW)
    count = lambda df, kind, by: df.groupBy("project_id", by.alias("what")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    out = count(new["memories"], "memory", F.col("change_id")).unionByName(count(new["changes"], "change", F.col("status"))).unionByName(count(new["capabilities"], "capability", F.col("capability_path")))
    return out.unionByName(count(problems, "problem", F.col("change_id")))


def rationale(s: SparkSession, d: str) -> DataFrame:
    """The graph's links to memories and capabilities as a rebuild makes them."""
    edges = links.relinked(P._nodes(s, d), P._edges(s, d), placed(s, d), _changes(s, d))[1]
    return edges.where("relation_type IN ('rationale_for', 'implements')").select("project_id", "id", "source_id", "target_id", "relation_type")


def context(s: SparkSession, d: str) -> DataFrame:
    """The context of a path in the linked graph of every project."""
    m = placed(s, d)
    nodes, edges = (cut(x, "graph") for x in links.relinked(P._nodes(s, d), P._edges(s, d), m, _changes(s, d)))
    return X.context_pack(nodes, edges, m, "gate", changes=_changes(s, d), capabilities=_requirements(s, d))


# -- sources ----------------------------------------------------------------------


def _js(s: SparkSession, d: str) -> DataFrame:
    """A script for each file node: it imports the folder's index and a package, exports a function and calls another."""
    n = P._nodes(s, d).where("id = path")
    name = F.concat(F.lit("f"), F.length("path").cast("string"))
    body = F.concat(F.lit("// import './no'\nimport { a as b } from './"), F.col("label"), F.lit("';\nconst q = require(\"pkg-"), F.length("label").cast("string"), F.lit("\");\n/* function hidden() {} */\nexport async function "), name, F.lit("(x) {\n  helper(x, \"call(y)\");\n}\nclass K"), F.length("path").cast("string"), F.lit(" {}\nexport const v = 1;\n"))
    return n.select("project_id", F.concat("path", F.lit(".js")).alias("path"), body.alias("content"))


def _ddl(s: SparkSession, d: str) -> DataFrame:
    """A schema for each project: a table for each package, columns by the length of its name, and an index and a key on some."""
    n = P._nodes(s, d).where("node_type IN ('package', 'file')")
    t = F.concat(F.lit("t_"), F.regexp_replace("label", "[^A-Za-z0-9]", "_"))
    size = F.length("label").cast("string")
    text = F.concat(F.lit("-- CREATE TABLE no (a INT);\nCREATE TABLE IF NOT EXISTS public."), t, F.lit(" (\n  id SERIAL PRIMARY KEY,\n  v DECIMAL("), size, F.lit(", 2) NOT NULL DEFAULT 0,\n  CONSTRAINT c CHECK (v > 0)\n);\n"), F.when(F.length("label") % 2 == 0, F.concat(F.lit("CREATE UNIQUE INDEX ix_"), t, F.lit(" ON "), t, F.lit(" (v);\nALTER TABLE "), t, F.lit(" ADD FOREIGN KEY (id) REFERENCES base(id);\n"))).otherwise(""))
    return n.select("project_id", F.concat("path", F.lit(".sql")).alias("path"), t.alias("t"), text.alias("content"))


def _manifests(s: SparkSession, d: str) -> DataFrame:
    """A package.json for each project with all its packages: the dependencies are the pairs of each, its own folder."""
    n = P._nodes(s, d).where("node_type = 'package'")
    return n.select("project_id", F.concat("id", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "x", "dependencies": {'), F.to_json(F.struct(F.col("label").alias("k"))).substr(F.lit(6), F.lit(9999)).substr(F.lit(1), F.length(F.to_json(F.struct(F.col("label").alias("k")))) - 6), F.lit(': "1"}, "scripts": {"no": "1"}}')).alias("content"))


def _json_round(s: SparkSession, d: str) -> DataFrame:
    """All active memories written as one JSON file each, and read back."""
    root = shared_path(s, "chunks")
    exports.memory_json(_mem(s, d)).select(F.col("content").alias("value")).repartition(8).write.text(root)
    back = s.read.schema(MEMORIES).json(root)
    return back.select("project_id", "id", "what", "learned", "revision_count", "created_at", "pinned")


def _chunk_round(s: SparkSession, d: str) -> DataFrame:
    """The same through the lenient reader, one file a memory of the projects' pinned ones, some of them broken."""
    from knowloom.sinks.store import write_files

    root = shared_path(s, "chunks").removeprefix("file://")
    pages = exports.memory_json(_mem(s, d).where("pinned"))
    write_files(pages.withColumn("content", F.when(F.length("content") % 5 == 0, F.lit("{broken")).otherwise(F.col("content"))), root)
    good, broken = IN.read_chunks(s, root)
    return good.select("id", F.lit("good").alias("kind")).unionByName(broken.select(F.regexp_extract("_file", "([^/]+)[.]json$", 1).alias("id"), F.lit("broken").alias("kind")))


def _change_round(s: SparkSession, d: str) -> DataFrame:
    """All changes written as documents and parsed again."""
    pages = specs.change_markdown(conform(_changes(s, d), CHANGES))
    parsed = IN.parse_changes(pages)
    return parsed.select("project_id", "slug", "title", "status", "where_path", "capability_path", "tasks")


def _delta_round(s: SparkSession, d: str) -> DataFrame:
    """A delta document for each change, written from its memories, and its rows."""
    r = _requirements(s, d).where("requirement <> ''").withColumns({"requirement": F.regexp_replace("requirement", r"\s+", " "), "body": F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")})
    r = r.groupBy("project_id", "change_id", "requirement").agg(F.min("body").alias("body")).withColumn("op", F.when(F.length("requirement") % 2 == 0, "MODIFIED").otherwise("ADDED"))
    block = F.concat(F.lit("### Requirement: "), "requirement", F.lit("\n"), F.concat(F.lit("It says: "), "body"), F.lit("\n#### Scenario: s\n- **WHEN** x\n- THEN: y\n"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op", "requirement", F.concat(F.lit("## "), "op", F.lit(" Requirements\n"), block).alias("t")))), lambda x: x["t"]), "\n")
    rows = specs.delta_rows(r.groupBy("project_id", "change_id").agg(page.alias("content")))
    return rows.select("project_id", "change_id", "op", "requirement", "body", F.size("scenarios").alias("n_scenarios"), F.size(F.col("scenarios")[0]["steps"]).alias("n_steps"))


def _snippets(s: SparkSession, d: str) -> DataFrame:
    """Two lines of each document from the line of its length modulo 5."""
    files = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("project_id"), F.lit("a").alias("path"), F.col("text").alias("content"))
    nodes = files.select("project_id", F.lit("n").alias("id"), "path", F.concat(F.lit('{"line": '), (F.length("content") % 5 + 1).cast("string"), F.lit("}")).alias("metadata"))
    return C.snippet(files, nodes, 2).select(F.col("project_id").cast("bigint").alias("doc_id"), "line", "text")


QUERIES = {
    "dml_01_save": saved,
    "dml_05_update": lambda s, d: L.update(_mem(s, d), _mem(s, d).select("project_id", "id", F.when(F.length("what") % 3 == 0, "").when(F.length("what") % 3 == 1, F.concat(F.lit("New: "), "what")).alias("learned")), NOW).select("project_id", "id", "learned", "revision_count", "last_seen_at"),
    "dml_08_start": started, "dml_08_end": ended, "dml_08_summary": summarised,
    "dml_08_delete": lambda s, d: sessions.delete_sessions(table(s, d, "sessions"), _mem(s, d), table(s, d, "sessions"))[0].select("project_id", "id"),
    "dml_15_register": lambda s, d: L.register(table(s, d, "projects"), table(s, d, "sessions").select(F.col("directory").alias("path")), NOW).select("name", "path"),
    "dml_16_create": created, "dml_16_edit": edited, "dml_20_commit": committed, "dml_21_prompts": captured, "dml_21_passive": passive, "dml_22_link": linked,
    "join_02_links": rationale, "sea_10_context": context,
    "flt_17_changes": lambda s, d: M.invalid_changes(conform(_changes(s, d), CHANGES), {"title": 40, "tasks": 60}).select("project_id", "id", F.array_join("problems", ",").alias("problems")),
    "snk_04_vault": lambda s, d: exports.simple_vault(_mem(s, d).limit(0), P._nodes(s, d), P._edges(s, d)),
    "snk_13_meta": lambda s, d: B.replaced_meta(snapshots(s, d)[0], snapshots(s, d)[1].where("size % 2 = 0")),
    "src_03_manifests": lambda s, d: dependencies(_manifests(s, d)),
    "src_05_scripts": lambda s, d: extract(_js(s, d)).select("project_id", "path", "kind", "name", "type", "line", "exported"),
    "src_09_ddl": lambda s, d: extract(_ddl(s, d)).select("project_id", "path", "kind", "name", "type", "line", "meta"),
    "src_11_file_nodes": lambda s, d: file_nodes(_js(s, d)).select("project_id", "id", "node_type", "label", F.get_json_object("metadata", "$.loc").cast("int").alias("loc"), F.get_json_object("metadata", "$.exports_count").cast("int").alias("exports_count")),
    "src_12_json": _json_round, "src_13_chunks": _chunk_round, "src_15_changes": _change_round, "src_16_deltas": _delta_round, "src_18_snippets": _snippets,
}

_M = "memories"
_W60 = f"{q.AS_OF_SQL} - INTERVAL 60 DAY"
_HASH = "sha256(coalesce(what, '') || chr(0) || coalesce(why, '') || chr(0) || coalesce(learned, '') || chr(0) || coalesce(where_path, ''))"
_RED = ", ".join(f"{q.redact(c)} AS {c}" for c in ("what", "why", "learned", "where_path"))
_REDS = lambda c: q.redact(c)
_SLUG = "regexp_replace(lower(substring(goal, 1, 12)), '[^a-z0-9]+', '-', 'g')"
_DEC = "d AS (SELECT project_id, id AS change_id FROM ch), x AS (SELECT project_id, change_id FROM d UNION ALL SELECT project_id, 'no-' || change_id FROM d WHERE length(change_id) % 2 = 0)"

def _short(c: str) -> str:
    return f"CASE WHEN length({q.trim(c)}) > 64 THEN substring({q.trim(c)}, 1, 64) || '…' ELSE {q.trim(c)} END"


#: The graph with its links to memories (rf) and capabilities (im): n, e and d over it.
_LINKED = f"""WITH RECURSIVE {P._N.replace('n AS', 'n0 AS', 1)}, {P._E.replace('e AS', 'e0 AS', 1)}, {_CH}, {_RQ},
    rf AS (SELECT m.project_id, m.id AS memory_id, m.change_id, n0.id AS node_id, m.what FROM pm m JOIN n0 ON n0.project_id = m.project_id AND n0.id = n0.path AND n0.id = {q.node_path('m.where_path')} WHERE m.deleted_at IS NULL),
    im AS (SELECT ch.project_id, n0.path AS source_id, 'spec:' || capability_path AS target_id FROM ch JOIN n0 ON n0.project_id = ch.project_id AND n0.id = n0.path AND n0.path = {q.node_path('ch.where_path')} WHERE capability_path <> ''
      UNION SELECT rf.project_id, memory_id, 'spec:' || capability_path FROM rf JOIN ch ON ch.project_id = rf.project_id AND ch.id = rf.change_id WHERE rf.change_id <> '' AND capability_path <> ''),
    n AS (SELECT * FROM n0 UNION ALL SELECT project_id, memory_id, 'document', {_short(q.redact('what'))}, 'memory:' || memory_id, NULL FROM rf UNION ALL SELECT DISTINCT project_id, 'spec:' || capability_path, 'spec', {_short(chr(39) + 'capability: ' + chr(39) + ' || capability_path')}, capability_path, NULL FROM ch WHERE capability_path <> ''),
    e AS (SELECT * FROM e0 WHERE relation_type NOT IN ('rationale_for', 'implements') UNION ALL SELECT project_id, memory_id, node_id, 'rationale_for', memory_id || '-' || node_id || '-rationale_for', 'INFERRED' FROM rf UNION ALL SELECT project_id, source_id, target_id, 'implements', source_id || '->' || target_id || '-implements', 'INFERRED' FROM im), {P._D}"""

SQL = {
    "dml_01_save": f"""WITH i AS (SELECT * REPLACE ({_RED}) FROM memories WHERE created_at >= {_W60}), inc AS (SELECT *, {_HASH} AS h, coalesce(topic_key, '') <> '' AS t FROM i), cur AS (SELECT *, {_HASH} AS h FROM memories WHERE created_at < {_W60}),
        ot AS (SELECT * FROM cur WHERE deleted_at IS NULL AND topic_key <> '' QUALIFY row_number() OVER (PARTITION BY project_id, topic_key ORDER BY created_at DESC, id) = 1),
        ob AS (SELECT * FROM cur WHERE deleted_at IS NULL AND created_at > {_W60} - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY project_id, category, h ORDER BY created_at, id) = 1),
        gt AS (SELECT project_id, topic_key, count(*) AS n, arg_max({{'w': what}}, (created_at, id)).w AS what, min({{'c': created_at, 'i': id}}) AS f FROM inc WHERE t GROUP BY ALL),
        gp AS (SELECT project_id, category, h, count(*) AS n, arg_min({{'i': id, 'w': what, 'r': revision_count, 'c': created_at, 't': topic_key}}, (created_at, id)) AS f FROM inc WHERE NOT t GROUP BY ALL),
        new AS (SELECT g.project_id, coalesce(o.id, g.f.i) AS id, g.topic_key, g.what, coalesce(o.revision_count, 0) + n AS revision_count, coalesce(o.duplicate_count, 0) AS duplicate_count, coalesce(o.created_at, g.f.c) AS created_at FROM gt g LEFT JOIN ot o ON o.project_id = g.project_id AND o.topic_key = g.topic_key
          UNION ALL SELECT g.project_id, coalesce(o.id, g.f.i), CASE WHEN o.id IS NULL THEN g.f.t ELSE o.topic_key END, CASE WHEN o.id IS NULL THEN g.f.w ELSE o.what END, CASE WHEN o.id IS NULL THEN coalesce(g.f.r, 0) ELSE o.revision_count END, CASE WHEN o.id IS NULL THEN n - 1 ELSE coalesce(o.duplicate_count, 0) + n END, coalesce(o.created_at, g.f.c) FROM gp g LEFT JOIN ob o ON o.project_id = g.project_id AND o.category = g.category AND o.h = g.h)
        SELECT project_id, id, topic_key, what, CAST(revision_count AS BIGINT) AS revision_count, CAST(duplicate_count AS BIGINT) AS duplicate_count, created_at FROM new UNION ALL SELECT project_id, id, topic_key, what, revision_count, duplicate_count, created_at FROM cur c WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.project_id = c.project_id AND new.id = c.id)""",
    "dml_05_update": f"SELECT project_id, id, CASE WHEN deleted_at IS NULL AND length(what) % 3 = 0 THEN '' WHEN deleted_at IS NULL AND length(what) % 3 = 1 THEN {_REDS(chr(39) + 'New: ' + chr(39) + ' || what')} ELSE learned END AS learned, CASE WHEN deleted_at IS NULL THEN coalesce(revision_count, 0) + 1 ELSE revision_count END AS revision_count, CASE WHEN deleted_at IS NULL THEN {q.AS_OF_SQL} ELSE last_seen_at END AS last_seen_at FROM memories",
    "dml_08_start": f"SELECT project_id, id, goal, status, started_at FROM sessions UNION ALL SELECT project_id, 's-' || id, content, 'active', {q.AS_OF_SQL} FROM user_prompts WHERE session_id IS NULL",
    "dml_08_end": f"WITH s AS (SELECT *, lower({q.trim('status')}) = 'active' AS a FROM sessions) SELECT project_id, id, CASE WHEN a THEN 'completed' ELSE status END AS status, CASE WHEN a THEN {q.redact('goal')} ELSE summary END AS summary, CASE WHEN a THEN {q.AS_OF_SQL} ELSE ended_at END AS ended_at FROM s",
    "dml_08_summary": f"SELECT project_id, id, CASE WHEN goal IS NULL THEN goal ELSE {q.redact('goal')} END AS goal, CASE WHEN goal IS NULL THEN summary ELSE 'Goal: ' || {q.redact('goal')} || chr(10) || 'Discoveries: ' || {q.redact(chr(99) + 'oalesce(directory, $$$$)')} || chr(10) || 'Accomplished: ' || {q.redact(chr(99) + 'oalesce(status, $$$$)')} || chr(10) || 'Next Steps: ' || chr(10) || 'Files: ' || {q.redact('id')} END AS summary FROM sessions",
    "dml_08_delete": "SELECT project_id, id FROM sessions s WHERE EXISTS (SELECT 1 FROM memories m WHERE m.project_id = s.project_id AND m.session_id = s.id)",
    "dml_15_register": f"WITH p AS (SELECT DISTINCT regexp_replace({q.trim('directory')}, '/+$', '') AS path FROM sessions) SELECT name, path FROM projects UNION ALL SELECT string_split(path, '/')[-1], path FROM p WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM projects o WHERE o.id = substring(sha256(p.path), 1, 12))",
    "dml_16_create": f"""WITH r AS (SELECT project_id, {q.redact(q.trim(_SLUG))} AS slug, {q.redact(q.trim('goal'))} AS title FROM sessions WHERE goal IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY project_id, slug) AS k FROM r),
        o AS (SELECT project_id, slug, CASE WHEN coalesce(project_id, '') = '' THEN 'no project' WHEN slug = '' THEN 'no slug' WHEN title = '' THEN 'no title' ELSE 'made' END AS outcome, count(*) AS n FROM n GROUP BY ALL)
        SELECT project_id, slug, outcome, CASE WHEN outcome = 'made' THEN 1 ELSE n END AS n FROM o UNION ALL SELECT project_id, slug, 'slug is taken', n - 1 FROM o WHERE outcome = 'made' AND n > 1""",
    "dml_16_edit": f"WITH {_CH} SELECT project_id, id, {q.redact(chr(39) + 'Goal: ' + chr(39) + ' || title')} AS goal, CASE WHEN length(title) % 4 = 0 THEN 'core' WHEN length(title) % 2 = 0 THEN id ELSE capability_path END AS capability_path, CASE status WHEN 'draft' THEN 'proposed' WHEN 'validated' THEN 'applied' ELSE status END AS status, CASE WHEN status = 'validated' THEN {q.AS_OF_SQL} END AS archived_at FROM ch",
    "dml_20_commit": f"""WITH {_CH}, {_RQ}, {_DEC}
        SELECT project_id, change_id AS what, 1::BIGINT AS n, 'memory' AS kind FROM d UNION ALL SELECT project_id, change_id, 1, 'problem' FROM x WHERE change_id LIKE 'no-%' UNION ALL SELECT project_id, 'applied', count(*), 'change' FROM ch GROUP BY 1
        UNION ALL SELECT project_id, change_id, count(DISTINCT {q.redact(q.trim('requirement'))}), 'capability' FROM rq WHERE requirement <> '' GROUP BY 1, 2""",
    "dml_21_prompts": f"SELECT project_id, id, session_id, content, created_at FROM user_prompts UNION ALL SELECT project_id, 'n-' || id, session_id, {q.trim(q.redact('content'))} AS content, {q.AS_OF_SQL} FROM user_prompts WHERE {q.trim(q.redact('content'))} <> ''",
    "dml_21_passive": f"WITH n AS (SELECT project_id, id, {q.redact('content')} AS learned FROM user_prompts) SELECT project_id, min(id) AS id, 'journal' AS category, learned, count(*) - 1 AS duplicate_count FROM n GROUP BY project_id, learned",
    "dml_22_link": "SELECT project_id, id, CASE WHEN topic_key <> '' AND deleted_at IS NULL THEN 'c/' || topic_key ELSE change_id END AS change_id FROM memories",
    "sea_10_context": f"""{_LINKED}, st AS (SELECT project_id, id AS start_id, path FROM (SELECT *, {P._RES_RANK} AS r FROM n) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY r, id) = 1), {', '.join(P.blast_ctes(10))},
        mm AS (SELECT project_id, id, min(source) AS source FROM (SELECT m.project_id, m.id, 0 AS source FROM pm m JOIN st ON st.project_id = m.project_id AND st.path = {q.node_path('m.where_path')} WHERE m.deleted_at IS NULL
          UNION ALL SELECT e.project_id, e.source_id, 1 FROM e JOIN st ON st.project_id = e.project_id AND st.start_id = e.target_id WHERE relation_type = 'rationale_for') GROUP BY ALL),
        ne AS (SELECT e.project_id, 'dependent' AS side, source_id AS other, relation_type FROM e JOIN st ON st.project_id = e.project_id AND st.start_id = e.target_id WHERE relation_type <> 'rationale_for' UNION ALL SELECT e.project_id, 'dependency', target_id, relation_type FROM e JOIN st ON st.project_id = e.project_id AND st.start_id = e.source_id WHERE relation_type <> 'rationale_for'),
        cp AS (SELECT DISTINCT e.project_id, substring(target_id, 6) AS c FROM e JOIN st ON st.project_id = e.project_id AND st.start_id = e.source_id WHERE relation_type = 'implements')
        SELECT d.project_id, 'node' AS section, 1 AS rank, d.id, concat_ws(' ', CASE WHEN fan_in > 10 OR fan_out > 10 THEN 'god' WHEN fan_in = 0 AND fan_out > 0 THEN 'entry' WHEN fan_in > 0 AND fan_out = 0 THEN 'leaf' WHEN fan_in > 0 THEN 'intermediate' ELSE 'isolated' END,
          CASE WHEN fan_in > 10 OR fan_out > 10 THEN 'HIGH' WHEN fan_in > 5 OR fan_out > 8 THEN 'MEDIUM' ELSE 'LOW' END, fan_in, fan_out) AS detail FROM d JOIN st ON st.project_id = d.project_id AND st.start_id = d.id
        UNION ALL SELECT mm.project_id, 'memory', CAST(row_number() OVER (PARTITION BY mm.project_id ORDER BY source, created_at DESC NULLS LAST, mm.id) AS INT) AS rk, mm.id, {q.redact('what')} FROM mm JOIN pm ON pm.project_id = mm.project_id AND pm.id = mm.id AND pm.deleted_at IS NULL QUALIFY rk <= 5
        UNION ALL SELECT ne.project_id, side, CAST(row_number() OVER (PARTITION BY ne.project_id, side ORDER BY other, relation_type) AS INT) AS rk, other, relation_type FROM ne JOIN n ON n.project_id = ne.project_id AND n.id = ne.other QUALIFY rk <= 5
        UNION ALL SELECT project_id, 'blast', rank, id, depth || ' ' || relation_type FROM ({P._LEVELS})
        UNION ALL SELECT project_id, 'change', CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rk, id, concat_ws(' ', status, title, {_PROGRESS}) FROM ch WHERE status NOT IN ('archived', 'rejected') AND contains(lower(where_path), 'gate') QUALIFY rk <= 10
        UNION ALL SELECT cp.project_id, 'capability', CAST(row_number() OVER (PARTITION BY cp.project_id ORDER BY c) AS INT) AS rk, c, any_value(t.n) || ': ' || any_value(t.r) FROM cp JOIN (SELECT project_id, capability_path, count(*) AS n, array_to_string(list_sort(list(DISTINCT requirement))[1:5], ' · ') AS r FROM rq GROUP BY ALL) t ON t.project_id = cp.project_id AND t.capability_path = c GROUP BY cp.project_id, c QUALIFY rk <= 10""",
    "join_02_links": f"""{_LINKED} SELECT project_id, memory_id || '-' || node_id || '-rationale_for' AS id, memory_id AS source_id, node_id AS target_id, 'rationale_for' AS relation_type FROM rf UNION ALL SELECT project_id, source_id || '->' || target_id || '-implements', source_id, target_id, 'implements' FROM im""",
    "flt_17_changes": rf"""WITH {_CH}, t AS (SELECT project_id, change_id AS id, sum(length(id) + 6) + count(*) - 1 AS b FROM memories WHERE change_id <> '' GROUP BY ALL)
        SELECT * FROM (SELECT ch.project_id, ch.id, concat_ws(',', CASE WHEN NOT regexp_matches(ch.id, '^[^/\\]+(/[^/\\]+)*$') OR regexp_matches(ch.id, '(^|/)\.{{1,2}}(/|$)') THEN 'unsafe slug' END, CASE WHEN capability_path <> '' AND (NOT regexp_matches(capability_path, '^[^/\\]+(/[^/\\]+)*$') OR regexp_matches(capability_path, '(^|/)\.{{1,2}}(/|$)')) THEN 'unsafe capability_path' END,
          CASE WHEN coalesce({q.trim('title')}, '') = '' THEN 'no title' END, CASE WHEN strlen(title) > 40 THEN 'title too long' END, CASE WHEN b > 60 THEN 'tasks too long' END) AS problems FROM ch JOIN t ON t.project_id = ch.project_id AND t.id = ch.id) WHERE problems <> ''""",
    "snk_04_vault": f"""{P._BASE}, o AS ({_bullet_list("source_id", "relation_type || ' [[' || " + _FILE.format("target_id") + " || ']]'", "e")})
        SELECT n.project_id, 'nodes/' || {_FILE.format("n.id")} || '.md' AS path, '# ' || coalesce(label, n.id) || chr(10) || chr(10) || 'type: ' || coalesce(node_type, '') || chr(10) || 'path: ' || coalesce(path, '') || coalesce(chr(10) || chr(10) || '## Relations' || chr(10) || chr(10) || o.t, '') || chr(10) AS content FROM n LEFT JOIN o ON o.project_id = n.project_id AND o.id = n.id""",
    "snk_13_meta": f"WITH {_SNAP}, u AS (SELECT DISTINCT project_id FROM w WHERE z % 2 = 0) SELECT project_id, path, CAST(epoch_us(created_at) // 1000 AS BIGINT) AS mtime_ms, z AS size FROM (SELECT o.*, documents.created_at FROM o JOIN documents ON doc_id = CAST(path AS BIGINT) WHERE o.project_id NOT IN (SELECT project_id FROM u) UNION ALL SELECT w.*, documents.created_at FROM w JOIN documents ON doc_id = CAST(path AS BIGINT) WHERE z % 2 = 0)",
    "src_03_manifests": "SELECT DISTINCT project_id, id || '/package.json' AS source_id, 'pkg:' || label AS target_id FROM (SELECT project_id, id, any_value(label) AS label FROM graph_nodes WHERE node_type = 'package' GROUP BY ALL)",
    "src_05_scripts": f"""{P._BASE}, f AS (SELECT project_id, path || '.js' AS path, label, length(path) AS l FROM n WHERE id = path)
        SELECT project_id, path, 'import' AS kind, './' || label AS name, NULL::VARCHAR AS type, 2 AS line, NULL::BOOLEAN AS exported FROM f UNION ALL SELECT project_id, path, 'import', 'pkg-' || length(label), NULL, 3, NULL FROM f UNION ALL SELECT project_id, path, 'symbol', 'f' || l, 'function', 5, true FROM f
        UNION ALL SELECT project_id, path, 'call', 'helper', NULL, 6, NULL FROM f UNION ALL SELECT project_id, path, 'symbol', 'K' || l, 'class', 8, false FROM f""",
    "src_09_ddl": f"""{P._BASE}, f AS (SELECT project_id, path || '.sql' AS path, 't_' || regexp_replace(label, '[^A-Za-z0-9]', '_', 'g') AS t, length(label) AS l FROM n WHERE node_type IN ('package', 'file'))
        SELECT project_id, path, 'symbol' AS kind, t AS name, 'table' AS type, 2 AS line, 'id SERIAL notnull pk auto; v DECIMAL(' || l || ',2) notnull default=0' AS meta FROM f UNION ALL SELECT project_id, path, 'symbol', 'ix_' || t, 'index', 7, t || ' unique' FROM f WHERE l % 2 = 0
        UNION ALL SELECT project_id, path, 'foreign_key', t || ' -> base', NULL, 8, NULL FROM f WHERE l % 2 = 0""",
    "src_11_file_nodes": f"{P._BASE} SELECT project_id, path || '.js' AS id, 'file' AS node_type, string_split(path, '/')[-1] || '.js' AS label, 10 AS loc, 1 AS exports_count FROM n WHERE id = path",
    "src_12_json": "SELECT project_id, id, what, learned, revision_count, date_trunc('millisecond', created_at) AS created_at, pinned FROM memories WHERE deleted_at IS NULL",
    "src_13_chunks": f"SELECT id, CASE WHEN length({_JSON}) % 5 = 0 THEN 'broken' ELSE 'good' END AS kind FROM memories WHERE deleted_at IS NULL AND pinned",
    "src_15_changes": f"""WITH {_CH}, t AS (SELECT project_id, change_id AS id, string_agg(CASE WHEN deleted_at IS NULL AND NOT coalesce(category = 'idea', false) THEN '- [x] ' ELSE '- [ ] ' END || id, chr(10) ORDER BY created_at, id) AS tasks FROM memories WHERE change_id <> '' GROUP BY ALL)
        SELECT ch.project_id, ch.id AS slug, {q.trim('string_split(title, chr(10))[1]')} AS title, status, {q.trim('where_path')} AS where_path, CASE WHEN capability_path <> '' THEN {q.trim('capability_path')} END AS capability_path, {q.redact('tasks')} AS tasks FROM ch JOIN t ON t.project_id = ch.project_id AND t.id = ch.id""",
    "src_16_deltas": rf"""WITH {_RQ}, r AS (SELECT project_id, change_id, regexp_replace(requirement, '\s+', ' ', 'g') AS requirement, min(regexp_replace(coalesce(body, ''), '\s+', ' ', 'g')) AS body FROM rq WHERE requirement <> '' GROUP BY ALL)
        SELECT project_id, change_id, CASE WHEN length(requirement) % 2 = 0 THEN 'MODIFIED' ELSE 'ADDED' END AS op, {q.trim('requirement')} AS requirement, {q.trim("'It says: ' || body")} AS body, 1 AS n_scenarios, 2 AS n_steps FROM r WHERE {q.trim('requirement')} <> ''""",
    "src_18_snippets": f"""WITH l AS (SELECT doc_id, CAST(length(text) % 5 + 1 AS INT) AS line, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, line, {q.redact("array_to_string(t[line:line + 1], chr(10))")} || CASE WHEN len(t) - line + 1 > 2 THEN chr(10) || '... [truncated, ' || (len(t) - line - 1) || ' more lines]' ELSE '' END AS text FROM l WHERE line <= len(t)""",
}
