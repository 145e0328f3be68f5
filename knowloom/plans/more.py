"""Set operations, specification tables, incremental merges and stream forms over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators import build as B
from knowloom.operators import changes as H
from knowloom.operators import code as C
from knowloom.operators import context as X
from knowloom.operators import graph as G
from knowloom.operators import lifecycle as L
from knowloom.operators import memory as M
from knowloom.operators import search as S
from knowloom.operators import specs
from knowloom.plans import graph as P
from knowloom.plans import sqltext as q
from knowloom.plans.functions import NOW
from knowloom.plans.code import snapshots
from knowloom.plans.memory import PLACED, WEEK_AGO, placed
from knowloom.sinks import exports
from knowloom.sinks.store import orphan_paths
from knowloom.sources.memories import import_memories
from knowloom.streaming import jobs
from knowloom.tables import CHANGES, MEMORIES, conform, table


def _mem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories")


def _changes(s: SparkSession, d: str) -> DataFrame:
    """Changes as memory rows name them: one for each change_id, its state by its newest memory's category, its tasks its memories, done unless deleted or an idea."""
    m = placed(s, d).where("change_id <> ''")
    place = F.struct("created_at", "id")
    done = F.col("deleted_at").isNull() & ~F.coalesce(F.col("category") == "idea", F.lit(False))
    line = F.struct("created_at", "id", F.concat(F.when(done, "- [x] ").otherwise("- [ ] "), F.col("id")).alias("t"))
    by = m.groupBy("project_id", F.col("change_id").alias("id")).agg(
        F.max_by("what", place).alias("title"), F.max_by("category", place).alias("c"), F.min("where_path").alias("where_path"), F.max("created_at").alias("created_at"), F.min_by("topic_key", place).alias("capability_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("tasks"),
    )
    status = F.when(F.col("c") == "decision", "validated").when(F.col("c") == "architecture", "proposed").when(F.col("c") == "bugfix", "archived").otherwise("draft")
    return by.select("project_id", "id", F.col("id").alias("slug"), status.alias("status"), "title", "where_path", "capability_path", "tasks", "created_at")


def _requirements(s: SparkSession, d: str) -> DataFrame:
    """Requirements as memory rows state them: title and reason of every memory with a change."""
    return _mem(s, d).where("change_id <> ''").select("project_id", "change_id", F.coalesce("topic_key", F.lit("general")).alias("capability_path"), F.col("what").alias("requirement"), F.col("why").alias("body"))


def ordered_union(s: SparkSession, d: str) -> DataFrame:
    """Pinned rows, then the newest, each memory once, five a project."""
    cols = ["project_id", "id", "created_at"]
    return M.ordered_union([M.pinned(_mem(s, d), 3).select(*cols), S.active(_mem(s, d)).select(*cols)], [F.desc("created_at")], 5).select("project_id", "rank", "id", "source")


def divergence(s: SparkSession, d: str) -> DataFrame:
    """What an import reports of rows whose revision is older, or whose content differs at the same one: the table's own rows with odd revisions set back and texts edited."""
    m = _mem(s, d)
    k = F.length("id") + F.coalesce(F.length("what"), F.lit(0))
    theirs = m.where("project_id IS NOT NULL").withColumns({"revision_count": F.when(k % 3 == 0, F.col("revision_count") - 1).otherwise(F.col("revision_count")), "normalized_hash": F.when(k % 3 == 1, F.lit("edited")).otherwise(F.col("normalized_hash"))})
    return import_memories(m, theirs, "p")[2]


def validation(s: SparkSession, d: str) -> DataFrame:
    """Requirements with two scenarios each against deltas that modify them with the first only where the title is of even length."""
    two = F.expr("array(named_struct('name', 'works', 'steps', array(named_struct('keyword', 'THEN', 'text', 'ok'))), named_struct('name', 'fails', 'steps', array(named_struct('keyword', 'THEN', 'text', 'no'))))")
    rows = _requirements(s, d).groupBy("project_id", "capability_path", "requirement").agg(F.min("body").alias("body")).withColumn("scenarios", two)
    some = F.when(F.length("requirement") % 2 == 0, F.slice("scenarios", 1, 1)).otherwise(F.col("scenarios"))
    return specs.validate_deltas(rows, rows.withColumns({"op": F.lit("MODIFIED"), "scenarios": some}))


def first_saves(s: SparkSession, d: str) -> DataFrame:
    """The table's files as a stream, without repeats."""
    stream = s.readStream.schema(MEMORIES).parquet(f"{d}/memories.parquet*")
    return jobs.run_once(jobs.first_saves(stream).select("project_id", "category", "digest"))


def consolidated(s: SparkSession, d: str) -> DataFrame:
    """(tbl, project_id, n): rows of every table once the project of the least id is moved to the one of the greatest."""
    names = ("projects", "memories", "sessions", "memory_relations", "user_prompts", "graph_nodes", "graph_edges")
    tables = {n: table(s, d, n) for n in names}
    low, high = tables["projects"].agg(F.min("id"), F.max("id")).first()
    moved, out = L.consolidate(tables, low, high), None
    for n, t in moved.items():
        rows = t.groupBy(F.col("id" if n == "projects" else "project_id").alias("project_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "flt_14_active_changes": lambda s, d: L.active_changes(_changes(s, d), "pkg/"),
    "flt_21_changes": lambda s, d: H.by_status(conform(_changes(s, d), CHANGES), "draft", 5).select("project_id", "rank", "id"),
    "flt_21_lookup": lambda s, d: H.find_changes(conform(_changes(s, d), CHANGES), _mem(s, d).select("project_id", F.col("change_id").alias("name"))).select("project_id", "name", "id", "status"),
    "agg_04_change_states": lambda s, d: M.state_counts(_changes(s, d), table(s, d, "projects"), M.CHANGE_STATES),
    "agg_07_capabilities": lambda s, d: specs.capability_digest(_requirements(s, d)),
    "agg_11_validator": lambda s, d: C.unique_validator(snapshots(s, d)[1]),
    "agg_12_capability_paths": lambda s, d: specs.capability_paths(_requirements(s, d)),
    "agg_12_requirements": lambda s, d: specs.requirements_of(_requirements(s, d), "general").select("project_id", "requirement", "body", "change_id"),
    "agg_20_tasks": lambda s, d: _changes(s, d).select("project_id", "id", text.task_summary(F.col("tasks")).alias("progress")),
    "win_05_last_session": lambda s, d: S.active(_mem(s, d)).where("topic_key <> ''").groupBy("project_id", "topic_key").agg(F.max_by(F.when(F.col("session_id") != "", F.col("session_id")), F.when(F.col("session_id") != "", F.struct("created_at", "id"))).alias("session_id")),
    "win_07_relabel": lambda s, d: G.relabelled(P._given(s, d).withColumn("community", F.col("community") * 7 % 1009)),
    "srt_01_newest": lambda s, d: S.search(_mem(s, d), "", NOW, limit=5).select("project_id", "rank", "id"),
    "srt_02_page": lambda s, d: S.search(_mem(s, d), "", NOW, limit=5, offset=5).select("project_id", "rank", "id"),
    "set_01_ends": lambda s, d: M.relations_of(table(s, d, "memory_relations")).select("project_id", "memory_id").distinct(),
    "set_02_ordered_union": ordered_union,
    "set_05_orphans": lambda s, d: orphan_paths(_mem(s, d).select(F.concat("id", F.lit(".json")).alias("path")), exports.memory_json(_mem(s, d))),
    "set_06_overlap": lambda s, d: _mem(s, d).select("id", *[c.alias(n) for c, n in zip(scalar.overlap(text.title_tokens(F.col("what")), text.title_tokens(F.col("learned"))), ("shared", "either"))]),
    "join_08_changes_with_requirements": lambda s, d: specs.with_requirements(_changes(s, d), _requirements(s, d).where("body <> ''")).select("project_id", "id"),
    "join_13_capability_edges": lambda s, d: specs.capability_edges(_changes(s, d), _requirements(s, d), P._nodes(s, d)),
    "join_22_lookup": lambda s, d: M.lookup(_mem(s, d), table(s, d, "memory_relations").select("project_id", F.col("source_id").alias("id"))).select("project_id", "id", "where_path"),
    "join_23_divergence": divergence,
    "join_24_keep_untouched": lambda s, d: C.keep_untouched(P._nodes(s, d), P._nodes(s, d).where("node_type = 'file'"), ["project_id", "path"]).select("project_id", "id"),
    "sea_11_session_context": lambda s, d: M.session_context(_mem(s, d), table(s, d, "sessions")),
    "gra_07_insight": lambda s, d: B.persist_insight(P._nodes(s, d), *P._insight(P._nodes(s, d), P._edges(s, d))).select("project_id", "id", scalar.json_long(F.col("metadata"), "community_id").alias("community"), scalar.json_double(F.col("metadata"), "betweenness_centrality").alias("centrality")),
    "gra_11_community_paths": lambda s, d: X.community_paths(P._nodes(s, d), P._starts(s, d).withColumnRenamed("start_id", "id")),
    "dml_06_pin": lambda s, d: L.pin(_mem(s, d), _mem(s, d).where("category = 'standard'")).where("pinned").select("project_id", "id"),
    "dml_10_ignore": lambda s, d: L.ignore_conflicts(table(s, d, "memory_relations"), table(s, d, "memory_relations").where("status = 'pending'")).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "dml_11_reviewed": lambda s, d: L.mark_reviewed(_mem(s, d), M.stale(_mem(s, d), NOW), NOW).select("id", "review_after"),
    "dml_15_consolidate": consolidated,
    "dml_19_validate": validation,
    "str_03_changed": lambda s, d: M.changed_since(_mem(s, d), WEEK_AGO).select("id"),
    "str_04_first_saves": first_saves,
    "str_05_bursts": lambda s, d: jobs.write_bursts(_mem(s, d), "1 hour"),
}

_LIVE = "FROM memories WHERE deleted_at IS NULL"
_W60 = f"{q.AS_OF_SQL} - INTERVAL 60 DAY"
_HASH = "sha256(coalesce(what, '') || chr(0) || coalesce(why, '') || chr(0) || coalesce(learned, '') || chr(0) || coalesce(where_path, ''))"
_DONE = "deleted_at IS NULL AND NOT coalesce(category = 'idea', false)"
_CH = PLACED + f""", ch AS (SELECT project_id, change_id AS id, count(*) FILTER ({_DONE}) AS done, count(*) AS total, arg_max({{'t': what}}, (created_at, id)).t AS title, CASE arg_max({{'t': category}}, (created_at, id)).t WHEN 'decision' THEN 'validated' WHEN 'architecture' THEN 'proposed' WHEN 'bugfix' THEN 'archived' ELSE 'draft' END AS status,
    min(where_path) AS where_path, max(created_at) AS created_at, arg_min({{'t': topic_key}}, (created_at, id)).t AS capability_path FROM pm WHERE change_id <> '' GROUP BY ALL)"""
_PROGRESS = "done || '/' || total || ' (' || CAST(floor(100 * done / total) AS INT) || '%)'"
_RQ = "rq AS (SELECT project_id, change_id, coalesce(topic_key, 'general') AS capability_path, what AS requirement, why AS body FROM memories WHERE change_id <> '')"
_STATE = f"lower({q.trim('status')})"

SQL = {
    "flt_14_active_changes": f"WITH {_CH} SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank, id, id AS slug, status, title, {_PROGRESS} AS progress FROM ch WHERE status NOT IN ('archived', 'rejected') AND contains(lower(where_path), 'pkg/') QUALIFY rank <= 10",
    "flt_21_changes": f"WITH {_CH} SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS INT) AS rank, id FROM ch WHERE status = 'draft' QUALIFY rank <= 5",
    "agg_04_change_states": f"WITH {_CH} SELECT p.id AS project_id, v.status, count(ch.id) AS n FROM projects p CROSS JOIN (SELECT unnest([{q.names(M.CHANGE_STATES)}]) AS status) v LEFT JOIN ch ON ch.project_id = p.id AND ch.status = v.status GROUP BY ALL",
    "agg_07_capabilities": f"WITH {_RQ} SELECT project_id, capability_path, count(*) AS n, array_to_string(list_sort(list(DISTINCT requirement))[1:5], ' · ') AS requirements FROM rq GROUP BY project_id, capability_path",
    "agg_11_validator": "SELECT coalesce(source, '?') AS project_id, count(*) AS n, CAST(max(epoch_us(created_at)) // 1000 AS BIGINT) AS newest FROM documents WHERE kind <> 'journal' GROUP BY 1",
    "agg_12_capability_paths": f"WITH {_RQ} SELECT DISTINCT project_id, capability_path FROM rq",
    "agg_12_requirements": f"WITH {_RQ} SELECT project_id, requirement, body, change_id FROM rq WHERE capability_path = 'general'",
    "flt_21_lookup": f"WITH {_CH} SELECT DISTINCT ch.project_id, ch.id AS name, ch.id, status FROM ch JOIN memories m ON m.project_id = ch.project_id AND m.change_id = ch.id",
    "agg_20_tasks": f"WITH {_CH} SELECT project_id, id, {_PROGRESS} AS progress FROM ch",
    "win_05_last_session": f"SELECT project_id, topic_key, arg_max(session_id, (created_at, id)) FILTER (session_id <> '') AS session_id {_LIVE} AND topic_key <> '' GROUP BY ALL",
    "win_07_relabel": f"{P._BASE}, {P._G} SELECT * FROM g",
    "srt_01_newest": f"SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank, id {_LIVE} QUALIFY rank <= 5",
    "srt_02_page": f"SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank, id {_LIVE} QUALIFY rank BETWEEN 6 AND 10",
    "set_01_ends": "SELECT DISTINCT project_id, memory_id FROM (SELECT project_id, source_id AS memory_id FROM memory_relations UNION SELECT project_id, target_id FROM memory_relations) WHERE memory_id IS NOT NULL",
    "set_02_ordered_union": f"""WITH p AS (SELECT project_id, id, created_at, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n {_LIVE} AND pinned QUALIFY n <= 3),
        u AS (SELECT m.project_id, m.id, m.created_at, CASE WHEN p.id IS NULL THEN 1 ELSE 0 END AS source FROM (SELECT * {_LIVE}) m LEFT JOIN p ON p.project_id = m.project_id AND p.id = m.id)
        SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY source, created_at DESC, id) AS INT) AS rank, id, source FROM u QUALIFY rank <= 5""",
    "set_05_orphans": "SELECT id || '.json' AS path FROM memories EXCEPT SELECT id || '.json' FROM memories WHERE deleted_at IS NULL",
    "set_06_overlap": f"SELECT id, CAST(len(list_intersect(list_distinct({q.title_tokens('what')}), list_distinct({q.title_tokens('learned')}))) AS INT) AS shared, CAST(len(list_distinct(list_concat({q.title_tokens('what')}, {q.title_tokens('learned')}))) AS INT) AS either FROM memories",
    "join_08_changes_with_requirements": f"WITH {_CH}, {_RQ} SELECT project_id, id FROM ch WHERE EXISTS (SELECT 1 FROM rq WHERE body <> '' AND rq.project_id = ch.project_id AND rq.change_id = ch.id)",
    "join_13_capability_edges": f"WITH {_CH} SELECT DISTINCT ch.project_id, n.path AS source_id, 'spec:' || capability_path AS target_id, 'implements' AS relation_type FROM ch JOIN graph_nodes n ON n.project_id = ch.project_id AND n.id = n.path AND n.path = {q.node_path('ch.where_path')} WHERE capability_path <> ''",
    "join_22_lookup": f"SELECT project_id, id, where_path {_LIVE} AND EXISTS (SELECT 1 FROM memory_relations r WHERE r.project_id = memories.project_id AND r.source_id = memories.id)",
    "join_23_divergence": "WITH t AS (SELECT id, revision_count AS r, normalized_hash AS h, CASE WHEN k % 3 = 0 THEN revision_count - 1 ELSE revision_count END AS r2, CASE WHEN k % 3 = 1 THEN 'edited' ELSE normalized_hash END AS h2 FROM (SELECT *, length(id) + coalesce(length(what), 0) AS k FROM memories WHERE project_id IS NOT NULL)) SELECT id, CASE WHEN coalesce(r2, 0) < coalesce(r, 0) THEN 'older revision' ELSE 'other content' END AS reason FROM t WHERE coalesce(r2, 0) < coalesce(r, 0) OR (coalesce(r2, 0) = coalesce(r, 0) AND h2 IS DISTINCT FROM h)",
    "join_24_keep_untouched": f"{P._BASE} SELECT project_id, id FROM n WHERE node_type = 'file' OR NOT EXISTS (SELECT 1 FROM n f WHERE f.node_type = 'file' AND f.project_id = n.project_id AND f.path = n.path)",
    "sea_11_session_context": f"""WITH c AS (SELECT project_id, arg_max(id, (coalesce(ended_at, TIMESTAMPTZ '1900-01-01'), id)) AS session_id FROM sessions WHERE {_STATE} = 'completed' GROUP BY 1),
        m AS (SELECT project_id, session_id, CAST(row_number() OVER (PARTITION BY project_id, session_id ORDER BY created_at, id) AS INT) AS rank, id, {q.redact('what')} AS what {_LIVE} AND session_id IS NOT NULL)
        SELECT m.* FROM m JOIN c ON c.project_id = m.project_id AND c.session_id = m.session_id WHERE rank <= 10""",
    "gra_07_insight": f"{P._BASE}, {P._G}, {P._B} SELECT project_id, id, community, centrality FROM g JOIN bc USING (project_id, id)",
    "gra_11_community_paths": f"{P._BASE}, {P._S}, a AS (SELECT n.project_id, path AS p, regexp_extract(path, '^(.*)/[^/]*$', 1) AS f FROM n JOIN st ON st.project_id = n.project_id AND st.start_id = n.id) SELECT DISTINCT n.project_id, n.path FROM n JOIN a ON a.project_id = n.project_id WHERE node_type <> 'document' AND path <> '' AND ((f <> '' AND starts_with(path, f || '/')) OR path = p)",
    "dml_06_pin": "SELECT project_id, id FROM memories WHERE pinned OR category = 'standard'",
    "dml_10_ignore": "SELECT CASE WHEN status = 'pending' THEN 'ignored' ELSE status END AS status, count(*) AS n FROM memory_relations GROUP BY 1",
    "dml_11_reviewed": f"SELECT id, CASE WHEN deleted_at IS NULL AND NOT coalesce(pinned, false) AND category IN ({q.names(M.TRANSIENT)}) AND coalesce(last_seen_at, created_at) < {q.AS_OF_SQL} - INTERVAL 90 DAY THEN {q.AS_OF_SQL} + to_days({q.review_days('category')}) ELSE review_after END AS review_after FROM memories",
    "dml_15_consolidate": "WITH e AS (SELECT min(id) AS lo, max(id) AS hi FROM projects), a AS (SELECT 'projects' AS tbl, id AS project_id FROM projects WHERE id <> (SELECT lo FROM e)" + "".join(f" UNION ALL SELECT '{t}', CASE WHEN project_id = (SELECT lo FROM e) THEN (SELECT hi FROM e) ELSE project_id END FROM {t}" for t in ("memories", "sessions", "memory_relations", "user_prompts", "graph_nodes", "graph_edges")) + ") SELECT tbl, project_id, count(*) AS n FROM a GROUP BY ALL",
    "dml_19_validate": f"WITH {_RQ}, u AS (SELECT project_id, capability_path, requirement, min(body) AS body FROM rq GROUP BY ALL) SELECT project_id, capability_path, requirement, 'body without RFC 2119 keywords' AS issue FROM u WHERE {q.trim(chr(99) + 'oalesce(body, $$$$)')} <> '' AND len({q.rfc2119('body')}) = 0 UNION ALL SELECT project_id, capability_path, requirement, 'drops scenario fails' FROM u WHERE length(requirement) % 2 = 0",
    "str_03_changed": f"SELECT id {_LIVE} AND (created_at >= {_W60} OR last_seen_at >= {_W60})",
    "str_04_first_saves": f"SELECT DISTINCT project_id, category, {_HASH} AS digest FROM memories",
    "str_05_bursts": """WITH g AS (SELECT project_id, created_at, CASE WHEN created_at < lag(created_at) OVER (PARTITION BY project_id ORDER BY created_at) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM memories WHERE created_at IS NOT NULL),
        s AS (SELECT *, sum(b) OVER (PARTITION BY project_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT project_id, min(created_at) AS started, max(created_at) + INTERVAL 1 HOUR AS ended, count(*) AS n FROM s GROUP BY project_id, k""",
}
