"""Filters, aggregations, windows, sorts, set operations and joins over the memory tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowloom.functions import text
from knowloom.operators import memory as M
from knowloom.operators import search as S
from knowloom.plans import sqltext as q
from knowloom.plans.functions import GOAL, NOW
from knowloom.tables import table

DAY_AGO = NOW - timedelta(days=1)
WEEK_AGO = NOW - timedelta(days=60)


def _t(name: str):  # noqa: ANN202
    return lambda s, d: table(s, d, name)


_mem, _rel, _ses, _pro, _pmt = (_t(x) for x in ("memories", "memory_relations", "sessions", "projects", "user_prompts"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    return _mem(s, d).groupBy("project_id").agg(F.min_by("id", F.struct(F.length("what"), "id")).alias("anchor_id"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return _rel(s, d).where("source_id <> target_id").select("project_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()


def placed(s: SparkSession, d: str) -> DataFrame:
    """The memories, every second of a project with the path of one of its files in place of its own, in turn, in the spelling of a reference with a line.

    No path of the table names a node, so that without this no link would exist.
    """
    m = _mem(s, d).withColumn("_k", F.row_number().over(Window.partitionBy("project_id").orderBy("id")))
    files = table(s, d, "graph_nodes").where("id = path").select("project_id", "path").distinct()
    files = files.withColumn("_j", F.row_number().over(Window.partitionBy("project_id").orderBy("path")))
    many = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("_f"))
    turn = m.join(many, "project_id", "left").withColumn("_j", F.when(F.col("_k") % 2 == 0, F.col("_k") % F.col("_f") + 1))
    return turn.join(files, ["project_id", "_j"], "left").withColumn("where_path", F.coalesce(F.concat(F.lit("./"), "path", F.lit(":7")), "where_path")).drop("_k", "_j", "_f", "path")


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_nodes").where("node_type IN ('file', 'document')").select("project_id", "path")


QUERIES = {
    "flt_01_compact": lambda s, d: S.active(_mem(s, d)).select("project_id", *S.COMPACT),
    "flt_02_full": lambda s, d: S.active(_mem(s, d)).select(*M.FULL),
    "flt_03_get": lambda s, d: M.get(_mem(s, d), "e630ef207ce0", "b101b8124c5a80ee").select("id", "what", "why", "learned"),
    "flt_04_active": lambda s, d: S.active(_mem(s, d)).select("project_id", "id"),
    "flt_05_categories": lambda s, d: M.of_categories(_mem(s, d), "decision", "standard").select("project_id", "id", "category"),
    "flt_07_path_set": lambda s, d: S.active(_mem(s, d)).where(S.path_matches("cmd/", ["pkg/avatar/split_merger.ts"])).select("id", "where_path"),
    "flt_09_session": lambda s, d: M.of_sessions(_mem(s, d)).select("project_id", "session_id", "rank", "id"),
    "flt_10_pinned": lambda s, d: M.pinned(_mem(s, d)).select("project_id", "rank", "id"),
    "flt_11_rolling": lambda s, d: M.since(_mem(s, d), WEEK_AGO).select("id", "created_at"),
    "flt_12_stale": lambda s, d: M.stale(_mem(s, d), NOW).select("project_id", "id", "category"),
    "flt_13_changed": lambda s, d: M.changed_since(_mem(s, d), WEEK_AGO).select("project_id", "id"),
    "flt_17_invalid": lambda s, d: M.invalid_rows(_mem(s, d), {"what": 60, "why": 200, "topic_key": 40}).select("project_id", "id", F.array_join("problems", ",").alias("problems")),
    "flt_20_prompts": lambda s, d: M.recent_prompts(_pmt(s, d)),
    "flt_20_session_prompts": lambda s, d: M.recent_prompts(_pmt(s, d), 3, _pmt(s, d).agg(F.min("session_id")).first()[0]).select("project_id", "rank", "id"),
    "flt_22_relations": lambda s, d: M.relations_of(_rel(s, d)),
    "flt_23_compare": lambda s, d: M.compare(_mem(s, d), _rel(s, d), _pairs(s, d)),
    "agg_01_stats": lambda s, d: M.stats(_pro(s, d), _mem(s, d), _ses(s, d), _rel(s, d), _pmt(s, d), NOW),
    "agg_02_categories": lambda s, d: M.category_counts(_mem(s, d)),
    "agg_03_conflict_states": lambda s, d: M.conflict_states(_rel(s, d), _pro(s, d)),
    "agg_05_busy_topics": lambda s, d: M.busy_topics(_mem(s, d), newer_than=WEEK_AGO).select("project_id", "topic_key", "n"),
    "agg_08_relation_counts": lambda s, d: M.relation_counts(_rel(s, d)),
    "agg_19_projects": lambda s, d: M.project_list(_pro(s, d), _mem(s, d), _ses(s, d)),
    "win_01_latest_topic": lambda s, d: M.latest_of_topics(_mem(s, d)).select("project_id", "topic_key", "id"),
    "win_02_sessions": lambda s, d: M.current_sessions(_ses(s, d)),
    "win_03_timeline": lambda s, d: M.timeline(_mem(s, d), _anchors(s, d)),
    "win_04_bundle": lambda s, d: M.bundle(_mem(s, d), _ses(s, d)),
    "win_04_bundle_goal": lambda s, d: M.bundle(_mem(s, d), _ses(s, d), GOAL),
    "srt_04_review": lambda s, d: M.review_items(_mem(s, d), _rel(s, d), NOW),
    "join_05_conflicts": lambda s, d: M.conflicts(_rel(s, d), _mem(s, d)),
    "join_12_code_links": lambda s, d: M.code_links(placed(s, d), table(s, d, "graph_nodes")),
    "join_21_stale_bindings": lambda s, d: M.stale_bindings(placed(s, d).withColumn("where_path", text.node_path(F.col("where_path"))), _files(s, d)),
    "dml_08_session_guard": lambda s, d: M.session_links(_mem(s, d), _ses(s, d)).select("project_id", "id"),
}

_LIVE = "FROM memories WHERE deleted_at IS NULL"
_RED = q.redact("what")
_W60 = f"{q.AS_OF_SQL} - INTERVAL 60 DAY"
_ENDS = "(SELECT project_id, source_id AS memory_id, id AS relation_id, 'source' AS role FROM memory_relations UNION ALL SELECT project_id, target_id, id, 'target' FROM memory_relations)"
_STATE = f"lower({q.trim('status')})"


#: The memories with places, as :func:`placed` gives them.
PLACED = """pf AS (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS j FROM (SELECT DISTINCT project_id, path FROM graph_nodes WHERE id = path)),
    pc AS (SELECT project_id, count(*) AS f FROM pf GROUP BY 1), pk AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id) AS k FROM memories),
    pm AS (SELECT pk.* REPLACE (coalesce('./' || pf.path || ':7', where_path) AS where_path) FROM pk LEFT JOIN pc ON pc.project_id = pk.project_id LEFT JOIN pf ON pf.project_id = pk.project_id AND k % 2 = 0 AND pf.j = k % f + 1)"""


def _bundle(goal: bool) -> str:
    section = "CASE " + " ".join(f"WHEN category IN ({q.names(c)}) THEN '{n}'" for n, c, _, _ in M.SECTIONS) + " END"
    cap = "CASE section " + " ".join(f"WHEN '{n}' THEN {k}" for n, _, k, _ in M.SECTIONS) + " END"
    why = ", ".join(f"'{n}'" for n, _, _, w in M.SECTIONS if w)
    tokens = [t for t in GOAL.split() if t not in text.STOP_WORDS]
    score = " + ".join(f"CAST(contains(lower(coalesce(what, '') || ' ' || coalesce(why, '')), {q.quote(t)}) AS INT)" for t in tokens)
    order = (f"coalesce(pinned, false) DESC, {score} DESC, " if goal else "") + "created_at DESC NULLS LAST, id"
    rw = q.redact("why")
    return f"""WITH cur AS (SELECT project_id, max((ended_at, id)).id AS sid FROM (SELECT project_id, ended_at, id FROM sessions WHERE {_STATE} = 'completed' AND ended_at IS NOT NULL) GROUP BY 1),
      cur2 AS (SELECT project_id, arg_max(id, (coalesce(ended_at, TIMESTAMPTZ '1900-01-01'), id)) AS sid FROM sessions WHERE {_STATE} = 'completed' GROUP BY 1),
      shown AS (SELECT m.project_id, id FROM (SELECT project_id, session_id, id, row_number() OVER (PARTITION BY project_id, session_id ORDER BY created_at, id) AS n {_LIVE} AND session_id IS NOT NULL) m JOIN cur2 c ON c.project_id = m.project_id AND c.sid = m.session_id WHERE n <= 10
        UNION SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n {_LIVE} AND pinned) WHERE n <= 20),
      p AS (SELECT *, {section} AS section {_LIVE}),
      p2 AS (SELECT *, {cap} AS cap, row_number() OVER (PARTITION BY project_id, section ORDER BY created_at DESC NULLS LAST, id) AS n FROM p WHERE section IS NOT NULL),
      p3 AS (SELECT * FROM p2 WHERE n <= {15 if goal else 'cap'} AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.project_id = p2.project_id AND s.id = p2.id)),
      p4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, section ORDER BY {order}) AS INT) AS rank FROM p3)
      SELECT project_id, section, rank, id, upper(category) AS category, {_RED} AS what,
        CASE WHEN section IN ({why}) THEN CASE WHEN length({rw}) > 300 THEN substring({rw}, 1, 300) || '... [truncated ' || (length({rw}) - 300) || ' chars]' ELSE {rw} END END AS why FROM p4 WHERE rank <= cap"""


def _counts(tbl: str, cols: str) -> str:
    return f"(SELECT project_id, {cols} FROM {tbl} GROUP BY project_id)"


SQL = {
    "flt_01_compact": f"SELECT project_id, {', '.join(S.COMPACT)} {_LIVE}",
    "flt_02_full": f"SELECT {', '.join(M.FULL)} {_LIVE}",
    "flt_03_get": f"SELECT id, {_RED} AS what, {q.redact('why')} AS why, {q.redact('learned')} AS learned {_LIVE} AND project_id = 'e630ef207ce0' AND id = 'b101b8124c5a80ee'",
    "flt_04_active": f"SELECT project_id, id {_LIVE}",
    "flt_05_categories": f"SELECT project_id, id, category {_LIVE} AND category IN ('decision', 'standard')",
    "flt_07_path_set": f"SELECT id, where_path {_LIVE} AND (contains(lower(where_path), 'cmd/') OR where_path IN ('pkg/avatar/split_merger.ts'))",
    "flt_09_session": f"SELECT project_id, session_id, CAST(row_number() OVER (PARTITION BY project_id, session_id ORDER BY created_at, id) AS INT) AS rank, id {_LIVE} AND session_id IS NOT NULL QUALIFY rank <= 10",
    "flt_10_pinned": f"SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS INT) AS rank, id {_LIVE} AND pinned QUALIFY rank <= 20",
    "flt_11_rolling": f"SELECT id, created_at {_LIVE} AND created_at > {_W60}",
    "flt_12_stale": f"SELECT project_id, id, category {_LIVE} AND NOT coalesce(pinned, false) AND category IN ({q.names(M.TRANSIENT)}) AND coalesce(last_seen_at, created_at) < {q.AS_OF_SQL} - INTERVAL 90 DAY",
    "flt_13_changed": f"SELECT project_id, id {_LIVE} AND (created_at >= {_W60} OR last_seen_at >= {_W60})",
    "flt_17_invalid": f"""SELECT * FROM (SELECT project_id, id, concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(id, '^[A-Za-z0-9_-]{{1,64}}$'), false) THEN 'unsafe id' END, CASE WHEN coalesce({q.trim('what')}, '') = '' THEN 'no title' END,
        CASE WHEN strlen(what) > 60 THEN 'what too long' END, CASE WHEN strlen(why) > 200 THEN 'why too long' END, CASE WHEN strlen(topic_key) > 40 THEN 'topic_key too long' END) AS problems FROM memories) WHERE problems <> ''""",
    "flt_20_prompts": "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank, id, content, created_at FROM user_prompts QUALIFY rank <= 5",
    "flt_20_session_prompts": "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank, id FROM user_prompts WHERE session_id = (SELECT min(session_id) FROM user_prompts) QUALIFY rank <= 3",
    "flt_22_relations": f"SELECT * FROM {_ENDS} WHERE memory_id IS NOT NULL",
    "flt_23_compare": """WITH p AS (SELECT DISTINCT project_id, source_id AS a, target_id AS b FROM memory_relations WHERE source_id <> target_id),
        r AS (SELECT project_id, source_id AS a, target_id AS b, min(relation_type) AS relation_type FROM memory_relations GROUP BY ALL)
        SELECT p.project_id, p.a, p.b, unnest(['category', 'what', 'why', 'where_path', 'learned']) AS field_name, unnest([x.category, x.what, x.why, x.where_path, x.learned]) AS value_a, unnest([y.category, y.what, y.why, y.where_path, y.learned]) AS value_b, relation_type
        FROM p JOIN memories x ON x.project_id = p.project_id AND x.id = p.a JOIN memories y ON y.project_id = p.project_id AND y.id = p.b LEFT JOIN r ON r.project_id = p.project_id AND r.a = p.a AND r.b = p.b""",
    "agg_01_stats": f"""SELECT p.id AS project_id, coalesce(memories, 0) AS memories, coalesce(deleted, 0) AS deleted, coalesce(recent_24h, 0) AS recent_24h, coalesce(sessions, 0) AS sessions, coalesce(active_sessions, 0) AS active_sessions, coalesce(relations, 0) AS relations, coalesce(prompts, 0) AS prompts FROM projects p
        LEFT JOIN {_counts('memories', f"count(*) FILTER (deleted_at IS NULL) AS memories, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, count(*) FILTER (deleted_at IS NULL AND created_at > {q.AS_OF_SQL} - INTERVAL 1 DAY) AS recent_24h")} m ON m.project_id = p.id
        LEFT JOIN {_counts('sessions', "count(*) AS sessions, count(*) FILTER (status = 'active') AS active_sessions")} s ON s.project_id = p.id LEFT JOIN {_counts('memory_relations', 'count(*) AS relations')} r ON r.project_id = p.id LEFT JOIN {_counts('user_prompts', 'count(*) AS prompts')} u ON u.project_id = p.id""",
    "agg_02_categories": f"SELECT project_id, category, count(*) AS n {_LIVE} GROUP BY ALL",
    "agg_03_conflict_states": f"SELECT p.id AS project_id, v.status, count(r.id) AS n FROM projects p CROSS JOIN (SELECT unnest([{q.names(M.RELATION_STATES)}]) AS status) v LEFT JOIN memory_relations r ON r.project_id = p.id AND r.status = v.status AND r.relation_type = 'conflicts_with' GROUP BY ALL",
    "agg_05_busy_topics": f"SELECT project_id, topic_key, count(*) AS n {_LIVE} AND topic_key <> '' GROUP BY ALL HAVING count(*) > 1 AND max(created_at) > {_W60}",
    "agg_08_relation_counts": f"SELECT project_id, memory_id, count(*) AS n FROM {_ENDS} WHERE memory_id IS NOT NULL GROUP BY ALL",
    "agg_19_projects": "SELECT p.id, name, path, (SELECT count(*) FROM memories m WHERE m.project_id = p.id AND deleted_at IS NULL) AS memories, (SELECT count(*) FROM sessions s WHERE s.project_id = p.id) AS sessions FROM projects p",
    "win_01_latest_topic": f"SELECT project_id, topic_key, id {_LIVE} AND topic_key <> '' QUALIFY row_number() OVER (PARTITION BY project_id, topic_key ORDER BY created_at DESC NULLS LAST, id) = 1",
    "win_02_sessions": f"""SELECT project_id, arg_max(id, (coalesce(started_at, TIMESTAMPTZ '1900-01-01'), id)) FILTER ({_STATE} = 'active') AS active_id, arg_max(id, (coalesce(ended_at, TIMESTAMPTZ '1900-01-01'), id)) FILTER ({_STATE} = 'completed') AS last_id FROM sessions GROUP BY 1""",
    "win_03_timeline": f"""WITH a AS (SELECT project_id, arg_min(id, (length(what), id)) AS anchor_id FROM memories GROUP BY 1), t AS (SELECT a.*, created_at AS t0 FROM a JOIN memories m ON m.project_id = a.project_id AND m.id = a.anchor_id),
        n AS (SELECT t.*, m.id, {q.redact('m.what')} AS what, m.created_at FROM t JOIN memories m ON m.project_id = t.project_id AND m.deleted_at IS NULL)
        SELECT project_id, anchor_id, id, what, created_at, CAST(-row_number() OVER (PARTITION BY project_id, anchor_id ORDER BY created_at DESC, id DESC) AS INT) AS position FROM n WHERE created_at < t0 QUALIFY position >= -3
        UNION ALL SELECT project_id, anchor_id, id, what, created_at, CAST(row_number() OVER (PARTITION BY project_id, anchor_id ORDER BY created_at, id) AS INT) AS position FROM n WHERE created_at > t0 QUALIFY position <= 3""",
    "win_04_bundle": _bundle(False),
    "win_04_bundle_goal": _bundle(True),
    "srt_04_review": f"""WITH d AS (SELECT *, coalesce({q.age_days('created_at')}, 0) AS age_days, coalesce({q.age_days('last_seen_at')}, 0) AS seen_days, coalesce({q.age_days('review_after')}, 0) AS over, coalesce(review_after < {q.AS_OF_SQL}, false) AS needs_review {_LIVE}),
        r AS (SELECT *, concat_ws('; ', CASE WHEN needs_review THEN CASE WHEN over > 0 THEN 'due for review (policy, ' || over || ' days overdue)' ELSE 'due for review (policy)' END END, CASE WHEN age_days > 30 THEN 'old (' || age_days || ' days)' END,
          CASE WHEN seen_days > 60 THEN 'stale (last seen ' || seen_days || ' days ago)' END, CASE WHEN duplicate_count > 3 THEN 'high duplicates (' || duplicate_count || ')' END, CASE WHEN revision_count > 5 THEN 'many revisions (' || revision_count || ')' END) AS rs FROM d),
        t AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rs <> '' DESC, needs_review DESC, age_days DESC, created_at DESC NULLS LAST, id) AS INT) AS rank FROM r QUALIFY rank <= 10),
        c AS (SELECT project_id, memory_id AS id, count(*) AS n FROM {_ENDS} WHERE memory_id IS NOT NULL GROUP BY ALL)
        SELECT t.project_id, rank, t.id, age_days, seen_days, needs_review, CASE WHEN rs = '' THEN 'recent and healthy' ELSE rs END AS reason, coalesce(n, 0) AS relation_count FROM t LEFT JOIN c ON c.project_id = t.project_id AND c.id = t.id""",
    "join_05_conflicts": "SELECT r.project_id, r.id, source_id, target_id, status, score, a.what AS source_what, b.what AS target_what, r.created_at FROM memory_relations r LEFT JOIN memories a ON a.id = source_id LEFT JOIN memories b ON b.id = target_id WHERE relation_type = 'conflicts_with'",
    "join_12_code_links": f"WITH {PLACED} SELECT m.project_id, m.id AS memory_id, n.id AS node_id, concat_ws('-', m.id, n.id, 'rationale_for') AS edge_id FROM (SELECT project_id, id, {q.node_path('where_path')} AS p FROM pm WHERE deleted_at IS NULL) m JOIN (SELECT DISTINCT project_id, id FROM graph_nodes WHERE id = path) n ON n.project_id = m.project_id AND n.id = m.p WHERE p <> ''",
    "join_21_stale_bindings": f"WITH {PLACED}, pp AS (SELECT project_id, id, {q.node_path('where_path')} AS w FROM pm WHERE deleted_at IS NULL AND where_path <> ''), p AS (SELECT project_id, id, {q.trim('unnest(string_split(w, $$,$$))')} AS path FROM pp) SELECT DISTINCT project_id, id FROM p WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.project_id = p.project_id AND n.path = p.path AND node_type IN ('file', 'document'))",
    "dml_08_session_guard": "SELECT project_id, id FROM sessions s WHERE EXISTS (SELECT 1 FROM memories m WHERE m.project_id = s.project_id AND m.session_id = s.id)",
}
