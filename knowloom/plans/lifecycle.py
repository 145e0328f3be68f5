"""Saves, compaction, pruning and deletion over the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.operators import lifecycle as L
from knowloom.operators.memory import busy_topics
from knowloom.plans import sqltext as q
from knowloom.plans.functions import NOW
from knowloom.plans.memory import WEEK_AGO
from knowloom.tables import table


def _mem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories")


def _late(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Saves of the last 60 days against the store as it was before them."""
    m = _mem(s, d)
    return m.where(F.col("created_at") >= F.lit(WEEK_AGO)), m.where(F.col("created_at") < F.lit(WEEK_AGO))


def compaction(s: SparkSession, d: str) -> DataFrame:
    cols = ["project_id", "topic_key", "category", "what", "why", "learned", "where_path", "author", "session_id", "revision_count", "duplicate_count", "normalized_hash"]
    return L.compact(_mem(s, d)).select(*cols)


def soft_deleted(s: SparkSession, d: str) -> DataFrame:
    _, kept = L.soft_delete(_mem(s, d), table(s, d, "memory_relations"), _mem(s, d).where("category = 'journal'"), NOW)
    return kept.select("project_id", "id")


def judged(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "memory_relations")
    return L.judge(r.limit(0), r, _mem(s, d)).select("project_id", "source_id", "target_id", "relation_type", "id")


QUERIES = {
    "dml_01_classify": lambda s, d: L.classify(*_late(s, d), WEEK_AGO),
    "dml_02_topic_versions": lambda s, d: L.topic_versions(_mem(s, d)),
    "dml_03_repeats_24h": lambda s, d: L.repeated_saves(_mem(s, d)),
    "dml_07_soft_delete": soft_deleted,
    "dml_09_judge": judged,
    "dml_13_prune": lambda s, d: L.prune(_mem(s, d), NOW, 200).select("project_id", "id"),
    "dml_14_compact": compaction,
    "dml_15_empty_projects": lambda s, d: L.empty_projects(table(s, d, "projects"), _mem(s, d).where("category = 'idea'")).select("id"),
    "str_02_busy_topics": lambda s, d: busy_topics(_mem(s, d), newer_than=WEEK_AGO),
    "snk_11_latest": lambda s, d: L.latest(table(s, d, "memory_relations"), ["project_id", "source_id", "target_id"], [F.col("created_at"), F.col("id")]).select("project_id", "source_id", "target_id", "id"),
}

_HASH = "sha256(coalesce(what, '') || chr(0) || coalesce(why, '') || chr(0) || coalesce(learned, '') || chr(0) || coalesce(where_path, ''))"
_W60 = f"{q.AS_OF_SQL} - INTERVAL 60 DAY"
_LIVE = "FROM memories WHERE deleted_at IS NULL"


def _fold(c: str) -> str:
    return f"""{c}p AS (SELECT project_id, topic_key, created_at, id, {q.trim('p')} AS part, pos FROM (SELECT project_id, topic_key, created_at, id, unnest(string_split({c}, ' | ')) AS p, unnest(range(len(string_split({c}, ' | ')))) AS pos FROM r)),
        {c}f AS (SELECT project_id, topic_key, part, min({{'a': created_at, 'b': id, 'c': pos}}) AS fst FROM {c}p WHERE part <> '' GROUP BY ALL), {c}j AS (SELECT project_id, topic_key, string_agg(part, ' | ' ORDER BY fst) AS {c} FROM {c}f GROUP BY ALL)"""


_WHY, _LEARNED = _fold("why"), _fold("learned")

SQL = {
    "dml_01_classify": f"""WITH inc AS (SELECT *, {_HASH} AS h FROM memories WHERE created_at >= {_W60}), cur AS (SELECT *, {_HASH} AS h FROM memories WHERE created_at < {_W60} AND deleted_at IS NULL),
        t AS (SELECT project_id, topic_key, id AS topic_id, revision_count AS rev FROM cur WHERE topic_key <> '' QUALIFY row_number() OVER (PARTITION BY project_id, topic_key ORDER BY created_at DESC, id) = 1),
        p AS (SELECT project_id, category, h, arg_min(id, (created_at, id)) AS repeat_id FROM cur WHERE created_at > {_W60} - INTERVAL 1 DAY GROUP BY ALL),
        x AS (SELECT inc.project_id, inc.id, topic_id, repeat_id, rev, CASE WHEN inc.topic_key <> '' AND topic_id IS NOT NULL THEN 'upsert' WHEN coalesce(inc.topic_key, '') = '' AND repeat_id IS NOT NULL THEN 'bump' ELSE 'insert' END AS action
          FROM inc LEFT JOIN t ON t.project_id = inc.project_id AND t.topic_key = inc.topic_key LEFT JOIN p ON p.project_id = inc.project_id AND p.category = inc.category AND p.h = inc.h)
        SELECT project_id, id, action, CASE action WHEN 'upsert' THEN topic_id WHEN 'bump' THEN repeat_id ELSE id END AS target_id, CASE WHEN action = 'upsert' THEN coalesce(rev, 0) + 1 END AS revision FROM x""",
    "dml_02_topic_versions": f"""SELECT project_id, id, CASE WHEN revision = 1 THEN 'insert' ELSE 'upsert' END AS action, revision, target_id FROM (SELECT project_id, id, CAST(row_number() OVER w AS INT) AS revision, first_value(id) OVER w AS target_id {_LIVE} AND topic_key <> '' WINDOW w AS (PARTITION BY project_id, topic_key ORDER BY created_at, id))""",
    "dml_03_repeats_24h": f"""WITH RECURSIVE s AS (SELECT project_id, id, coalesce(category, '?') AS category, {_HASH} AS h, created_at {_LIVE} AND coalesce(topic_key, '') = '' AND created_at IS NOT NULL),
        a AS (SELECT project_id, category, h, min({{'t': created_at, 'i': id}}) AS f FROM s GROUP BY ALL UNION ALL
          SELECT project_id, category, h, f FROM (SELECT a.project_id, a.category, a.h, min({{'t': s.created_at, 'i': s.id}}) AS f FROM a JOIN s ON s.project_id = a.project_id AND s.category = a.category AND s.h = a.h AND s.created_at >= a.f.t + INTERVAL 24 HOUR GROUP BY ALL)),
        m AS (SELECT s.project_id, s.id, max({{'t': f.t, 'i': f.i}}) AS f FROM s JOIN a ON a.project_id = s.project_id AND a.category = s.category AND a.h = s.h AND (a.f.t < s.created_at OR (a.f.t = s.created_at AND a.f.i <= s.id)) GROUP BY ALL)
        SELECT project_id, id, CASE WHEN id = f.i THEN 'insert' ELSE 'bump' END AS action, f.i AS target_id FROM m""",
    "dml_07_soft_delete": "SELECT project_id, id FROM memory_relations r WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.category = 'journal' AND m.project_id = r.project_id AND m.id IN (r.source_id, r.target_id))",
    "dml_09_judge": "SELECT project_id, source_id, target_id, relation_type, arg_max(id, (created_at, id)) AS id FROM memory_relations r WHERE source_id <> target_id AND EXISTS (SELECT 1 FROM memories m WHERE m.deleted_at IS NULL AND m.project_id = r.project_id AND m.id = r.source_id) AND EXISTS (SELECT 1 FROM memories m WHERE m.deleted_at IS NULL AND m.project_id = r.project_id AND m.id = r.target_id) GROUP BY ALL",
    "dml_13_prune": f"SELECT project_id, id {_LIVE} AND NOT coalesce(pinned, false) AND category IN ('journal', 'qa', 'discussion', 'idea') AND coalesce(last_seen_at, created_at) < {q.AS_OF_SQL} - INTERVAL 200 DAY",
    "dml_14_compact": f"""WITH r AS (SELECT * {_LIVE} AND topic_key <> '' QUALIFY count(*) OVER (PARTITION BY project_id, topic_key) > 1), {_WHY}, {_LEARNED},
        g AS (SELECT project_id, topic_key, arg_max({{'a': category, 'b': what, 'c': where_path}}, (created_at, id)) AS l, coalesce(arg_max({{'a': author, 'b': session_id}}, (created_at, id)) FILTER (session_id <> ''), arg_max({{'a': author, 'b': session_id}}, (created_at, id))) AS m,
          coalesce(max(revision_count), 0) + count(*) AS revision_count, count(*) AS duplicate_count FROM r GROUP BY ALL),
        o AS (SELECT g.project_id, g.topic_key, l.a AS category, l.b AS what, coalesce(why, '') AS why, coalesce(learned, '') AS learned, l.c AS where_path, m.a AS author, m.b AS session_id, CAST(revision_count AS BIGINT) AS revision_count, duplicate_count
          FROM g LEFT JOIN whyj w ON w.project_id = g.project_id AND w.topic_key = g.topic_key LEFT JOIN learnedj j ON j.project_id = g.project_id AND j.topic_key = g.topic_key)
        SELECT *, {_HASH} AS normalized_hash FROM o""",
    "dml_15_empty_projects": "SELECT id FROM projects p WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.project_id = p.id AND deleted_at IS NULL AND category = 'idea')",
    "str_02_busy_topics": f"SELECT project_id, topic_key, count(*) AS n, max(created_at) AS newest {_LIVE} AND topic_key <> '' GROUP BY ALL HAVING count(*) > 1 AND max(created_at) > {_W60}",
    "snk_11_latest": "SELECT project_id, source_id, target_id, arg_max(id, (created_at, id)) AS id FROM memory_relations GROUP BY ALL",
}
