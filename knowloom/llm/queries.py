"""Registered queries of the operators for language-model data, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.llm.components import connected_groups, relation_links
from knowloom.llm.copies import PART, copy_groups
from knowloom.llm.mixing import mix, share_report
from knowloom.llm.neardup import near_classes, near_groups, near_pairs
from knowloom.llm.packing import fill_report, pack
from knowloom.llm.pii import mentions, redacted, text_fields
from knowloom.llm.reading import level_profile, reading_levels
from knowloom.llm.survivorship import OPTIONAL_FIELDS, STAND_INS, best_members, memory_claims, surviving_records, truth_model
from knowloom.llm.tokens import sized
from knowloom.runtime import cut
from knowloom.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links = relation_links(table(spark, d, "memory_relations"), table(spark, d, "memories"))
    return connected_groups(links).select(F.col("id").alias("memory_id"), "group_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    memories = text_fields(table(spark, d, "memories"), "memories", "id", ["learned", "errors_faced"])
    return memories.unionByName(text_fields(table(spark, d, "user_prompts"), "user_prompts", "id", ["content"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mentions(_texts(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return best_members(table(spark, d, "memories"))


def p3_truth(spark: SparkSession, d: str) -> DataFrame:
    return truth_model(memory_claims(table(spark, d, "memories")))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The strict choice of each field with its posterior, and the other values that the model retains."""
    return surviving_records(table(spark, d, "memories"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_groups(table(spark, d, "memories")).where("n_copies > 1").select(F.col("key").alias("memory_id"), "group_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record each, the least id of its copies, with the number of copies."""
    return copy_groups(table(spark, d, "memories")).where("key = group_id").select(F.col("key").alias("memory_id"), "n_copies")


#: Similarity that TESTDATA.md states for problem 5.
NEAR = 0.7


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(*near_classes(table(spark, d, "memories"), t=NEAR))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(*near_classes(table(spark, d, "memories"), t=NEAR))


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["container"], r["capacity_tokens"]) for r in table(spark, d, "pack_limits").orderBy("container").collect()]


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(cut(sized(table(spark, d, "documents")), "sizes"), _containers(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_pack(spark, d), _containers(spark, d))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    rows = table(spark, d, "mix_targets").orderBy("source").collect()
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in rows]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(cut(sized(table(spark, d, "documents"), "source"), "sizes"), _targets(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p8_mix(spark, d), _targets(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    return level_profile(p9_found(spark, d), table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_truth": p3_truth,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}

_P1 = r"""
WITH RECURSIVE l AS (
  SELECT DISTINCT source_id AS a, target_id AS b FROM memory_relations r
  WHERE regexp_replace(lower(relation_type), '[\s\xA0_-]+', '', 'g') IN ('relatesto', 'supersedes') AND source_id <> target_id
    AND EXISTS (SELECT 1 FROM memories m WHERE m.project_id = r.project_id AND m.id = r.source_id)
    AND EXISTS (SELECT 1 FROM memories m WHERE m.project_id = r.project_id AND m.id = r.target_id)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(v, w) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON r.w = e.a)
SELECT v AS memory_id, min(w) AS group_id FROM reach GROUP BY v
"""

_STAND_INS = ", ".join(f"'{x}'" for x in STAND_INS)


def _is_filled(c: str) -> str:
    bare = rf"regexp_replace(lower({c}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
    return f"({c} IS NOT NULL AND {bare} <> '' AND {bare} NOT IN ({_STAND_INS}))"


_P3 = r"""
WITH k AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(topic_key), '[\s\xA0\x{2000}-\x{200A}\x{202F}_-]+', '-', 'g'), '-?/-?', '/', 'g'), '^-|-$', '', 'g') AS tk
  FROM memories WHERE deleted_at IS NULL),
g AS (SELECT *, count(*) OVER (PARTITION BY project_id, tk) AS n FROM k WHERE tk <> ''),
c AS (
""" + "\n  UNION ALL ".join(f"SELECT project_id, tk, '{f}' AS field_name, id, revision_count, last_seen_at FROM g WHERE n > 1 AND {w}" for f, w in [("record", "true"), *[(f, _is_filled(f)) for f in OPTIONAL_FIELDS]]) + r""")
SELECT project_id, tk AS topic_key, field_name, id AS memory_id FROM c
QUALIFY row_number() OVER (PARTITION BY project_id, tk, field_name ORDER BY revision_count DESC NULLS LAST, last_seen_at DESC NULLS LAST, id) = 1
"""


def _letters(c: str) -> str:
    return rf"replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss')"


def _canonical(c: str) -> str:
    parts = rf"list_transform(string_split(regexp_replace(coalesce({c}, ''), '{PART}', chr(1) || '\2', 'g'), chr(1)), lambda x: {_letters('x')})"
    return f"(CASE WHEN len({parts}) > 2 AND {parts}[1] = '' THEN array_to_string(list_sort({parts}), chr(1)) ELSE {_letters(f'coalesce({c}, {chr(39)*2})')} END)"


_P4 = rf"""
WITH c AS (SELECT id, project_id, {_canonical('what')} AS a, {_canonical('why')} AS b FROM memories),
g AS (SELECT id, min(id) OVER w AS group_id, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY project_id, least(a, b), greatest(a, b)))
"""

_P5 = r"""
WITH w AS (SELECT DISTINCT id, project_id, unnest(regexp_extract_all(lower(concat_ws(' ', what, why, learned)), '[\p{L}\p{N}]+')) AS word FROM memories),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.project_id = b.project_id AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / (x.n + y.n - k) >= 0.7
"""

_P5_GROUPS = r"""
WITH RECURSIVE m AS (SELECT id, project_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', what, why, learned)), '[\p{L}\p{N}]+'))) AS words FROM memories),
c AS (SELECT id, project_id, words, CASE WHEN len(words) = 0 THEN id ELSE min(id) OVER (PARTITION BY project_id, words) END AS class_id FROM m),
w AS (SELECT class_id, project_id, unnest(words) AS word FROM c WHERE id = class_id),
n AS (SELECT class_id, len(words) AS n FROM c WHERE id = class_id),
s AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.project_id = b.project_id AND a.class_id <> b.class_id GROUP BY ALL),
e AS (SELECT x, y FROM s JOIN n u ON u.class_id = x JOIN n v ON v.class_id = y WHERE k / (u.n + v.n - k) >= 0.7),
reach(v, w) AS (SELECT class_id, class_id FROM n UNION SELECT r.v, e.y FROM reach r JOIN e ON r.w = e.x),
g AS (SELECT v, min(w) AS group_id FROM reach GROUP BY v), l AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT id, c.class_id, group_id, coalesce(l.k, 0) AS n_links FROM c JOIN g ON g.v = c.class_id LEFT JOIN l ON l.x = c.class_id
"""

SQL = {
    "p5_found": _P5,
    "p5_groups": _P5_GROUPS,
    "p1_found": _P1,
    "p3_found": _P3,
    "p4_found": _P4 + "SELECT id AS memory_id, group_id FROM g WHERE n > 1",
    "p4_records": _P4 + "SELECT id AS memory_id, CAST(n AS BIGINT) AS n_copies FROM g WHERE id = group_id",
}
