"""Problem 6: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knowloom.operators.references import broken_references, reference_report
from knowloom.tables import table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(*(table(spark, d, t) for t in ("graph_edges", "graph_nodes", "memory_relations", "memories")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).drop("created_at")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return reference_report(_broken(spark, d))


_FOUND = r"""
WITH ends AS (
  SELECT project_id, id AS row_id, 'source_id' AS field_name, source_id AS k FROM graph_edges
  UNION ALL SELECT project_id, id, 'target_id', target_id FROM graph_edges),
edges AS (
  SELECT DISTINCT 'graph_edges' AS tbl, e.project_id, row_id, field_name, 'missing' AS kind, CAST(NULL AS TIMESTAMPTZ) AS created_at
  FROM ends e WHERE regexp_matches(k, '[^\s]')
    AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.project_id = e.project_id AND n.id = e.k)),
rel AS (
  SELECT 'memory_relations' AS tbl, r.project_id, r.id AS row_id, 'target_id' AS field_name,
    CASE WHEN m.id IS NULL THEN 'missing' WHEN m.deleted_at IS NOT NULL THEN 'deleted' WHEN m.created_at > r.created_at THEN 'late' END AS kind,
    r.created_at
  FROM memory_relations r LEFT JOIN memories m ON m.project_id = r.project_id AND m.id = r.target_id
  WHERE regexp_matches(r.target_id, '[^\s]')),
broken AS (SELECT * FROM edges UNION ALL SELECT DISTINCT * FROM rel WHERE kind IS NOT NULL)
"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": _FOUND + "SELECT tbl, project_id, row_id, field_name, kind FROM broken",
    "p6_report": _FOUND + "SELECT tbl, field_name, kind, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS n_rows FROM broken GROUP BY ALL",
}
