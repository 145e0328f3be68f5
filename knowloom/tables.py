"""Reading the driver's Parquet tables and the schemas of the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


PROJECTS = _schema(id=_S, name=_S, path=_S, created_at=_TS, last_conflict_scan_at=_TS, last_compaction_at=_TS)
MEMORIES = _schema(
    id=_S, project_id=_S, category=_S, what=_S, why=_S, where_path=_S, learned=_S, git_branch=_S, git_commit=_S, author=_S,
    impact=_S, errors_faced=_S, next_steps=_S, session_id=_S, topic_key=_S, revision_count=_L, duplicate_count=_L,
    normalized_hash=_S, last_seen_at=_TS, review_after=_TS, created_at=_TS, deleted_at=_TS, pinned=_B, change_id=_S,
)
SESSIONS = _schema(id=_S, project_id=_S, goal=_S, directory=_S, summary=_S, status=_S, started_at=_TS, ended_at=_TS)
MEMORY_RELATIONS = _schema(
    id=_S, project_id=_S, source_id=_S, target_id=_S, relation_type=_S, status=_S, score=_D, reason=_S, judged_by=_S, created_at=_TS
)
USER_PROMPTS = _schema(id=_S, project_id=_S, session_id=_S, content=_S, created_at=_TS)
GRAPH_NODES = _schema(project_id=_S, id=_S, node_type=_S, label=_S, path=_S, metadata=_S)
GRAPH_EDGES = _schema(id=_S, project_id=_S, source_id=_S, target_id=_S, relation_type=_S, confidence=_S, source_location=_S)
DOCUMENTS = _schema(
    doc_id=_L, title=_S, text=_S, lang=_S, source=_S, kind=_S, project_id=_S, created_at=_TS, n_chars=_L
)

SCHEMAS = {
    "projects": PROJECTS, "memories": MEMORIES, "sessions": SESSIONS, "memory_relations": MEMORY_RELATIONS,
    "user_prompts": USER_PROMPTS, "graph_nodes": GRAPH_NODES, "graph_edges": GRAPH_EDGES, "documents": DOCUMENTS,
}


CHANGES = _schema(
    id=_S, project_id=_S, slug=_S, status=_S, title=_S, what=_S, goal=_S, where_path=_S, capability_path=_S, design=_S, tasks=_S, created_at=_TS, updated_at=_TS, archived_at=_TS
)
SCHEMAS["changes"] = CHANGES


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing ones are null, others are dropped, types are cast; how an older table is read."""
    have = {f.name for f in df.schema.fields}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def schema_report(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, problem) for tables and columns that are missing or of another type than expected."""
    out = []
    for name, schema in SCHEMAS.items():
        if name not in frames:
            out.append((name, "", "missing table"))
            continue
        have = {f.name: f.dataType for f in frames[name].schema.fields}
        out += [(name, f.name, "missing column" if f.name not in have else f"is {have[f.name].simpleString()}") for f in schema.fields if have.get(f.name) != f.dataType]
    return out


#: The columns by which a table's rows are told apart, in the tables as the domain keeps them.
KEYS = {
    "projects": ("id",), "memories": ("id",), "sessions": ("id",), "memory_relations": ("id",), "user_prompts": ("id",), "graph_nodes": ("project_id", "id"), "graph_edges": ("project_id", "id"),
    "documents": ("doc_id",), "changes": ("id",),
}


def key_report(frames: dict[str, DataFrame]) -> list[tuple[str, int, int]]:
    """(table, rows with a null in the key, keys that occur more than once) of each known table: what a table with a primary key would refuse."""
    out = []
    for name, df in frames.items():
        if name in KEYS:
            keys = list(KEYS[name])
            nulls = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
            by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            r = by.agg(F.coalesce(F.sum(F.when(nulls, F.col("_n"))), F.lit(0)), F.count_if((F.col("_n") > 1) & ~nulls)).first()
            out.append((name, r[0], r[1]))
    return out


def rebuilt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An older table's rows under a new key: the first row of each by ``order`` stays, rows with a null in the key go."""
    rest = [c for c in df.columns if c not in keys]
    first = df.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, F.to_json(F.struct(*rest)))).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only the columns and row groups a query needs are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
