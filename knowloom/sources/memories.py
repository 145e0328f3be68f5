"""Importing memories from JSON files and change documents from Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.functions import text
from knowloom.operators import lifecycle
from knowloom.tables import MEMORIES

SAFE_ID = r"^[A-Za-z0-9_-]{1,64}$"
_TEXTS = ("category", "what", "why", "where_path", "learned", "git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps", "session_id", "topic_key")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One file with an array of memories; a row that does not fit fails the read."""
    return spark.read.schema(MEMORIES).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, broken) from a folder with one JSON file a memory; files that do not parse come out apart with their name."""
    return _parsed(spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).withColumn("_file", F.input_file_name()))


def _parsed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, broken) of JSON objects (_file, value)."""
    schema = T.StructType([*MEMORIES.fields, T.StructField("_corrupt", T.StringType())])
    rows = texts.select("_file", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    good = rows.where("m IS NOT NULL AND m._corrupt IS NULL").select("m.*").drop("_corrupt")
    return good, rows.where("m IS NULL OR m._corrupt IS NOT NULL").select("_file", F.col("m._corrupt").alias("_corrupt"))


def read_synced(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(memories, broken) of a synced folder: its chunks if there are any, else the one file with all memories, whose unfit rows come out as broken."""
    chunks, whole = f"{root.rstrip('/')}/chunks", f"{root.rstrip('/')}/memories.json"
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda p: fs(p).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if there(chunks):
        return read_chunks(spark, chunks)
    if not there(whole):
        return spark.createDataFrame([], MEMORIES), spark.createDataFrame([], "_file string, _corrupt string")
    each = spark.read.option("wholetext", True).text(whole).select(F.lit(whole).alias("_file"), F.explode(F.from_json("value", "array<string>")).alias("value"))
    return _parsed(each)


def import_memories(current: DataFrame, incoming: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, refused, diverging): incoming rows bound to a project, redacted and put in place of those with the same id.

    Rows with unsafe ids are refused. Diverging are those whose revision is lower or whose content differs at the same revision; they win all the same.
    """
    rows = incoming.withColumn("project_id", F.lit(project_id)).withColumns({c: text.redact(F.col(c)) for c in _TEXTS})
    safe = F.coalesce(F.col("id").rlike(SAFE_ID), F.lit(False))
    ok = rows.where(safe)
    mine = current.select("id", F.col("revision_count").alias("_rev"), F.col("normalized_hash").alias("_hash"))
    both = ok.join(mine, "id")
    older = F.coalesce("revision_count", F.lit(0)) < F.coalesce("_rev", F.lit(0))
    split = (F.coalesce("revision_count", F.lit(0)) == F.coalesce("_rev", F.lit(0))) & ~F.equal_null("normalized_hash", "_hash")
    diverging = both.where(older | split).select("id", F.when(older, "older revision").otherwise("other content").alias("reason"))
    return lifecycle.upsert(current, ok, ["id"]), rows.where(~safe).select("id"), diverging


_HEAD = re.compile(r"^#\s*(?:Change:\s*)?(.*)$")
_META = re.compile(r"^[-*]?\s*\*\*(Status|Slug|Where|Capability):?\*\*:?\s*`?(.*?)`?\s*$", re.I)


def parse_change(content: str) -> dict[str, str]:
    """Fields of a change document: title, status, slug, where_path, capability_path, and the sections What, Goal, Design and Tasks."""
    out: dict[str, str] = {}
    section, lines = "", []

    def close() -> None:
        if section in ("what", "goal", "design", "tasks"):
            out[section] = "\n".join(lines).strip()

    for line in content.split("\n"):
        if line.startswith("## "):
            close()
            section, lines = line[3:].strip().lower(), []
        elif line.startswith("# ") and "title" not in out:
            out["title"] = _HEAD.match(line)[1].strip()
        elif not section and (m := _META.match(line.strip())):
            key = {"where": "where_path", "capability": "capability_path"}.get(m[1].lower(), m[1].lower())
            out[key] = m[2].strip()
        else:
            lines.append(line)
    close()
    return out


def parse_changes(pages: DataFrame) -> DataFrame:
    """The fields of change documents (project_id, path, content) as rows: project_id, path and those of :func:`parse_change`, null where a document has none."""
    names = ("title", "status", "slug", "where_path", "capability_path", "what", "goal", "design", "tasks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_change(c or "") for c in b["content"]]
            yield pd.DataFrame({"project_id": b["project_id"], "path": b["path"], **{n: [p.get(n) for p in parsed] for n in names}})

    return pages.select("project_id", "path", "content").mapInPandas(run, "project_id string, path string, " + ", ".join(f"{n} string" for n in names))


def overlay(old: Column, new: Column) -> Column:
    """A parsed value where it is filled and differs, else what was there."""
    return F.coalesce(F.nullif(text.redact(new), F.lit("")), old)


@dataclass
class Settings:
    """Defaults of the engine; a project's values win over global ones."""

    conflict_threshold: float = 0.45
    default_review_limit: int = 10
    compaction_interval_minutes: int = 60
    max_response_tokens: int = 4000
    max_field_chars: int = 1000
    search_expand_chars: int = 300
    timeline_why_chars: int = 200
    bundle_why_chars: int = 300
    context_pack_max_memories: int = 5
    graph_boost: bool = True
    prune_stale_days: int = 90
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def layered(cls, *layers: dict) -> Settings:
        """Later layers win; values that do not convert keep what was there, unknown keys go to ``extra``."""
        out = cls()
        for layer in layers:
            for k, v in layer.items():
                if k in cls.__dataclass_fields__ and k != "extra":
                    kind = type(getattr(out, k))
                    try:
                        setattr(out, k, str(v).lower() in ("1", "true", "yes") if kind is bool else kind(v))
                    except (TypeError, ValueError):
                        continue
                else:
                    out.extra[k] = str(v)
        return out


def parse_flat_yaml(content: str) -> dict[str, str]:
    """``key: value`` lines of a configuration file; comments and nesting aside."""
    rows = (re.match(r"^([A-Za-z_]\w*)\s*:\s*(.*?)\s*(?:#.*)?$", x) for x in content.split("\n"))
    return {m[1]: m[2].strip("'\"") for m in rows if m and m[2]}


def project_id(path: str) -> str:
    """A project's id from the path of its root."""
    import hashlib

    return hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:12]


