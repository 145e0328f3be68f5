"""Sessions and captured prompts as data flow: requests of any number are rows, tables come back whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators import lifecycle
from knowloom.operators.memory import session_links
from knowloom.tables import MEMORIES, SESSIONS, USER_PROMPTS, conform

KEY = ["project_id", "id"]
#: The lines of a session summary and the fields they come from.
SUMMARY = (("Goal", "goal"), ("Discoveries", "discoveries"), ("Accomplished", "accomplished"), ("Next Steps", "next_steps"), ("Files", "files"))


def start_sessions(sessions: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """``sessions`` with an active one for each request (project_id, goal, directory[, id]); without an id it follows from the request."""
    own = F.col("id") if "id" in requests.columns else F.lit(None).cast("string")
    made = scalar.new_id(F.col("project_id"), F.coalesce("goal", F.lit("")), F.coalesce("directory", F.lit("")), F.lit(as_of).cast("string"))
    rows = requests.select("project_id", F.coalesce(own, made).alias("id"), "goal", "directory", F.lit("active").alias("status"), F.lit(as_of).alias("started_at"))
    return lifecycle.insert_or_ignore(sessions, conform(rows, SESSIONS), KEY)


def end_sessions(sessions: DataFrame, ends: DataFrame, as_of: datetime) -> DataFrame:
    """``sessions`` with those of ``ends`` (project_id, id, summary) completed; only active ones end, summaries are redacted."""
    asked = lifecycle.latest(ends.select(*KEY, "summary"), KEY, [F.col("summary")])
    rows = sessions.join(asked.select(*KEY, F.col("summary").alias("_summary"), F.lit(True).alias("_hit")), KEY, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lower(text.trim_space(F.col("status"))) == "active")
    sets = {"status": F.lit("completed"), "ended_at": F.lit(as_of), "summary": text.redact(F.col("_summary"))}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in sets.items()}).select(*sessions.columns)


def summarise_sessions(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """``sessions`` with goal and summary of ``reports`` (project_id, id, goal, discoveries, accomplished, next_steps, files), redacted."""
    clean: dict[str, Column] = {f: text.redact(F.coalesce(f, F.lit(""))) for _, f in SUMMARY}
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), clean[f]) for name, f in SUMMARY])
    new = lifecycle.latest(reports.select(*KEY, clean["goal"].alias("_goal"), lines.alias("_summary")), KEY, [F.col("_summary")])
    rows = sessions.join(new, KEY, "left")
    hit = F.col("_summary").isNotNull()
    return rows.withColumns({"goal": F.when(hit, F.col("_goal")).otherwise(F.col("goal")), "summary": F.coalesce("_summary", "summary")}).select(*sessions.columns)


def delete_sessions(sessions: DataFrame, memories: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): ``sessions`` without those of ``keys`` (project_id, id) that no memory names; those that one names are refused and stay."""
    asked = sessions.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    refused = session_links(memories, asked)
    gone = asked.select(*KEY).join(refused.select(*KEY), KEY, "left_anti")
    return sessions.join(gone, KEY, "left_anti"), refused


def capture_prompts(prompts: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """``prompts`` with ``incoming`` (project_id, session_id, content[, id]) added, trimmed and redacted; blank ones are left out."""
    content = text.trim_space(text.redact(F.col("content")))
    own = F.col("id") if "id" in incoming.columns else F.lit(None).cast("string")
    made = scalar.new_id(F.col("project_id"), F.coalesce("session_id", F.lit("")), F.coalesce("content", F.lit("")), F.lit(as_of).cast("string"))
    rows = incoming.select("project_id", F.coalesce(own, made).alias("id"), "session_id", content.alias("content"), F.lit(as_of).alias("created_at")).where("content <> ''")
    return lifecycle.insert_or_ignore(prompts, conform(rows, USER_PROMPTS), KEY)


def capture_passive(memories: DataFrame, notes: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Saves ``notes`` (project_id, what, why, session_id[, id]) as journal memories that learned their own title; see :func:`lifecycle.save`."""
    own = F.col("id") if "id" in notes.columns else F.lit(None).cast("string")
    made = scalar.new_id(F.col("project_id"), F.coalesce("what", F.lit("")), F.coalesce("why", F.lit("")), F.coalesce("session_id", F.lit("")), F.lit(as_of).cast("string"))
    rows = notes.select("project_id", F.coalesce(own, made).alias("id"), F.lit("journal").alias("category"), "what", "why", F.col("what").alias("learned"), "session_id")
    return lifecycle.save(conform(rows, MEMORIES), memories, as_of)
