"""Ranking and judging by an outside agent, given as a callable; every failure leaves the deterministic result standing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import scalar
from knowloom.functions.text import truncate

Agent = Callable[[str], str]
MOST_CANDIDATES = 30
VERDICTS = ("relates_to", "supersedes", "conflicts_with", "not_conflict")


def carve(text: str, opening: str = "{") -> object | None:
    """The JSON value within an answer, from the first opening to the last closing bracket; None where there is none."""
    closing = {"{": "}", "[": "]"}[opening]
    a, b = text.find(opening), text.rfind(closing)
    if a < 0 or b < a:
        return None
    try:
        return json.loads(text[a : b + 1])
    except ValueError:
        return None


def recall(candidates: DataFrame, question: str, agent: Agent | None, limit: int = 10) -> tuple[list[dict], bool]:
    """(rows, whether the agent ranked them): at most 30 candidates (id, what, why) go to the agent in one question.

    Its answer is a list of {id, reason}; known ids come out in its order. Without an agent, on an error or an unusable answer the given order stays.
    """
    rows = [r.asDict() for r in candidates.select("id", *[truncate(F.col(c), 300).alias(c) for c in ("what", "why")]).limit(MOST_CANDIDATES).collect()]
    if agent is None or not rows:
        return rows[:limit], False
    try:
        answer = carve(agent(json.dumps({"question": question, "candidates": rows})), "[")
    except Exception:  # noqa: BLE001 - the agent is somebody else's program
        return rows[:limit], False
    known = {r["id"]: r for r in rows}
    if not isinstance(answer, list):
        return rows[:limit], False
    picked = {a["id"]: a.get("reason", "") for a in answer if isinstance(a, dict) and a.get("id") in known}
    return [known[i] | {"reason": why} for i, why in picked.items()][:limit], True


def judge_pairs(pairs: DataFrame, agent: Agent, workers: int = 3) -> DataFrame:
    """(project_id, a, b, verdict, reason): each pair (project_id, a, b, what_a, what_b) judged in tasks, ``workers`` at a time in each; failures have no verdict."""
    from concurrent.futures import ThreadPoolExecutor

    def one(r: dict) -> tuple:
        try:
            answer = carve(agent(json.dumps({"a": r["what_a"], "b": r["what_b"]})))
        except Exception:  # noqa: BLE001
            answer = None
        ok = isinstance(answer, dict) and answer.get("verdict") in VERDICTS
        return r["project_id"], r["a"], r["b"], answer["verdict"] if ok else None, str(answer.get("reason", "")) if ok else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b.to_dict("records"))), columns=["project_id", "a", "b", "verdict", "reason"])

    return pairs.select("project_id", "a", "b", "what_a", "what_b").mapInPandas(run, "project_id string, a string, b string, verdict string, reason string")


def tally(judged: DataFrame) -> DataFrame:
    """(judged, ignored, failed): one row."""
    v = F.col("verdict")
    return judged.agg(F.count_if(v.isNotNull() & (v != "not_conflict")).alias("judged"), F.count_if(v == "not_conflict").alias("ignored"), F.count_if(v.isNull()).alias("failed"))


def applied_verdicts(relations: DataFrame, judged: DataFrame, as_of: datetime) -> DataFrame:
    """``relations`` after the verdicts of :func:`judge_pairs`: a pair's pending conflict gives way to a judged relation of the verdict's type.

    not_conflict marks the pending conflict ignored; a pair without a verdict keeps what it has, so a failed agent changes nothing.
    """
    c = F.col
    said = judged.where("verdict IS NOT NULL").groupBy("project_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("verdict", "reason", "a", "b")).alias("v"))
    rows = relations.withColumns({"x": F.least("source_id", "target_id"), "y": F.greatest("source_id", "target_id")}).join(said, ["project_id", "x", "y"], "left")
    pending = (c("relation_type") == "conflicts_with") & (c("status") == "pending") & c("v").isNotNull()
    open_ = F.coalesce(pending, F.lit(False))
    kept = rows.where(~open_ | (c("v.verdict") == "not_conflict"))
    kept = kept.withColumns({"status": F.when(open_, "ignored").otherwise(c("status")), "judged_by": F.when(open_, "agent").otherwise(c("judged_by"))}).select(*relations.columns)
    ends = said.where("v.verdict <> 'not_conflict'")
    new = ends.select(
        scalar.new_id(c("project_id"), c("v.a"), c("v.b"), c("v.verdict")).alias("id"), "project_id", c("v.a").alias("source_id"), c("v.b").alias("target_id"), c("v.verdict").alias("relation_type"),
        F.lit("judged").alias("status"), c("v.reason").alias("reason"), F.lit("agent").alias("judged_by"), F.lit(as_of).alias("created_at"),
    )
    return kept.unionByName(new, allowMissingColumns=True)


def selected(bundle: DataFrame, goal: str, agent: Agent | None) -> DataFrame:
    """``bundle`` of :func:`knowloom.operators.memory.bundle` in the order that an agent finds fitting for ``goal``, one question a project; a failure keeps the given order.

    A project's bundle is a few rows by the caps of its sections, so its question is small; projects are asked in parallel tasks.
    """
    if agent is None or not goal:
        return bundle

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["section", "rank"])
        try:
            answer = carve(agent(json.dumps({"goal": goal, "candidates": rows[["id", "what"]].to_dict("records")})), "[")
        except Exception:  # noqa: BLE001 - the agent is somebody else's program
            answer = None
        wanted = [a.get("id") if isinstance(a, dict) else a for a in answer] if isinstance(answer, list) else []
        place = {i: k for k, i in enumerate(wanted)}
        if not place.keys() & set(rows["id"]):
            return group
        rows = rows.assign(_at=[place.get(i, len(place)) for i in rows["id"]]).sort_values(["section", "_at", "rank"])
        return rows.assign(rank=rows.groupby("section").cumcount() + 1).drop(columns="_at")

    return bundle.groupBy("project_id").applyInPandas(ask, bundle.schema)


def confirm_issues(issues: DataFrame, agent: Agent | None, proposal: str) -> DataFrame:
    """Preflight issues; an agent may raise a pinned rule's warning to a block but never lower a verdict.

    Issues are at most 30 a project, so each project's warnings go in one question, projects in parallel tasks. The agent answers with a list of
    {id, violates}; without an agent, on an error or an unusable answer the issues stay as they are. ``verdict`` follows the severities.
    """
    if agent is None:
        return issues

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        open_ = group[(group["severity"] == "WARN") & group["pinned"]]
        if not len(open_):
            return group
        try:
            rules = [{"id": i, "rule": w} for i, w in zip(open_["memory_id"], open_["what"])]
            answer = carve(agent(json.dumps({"proposal": proposal, "rules": rules})), "[")
        except Exception:  # noqa: BLE001
            answer = None
        broken = {a.get("id") for a in answer if isinstance(a, dict) and a.get("violates") is True} if isinstance(answer, list) else set()
        raised = group.assign(severity=["BLOCK" if i in broken and p else s for i, p, s in zip(group["memory_id"], group["pinned"], group["severity"])])
        return raised.assign(verdict=raised["severity"].min())

    return issues.groupBy("project_id").applyInPandas(ask, issues.schema)
