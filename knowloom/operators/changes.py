"""Changes to a project's specification: made, edited, moved through their states, linked and committed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators import lifecycle, specs
from knowloom.operators.memory import CHANGE_STATES, first_of
from knowloom.runtime import cut
from knowloom.tables import CHANGES, conform

KEY = ["project_id", "id"]
EDITABLE = ("title", "what", "goal", "where_path", "capability_path", "design", "tasks")
#: A path below a folder: no root, no ``..``, no empty part, no backslash.
SAFE_PATH = r"^(?!.*(?:^|/)\.{1,2}(?:/|$))[^/\\\x00]+(?:/[^/\\\x00]+)*$"


def create_changes(changes: DataFrame, requests: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(changes, refused): ``requests`` (project_id, slug, title, ... as in CHANGES) as drafts that target the capability of their slug.

    Refused (project_id, slug, problem) are those without project, slug or title, with a slug that is no safe path, and those whose slug the
    project has already, in the table or earlier among the requests. Texts come out redacted.
    """
    c = F.col
    rows = conform(requests, CHANGES)
    rows = rows.withColumns({"slug": text.redact(text.trim_space(F.coalesce("slug", F.lit("")))), "title": text.redact(text.trim_space(F.coalesce("title", F.lit(""))))})
    rows = rows.withColumns({f: text.redact(c(f)) for f in EDITABLE if f not in ("title", "capability_path")})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("project_id", "slug").orderBy("title", F.coalesce("id", F.lit("")), F.coalesce("what", F.lit("")))))
    known = changes.select("project_id", "slug", F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, ["project_id", "slug"], "left")
    problem = (
        F.when(F.coalesce("project_id", F.lit("")) == "", "no project").when(c("slug") == "", "no slug").when(c("title") == "", "no title")
        .when(~c("slug").rlike(SAFE_PATH), "unsafe slug").when(c("_known").isNotNull() | (c("_n") > 1), "slug is taken")
    )
    rows = rows.withColumn("problem", problem)
    fresh = rows.where("problem IS NULL").withColumns({
        "id": F.coalesce("id", scalar.new_id(c("project_id"), c("slug"), F.lit(as_of).cast("string"))), "status": F.lit("draft"), "capability_path": c("slug"),
        "created_at": F.lit(as_of), "updated_at": F.lit(None).cast("timestamp"), "archived_at": F.lit(None).cast("timestamp"),
    })
    return changes.unionByName(conform(fresh, CHANGES), allowMissingColumns=True), rows.where("problem IS NOT NULL").select("project_id", "slug", "problem")


def update_changes(changes: DataFrame, edits: DataFrame, as_of: datetime) -> DataFrame:
    """``changes`` with the fields that ``edits`` (project_id, id, any of EDITABLE) give; null keeps a field; what is written is redacted."""
    fields = [f for f in EDITABLE if f in edits.columns]
    new = edits.select(*KEY, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    rows = changes.join(new, KEY, "left")
    rows = rows.withColumns({f: F.coalesce(text.redact(F.col(f"_new_{f}")), F.col(f)) for f in fields})
    return rows.withColumn("updated_at", F.when(F.col("_hit"), F.lit(as_of)).otherwise(F.col("updated_at"))).select(*changes.columns)


def set_capability(changes: DataFrame, targets: DataFrame, as_of: datetime) -> DataFrame:
    """``changes`` with the capability of ``targets`` (project_id, id, capability_path); a blank one goes back to the slug."""
    clean = F.nullif(text.redact(text.trim_space(F.coalesce("capability_path", F.lit("")))), F.lit(""))
    new = targets.select(*KEY, clean.alias("_cap"), F.lit(True).alias("_hit"))
    rows = changes.join(new, KEY, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumns({"capability_path": F.when(hit, F.coalesce("_cap", "slug")).otherwise(F.col("capability_path")), "updated_at": F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at"))}).select(*changes.columns)


def move_changes(changes: DataFrame, moves: DataFrame, as_of: datetime) -> DataFrame:
    """``changes`` with ``moves`` (project_id, id, to_status) made, from any state to any; an unknown state leaves the row as it is. Applied and archived ones get the time of their archiving."""
    m = moves.select(*KEY, F.col("to_status").alias("_to"))
    ok = F.coalesce(F.col("_to").isin(*CHANGE_STATES), F.lit(False))
    rows = changes.join(m, KEY, "left")
    return rows.withColumns({
        "archived_at": F.when(ok & F.col("_to").isin("applied", "archived"), F.lit(as_of)).otherwise(F.col("archived_at")), "updated_at": F.when(ok, F.lit(as_of)).otherwise(F.col("updated_at")),
        "status": F.when(ok, F.col("_to")).otherwise(F.col("status")),
    }).select(*changes.columns)


def by_status(changes: DataFrame, status: str | None = None, n: int = 10) -> DataFrame:
    """The newest ``n`` changes of each project in a state, or in any."""
    rows = changes.where(F.col("status") == status) if status else changes
    return first_of(rows, ["project_id"], [F.desc_nulls_last("created_at"), F.col("id")], n)


def find_changes(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The changes that ``wanted`` (project_id, name) names by id, or else by slug, with ``name``."""
    names = F.array(F.struct(F.lit(0).alias("by"), F.col("id").alias("name")), F.struct(F.lit(1).alias("by"), F.col("slug").alias("name")))
    rows = changes.withColumn("_n", F.explode(names)).select(*changes.columns, "_n.by", "_n.name").join(wanted.select("project_id", "name").distinct(), ["project_id", "name"])
    return first_of(rows, ["project_id", "name"], [F.col("by"), F.col("id")]).select(*changes.columns, "name")


def link_memories(memories: DataFrame, links: DataFrame) -> DataFrame:
    """``memories`` with the change_id of ``links`` (project_id, memory_id, change_id); deleted ones stay, a blank change unlinks."""
    new = lifecycle.latest(links.select("project_id", F.col("memory_id").alias("id"), F.coalesce("change_id", F.lit("")).alias("_change")), KEY, [F.col("_change")])
    rows = memories.join(new, KEY, "left")
    value = F.when(F.col("_change").isNotNull() & F.col("deleted_at").isNull(), F.nullif("_change", F.lit(""))).otherwise(F.col("change_id"))
    return rows.withColumn("change_id", value).select(*memories.columns)


# -- deltas --------------------------------------------------------------------


def replace_deltas(deltas: DataFrame, fresh: DataFrame) -> DataFrame:
    """``deltas`` with the rows of the changes that ``fresh`` (project_id, change_id, DELTA) names replaced by those given there."""
    named = fresh.select("project_id", "change_id").distinct()
    return deltas.join(named, ["project_id", "change_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def deltas_of(deltas: DataFrame, changes: DataFrame) -> DataFrame:
    """The deltas of ``changes`` with the capability they target, in their order; what a merge takes."""
    target = changes.select("project_id", F.col("id").alias("change_id"), F.coalesce(F.nullif("capability_path", F.lit("")), "slug").alias("capability_path"))
    return deltas.drop("capability_path").join(target, ["project_id", "change_id"])


def commit_changes(tables: dict[str, DataFrame], decisions: DataFrame, as_of: datetime, status: str = "applied") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, problems): what committing changes makes of memories, changes and capabilities; publish them by one ``Store.commit``.

    ``tables``: memories, changes, deltas, capabilities. ``decisions`` (as MEMORIES, change_id set) is one decision for each change to commit: it is
    saved by its topic, linked to its change, the change's deltas are merged into the capability, and the change moves to ``status``. A change of unknown id
    or with a problem in its merge is left out whole, with all four effects; problems name it (project_id, change_id, problem).
    """
    named = decisions.select("project_id", F.col("change_id").alias("id")).distinct()
    known = tables["changes"].join(named, KEY, "left_semi")
    deltas = cut(deltas_of(tables["deltas"], known), "deltas")
    _, trouble = specs.merge_deltas(tables["capabilities"], deltas)
    bad = deltas.select(*specs.ROW, "change_id").withColumn("requirement", text.redact(text.trim_space(F.col("requirement")))).join(trouble, specs.ROW).select("project_id", "change_id", "problem").distinct()
    lost = named.join(known.select(*KEY), KEY, "left_anti").select("project_id", F.col("id").alias("change_id"), F.lit("no such change").alias("problem"))
    problems = cut(bad.unionByName(lost), "problems")
    stop = problems.select("project_id", "change_id").distinct()
    good = decisions.join(stop, ["project_id", "change_id"], "left_anti")
    memories, actions = (cut(x, "saved") for x in lifecycle.save(good, tables["memories"], as_of))
    linked = link_memories(memories, actions.join(good.select(*KEY, "change_id"), KEY).select("project_id", F.col("target_id").alias("memory_id"), "change_id"))
    merged, _ = specs.merge_deltas(tables["capabilities"], deltas.join(stop, ["project_id", "change_id"], "left_anti"))
    moves = good.select("project_id", F.col("change_id").alias("id"), F.lit(status).alias("to_status")).distinct()
    return {"memories": linked, "changes": move_changes(tables["changes"], moves, as_of), "capabilities": merged.drop("rfc2119")}, problems
