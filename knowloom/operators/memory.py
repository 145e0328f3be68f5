"""Filters, aggregations, windows and joins over memories, sessions, prompts and relations.

Every function works on the rows of all projects at once; ``project_id`` is the leading key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators.search import active
from knowloom.runtime import broadcast_if_small

#: Fixed values.
TRANSIENT = ("journal", "qa", "discussion", "idea")
RELATION_STATES = ("pending", "judged", "ignored")
CHANGE_STATES = ("draft", "proposed", "validated", "applied", "archived", "rejected")
FULL = (
    "id", "project_id", "category", "what", "why", "where_path", "learned", "git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps",
    "session_id", "topic_key", "revision_count", "duplicate_count", "last_seen_at", "normalized_hash", "created_at",
)
#: Sections of the session-start bundle: categories, rows shown, whether the rationale is shown.
SECTIONS = (
    ("decisions", ("architecture", "decision"), 3, True),
    ("standards", ("standard",), 2, False),
    ("recent", ("bugfix", "journal"), 2, False),
    ("postmortems", ("postmortem",), 1, True),
    ("qa", ("qa",), 1, False),
)


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank``; the limit applies before the exchange as well."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


# -- filters ---------------------------------------------------------------


def get(memories: DataFrame, project_id: str, memory_id: str) -> DataFrame:
    """One active memory in full, redacted."""
    row = active(memories).where((F.col("project_id") == project_id) & (F.col("id") == memory_id))
    return row.withColumns({c: text.redact(F.col(c)) for c in ("what", "why", "learned", "impact", "errors_faced", "next_steps")})


def of_categories(memories: DataFrame, *categories: str) -> DataFrame:
    return active(memories).where(F.col("category").isin(*categories))


def of_sessions(memories: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` memories of each session, oldest first."""
    return first_of(active(memories).where("session_id IS NOT NULL"), ["project_id", "session_id"], [F.col("created_at"), F.col("id")], n)


def pinned(memories: DataFrame, n: int = 20) -> DataFrame:
    return first_of(active(memories).where("pinned"), ["project_id"], [F.desc("created_at"), F.col("id")], n)


def lookup(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """The active memories that ``keys`` (project_id, id) name, each once, however often a key is given."""
    return active(memories).join(keys.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi")


def since(memories: DataFrame, t: datetime) -> DataFrame:
    return active(memories).where(F.col("created_at") > F.lit(t))


def changed_since(memories: DataFrame, t: datetime) -> DataFrame:
    """Created or seen at or after ``t``: at least once, so that a repeated sync loses nothing."""
    return active(memories).where((F.col("created_at") >= F.lit(t)) | (F.col("last_seen_at") >= F.lit(t)))


def stale(memories: DataFrame, as_of: datetime, days: int = 90, categories: tuple[str, ...] = TRANSIENT) -> DataFrame:
    """Unpinned memories of passing categories not seen for ``days`` days."""
    before = F.timestamp_micros(F.unix_micros(F.lit(as_of)) - days * scalar.DAY_MICROS)
    return active(memories).where(~F.coalesce("pinned", F.lit(False)) & F.col("category").isin(*categories) & (F.coalesce("last_seen_at", "created_at") < before))


def ordered_union(sources: list[DataFrame], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each project of several sources (project_id, id, ...), those of an earlier source first, each id once; ``source`` counts from 0."""
    both = None
    for i, df in enumerate(sources):
        rows = df.withColumn("source", F.lit(i))
        both = rows if both is None else both.unionByName(rows)
    once = first_of(both, ["project_id", "id"], [F.col("source"), *order], 1, "_once").drop("_once")
    return first_of(once, ["project_id"], [F.col("source"), *order, F.col("id")], n)


def relations_of(relations: DataFrame) -> DataFrame:
    """(project_id, memory_id, relation id, role): every relation under each of its two ends."""
    ends = F.array(F.struct(F.lit("source").alias("role"), F.col("source_id").alias("memory_id")), F.struct(F.lit("target").alias("role"), F.col("target_id").alias("memory_id")))
    return relations.select("project_id", F.col("id").alias("relation_id"), F.explode(ends).alias("e")).select("project_id", "e.memory_id", "relation_id", "e.role").where("memory_id IS NOT NULL")


def compare(memories: DataFrame, relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project_id, a, b, field_name, value_a, value_b, relation_type): memories side by side for ``pairs`` (project_id, a, b)."""
    fields = ("category", "what", "why", "where_path", "learned")
    side = lambda x: memories.select("project_id", F.col("id").alias(x), F.struct(*fields).alias(f"m{x}"))
    both = pairs.join(side("a"), ["project_id", "a"]).join(side("b"), ["project_id", "b"])
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col("ma")[f].alias("value_a"), F.col("mb")[f].alias("value_b")) for f in fields])
    known = relations.groupBy("project_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.min("relation_type").alias("relation_type"))
    return both.select("project_id", "a", "b", F.explode(cells).alias("c")).select("project_id", "a", "b", "c.*").join(known, ["project_id", "a", "b"], "left")


def invalid_rows(memories: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(project_id, id, problems): rows that a strict import refuses: unsafe ids, missing titles, fields beyond their bytes."""
    most = most or {"what": 500, "why": 10_000, "learned": 10_000, "where_path": 1_000, "topic_key": 200, "category": 50}
    over = [F.when(F.octet_length(c) > n, F.lit(f"{c} too long")) for c, n in most.items()]
    unsafe = F.when(~F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), F.lit("unsafe id"))
    missing = F.when(F.coalesce(text.trim_space(F.col("what")), F.lit("")) == "", F.lit("no title"))
    return memories.select("project_id", "id", F.array_compact(F.array(unsafe, missing, *over)).alias("problems")).where(F.size("problems") > 0)


#: Bytes that the fields of a change may take.
CHANGE_LIMITS = {"title": 500, "what": 10_000, "goal": 10_000, "where_path": 1_000, "capability_path": 200, "design": 100_000, "tasks": 100_000}


def invalid_changes(changes: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(project_id, id, problems): changes with an unsafe slug or capability, no title, or fields beyond their bytes."""
    from knowloom.operators.changes import SAFE_PATH

    over = [F.when(F.octet_length(c) > n, F.lit(f"{c} too long")) for c, n in (most or CHANGE_LIMITS).items()]
    unsafe = [F.when((F.coalesce(c, F.lit("")) != "") & ~F.col(c).rlike(SAFE_PATH), F.lit(f"unsafe {c}")) for c in ("slug", "capability_path")]
    missing = F.when(F.coalesce(text.trim_space(F.col("title")), F.lit("")) == "", F.lit("no title"))
    return changes.select("project_id", "id", F.array_compact(F.array(*unsafe, missing, *over)).alias("problems")).where(F.size("problems") > 0)


# -- aggregations ----------------------------------------------------------


def stats(projects: DataFrame, memories: DataFrame, sessions: DataFrame, relations: DataFrame, prompts: DataFrame, as_of: datetime) -> DataFrame:
    """One row a project with its counts; each table is read once and reduced before the joins."""
    day = F.timestamp_micros(F.unix_micros(F.lit(as_of)) - scalar.DAY_MICROS)
    live = F.col("deleted_at").isNull()
    m = memories.groupBy("project_id").agg(F.count_if(live).alias("memories"), F.count_if(~live).alias("deleted"), F.count_if(live & (F.col("created_at") > day)).alias("recent_24h"))
    s = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("status") == "active").alias("active_sessions"))
    r = relations.groupBy("project_id").agg(F.count(F.lit(1)).alias("relations"))
    p = prompts.groupBy("project_id").agg(F.count(F.lit(1)).alias("prompts"))
    out = projects.select(F.col("id").alias("project_id"))
    for x in (m, s, r, p):
        out = out.join(x, "project_id", "left")
    return out.fillna(0)


def category_counts(memories: DataFrame) -> DataFrame:
    return active(memories).groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"))


def state_counts(rows: DataFrame, projects: DataFrame, states: tuple[str, ...], column: str = "status") -> DataFrame:
    """(project_id, status, n) for every project and state, 0 where there is none."""
    every = projects.select(F.col("id").alias("project_id"), F.explode(F.array(*[F.lit(s) for s in states])).alias(column))
    return every.join(rows.groupBy("project_id", column).agg(F.count(F.lit(1)).alias("n")), ["project_id", column], "left").fillna(0, ["n"])


def conflict_states(relations: DataFrame, projects: DataFrame) -> DataFrame:
    return state_counts(relations.where("relation_type = 'conflicts_with'"), projects, RELATION_STATES)


def busy_topics(memories: DataFrame, at_least: int = 2, newer_than: datetime | None = None) -> DataFrame:
    """Topics with several active memories, of which one is newer than the watermark if there is one."""
    by = active(memories).where("topic_key <> ''").groupBy("project_id", "topic_key").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    return by.where((F.col("n") >= at_least) & (F.col("newest") > F.lit(newer_than) if newer_than else F.lit(True)))


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations_of(relations).groupBy("project_id", "memory_id").agg(F.count(F.lit(1)).alias("n"))


def project_list(projects: DataFrame, memories: DataFrame, sessions: DataFrame) -> DataFrame:
    m = active(memories).groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("memories"))
    s = sessions.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("sessions"))
    return projects.select("id", "name", "path").join(m, "id", "left").join(s, "id", "left").fillna(0, ["memories", "sessions"])


# -- windows ---------------------------------------------------------------


def latest_of_topics(memories: DataFrame) -> DataFrame:
    """The newest active memory of each project and topic."""
    return first_of(active(memories).where("topic_key <> ''"), ["project_id", "topic_key"], [F.desc_nulls_last("created_at"), F.col("id")]).drop("rank")


def current_sessions(sessions: DataFrame) -> DataFrame:
    """(project_id, active_id, last_id): the active session that started last and the completed one that ended last."""
    state = F.lower(text.trim_space(F.col("status")))
    started = F.when(state == "active", F.struct("started_at", "id"))
    ended = F.when(state == "completed", F.struct("ended_at", "id"))
    return sessions.groupBy("project_id").agg(F.max(started)["id"].alias("active_id"), F.max(ended)["id"].alias("last_id"))


def session_context(memories: DataFrame, sessions: DataFrame, n: int = 10) -> DataFrame:
    """(project_id, session_id, rank, id, what): the first ``n`` memories of each project's last session, redacted."""
    last = current_sessions(sessions).select("project_id", F.col("last_id").alias("session_id")).where("session_id IS NOT NULL")
    return of_sessions(memories, n).join(last, ["project_id", "session_id"]).select("project_id", "session_id", "rank", "id", text.redact(F.col("what")).alias("what"))


def timeline(memories: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(project_id, anchor_id, id, what, created_at, position): neighbours in time of each anchor (project_id, anchor_id), negative before it.

    Neighbours are active and strictly older or newer; the anchor itself may be deleted. Anchors are a request's few rows:
    each row of a project meets each of its anchors once, and the limits apply before the exchange, so a
    large project is not gathered in one task.
    """
    anchor = broadcast_if_small(anchors.select("project_id", "anchor_id").distinct())
    at = broadcast_if_small(memories.select("project_id", F.col("id").alias("anchor_id"), F.col("created_at").alias("_t")).join(anchor, ["project_id", "anchor_id"]))
    near = active(memories).join(at, "project_id").where(F.col("created_at") != F.col("_t"))
    cols = ["project_id", "anchor_id", "id", text.redact(F.col("what")).alias("what"), "created_at"]
    keys = ["project_id", "anchor_id"]
    older = first_of(near.where("created_at < _t"), keys, [F.desc("created_at"), F.desc("id")], before).select(*cols, (-F.col("rank")).alias("position"))
    newer = first_of(near.where("created_at > _t"), keys, [F.col("created_at"), F.col("id")], after).select(*cols, F.col("rank").alias("position"))
    return older.unionByName(newer)


def bundle(memories: DataFrame, sessions: DataFrame, goal: str = "", as_pool: int = 15) -> DataFrame:
    """(project_id, section, rank, id, category, what, why): what a session starts with.

    Per section the newest memories that the last session and the pinned list do not show already; with a goal, of the newest
    15 the pinned, then those with most of its words, then the newest.
    """
    last = current_sessions(sessions).select("project_id", F.col("last_id").alias("session_id")).where("session_id IS NOT NULL")
    shown = of_sessions(memories, 10).join(last, ["project_id", "session_id"]).select("project_id", "id").unionByName(pinned(memories, 20).select("project_id", "id")).distinct()
    section = F.lit(None).cast("string")
    for name, categories, _, _ in SECTIONS:
        section = F.when(F.col("category").isin(*categories), name).otherwise(section)
    cap, why = F.lit(0), F.lit(False)
    for name, _, n, with_why in SECTIONS:
        cap, why = F.when(F.col("section") == name, n).otherwise(cap), F.when(F.col("section") == name, with_why).otherwise(why)
    pool = active(memories).withColumn("section", section).where("section IS NOT NULL").withColumn("_cap", cap)
    newest = [F.desc_nulls_last("created_at"), F.col("id")]
    pool = pool.withColumn("_n", F.row_number().over(Window.partitionBy("project_id", "section").orderBy(*newest))).where(F.col("_n") <= (as_pool if goal else F.col("_cap")))
    pool = pool.join(shown, ["project_id", "id"], "left_anti")
    order = newest
    if goal:
        tokens = [t for t in goal.lower().split() if t not in text.STOP_WORDS and len(t.encode()) > 1]
        order = [F.desc(F.coalesce("pinned", F.lit(False))), F.desc(text.keyword_score(tokens, F.col("what"), F.col("why"))), *newest]
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "section").orderBy(*order))).where(F.col("rank") <= F.col("_cap"))
    return ranked.select("project_id", "section", "rank", "id", F.upper("category").alias("category"), text.redact(F.col("what")).alias("what"), F.when(why, text.truncate(text.redact(F.col("why")), 300)).alias("why"))


# -- sorts -----------------------------------------------------------------


def review_items(memories: DataFrame, relations: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """The ``n`` memories of each project most in need of attention, with the reasons."""
    c = F.col
    days = {"age_days": "created_at", "seen_days": "last_seen_at", "overdue_days": "review_after"}
    rows = active(memories).withColumns({k: F.coalesce(scalar.age_days(as_of, c(v)), F.lit(0)) for k, v in days.items()})
    rows = rows.withColumn("needs_review", F.coalesce(c("review_after") < F.lit(as_of), F.lit(False)))
    fmt = lambda s, x: F.format_string(s, c(x))
    overdue = F.when(c("overdue_days") > 0, fmt("due for review (policy, %d days overdue)", "overdue_days")).otherwise("due for review (policy)")
    reasons = F.array_compact(F.array(
        F.when(c("needs_review"), overdue), F.when(c("age_days") > 30, fmt("old (%d days)", "age_days")),
        F.when(c("seen_days") > 60, fmt("stale (last seen %d days ago)", "seen_days")),
        F.when(c("duplicate_count") > 3, fmt("high duplicates (%d)", "duplicate_count")), F.when(c("revision_count") > 5, fmt("many revisions (%d)", "revision_count")),
    ))
    rows = rows.withColumn("_r", reasons).withColumn("reason", F.when(F.size("_r") > 0, F.array_join("_r", "; ")).otherwise("recent and healthy"))
    order = [F.desc(F.size("_r") > 0), F.desc("needs_review"), F.desc("age_days"), F.desc_nulls_last("created_at"), c("id")]
    top = first_of(rows, ["project_id"], order, n)
    counts = relation_counts(relations).withColumnRenamed("memory_id", "id").withColumnRenamed("n", "relation_count")
    return top.join(counts, ["project_id", "id"], "left").select("project_id", "rank", "id", "age_days", "seen_days", "needs_review", "reason", F.coalesce("relation_count", F.lit(0)).alias("relation_count"))


def recent_prompts(prompts: DataFrame, n: int = 5, session_id: str | None = None) -> DataFrame:
    """The newest prompts of each project, or of one session."""
    rows = prompts.where(F.col("session_id") == session_id) if session_id else prompts
    return first_of(rows, ["project_id"], [F.desc_nulls_last("created_at"), F.col("id")], n).select("project_id", "rank", "id", "content", "created_at")


# -- joins -----------------------------------------------------------------


def conflicts(relations: DataFrame, memories: DataFrame, status: str | None = None) -> DataFrame:
    """Conflicts with the titles of both ends, deleted memories too, newest first within a project."""
    found = relations.where((F.col("relation_type") == "conflicts_with") & (F.col("status") == status if status else F.lit(True)))
    title = lambda x: memories.select(F.col("id").alias(f"{x}_id"), F.col("what").alias(f"{x}_what"))
    both = found.join(title("source"), "source_id", "left").join(title("target"), "target_id", "left")
    return both.select("project_id", "id", "source_id", "target_id", "status", "score", "source_what", "target_what", "created_at")


def code_links(memories: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, memory_id, node_id, edge_id): active memories linked to the file node that their path names."""
    where = active(memories).select("project_id", F.col("id").alias("memory_id"), text.node_path(F.col("where_path")).alias("path")).where("path <> ''")
    files = nodes.where("id = path").select("project_id", F.col("id").alias("node_id"), "path").dropDuplicates(["project_id", "path"])
    linked = where.join(files, ["project_id", "path"])
    return linked.select("project_id", "memory_id", "node_id", F.concat_ws("-", "memory_id", "node_id", F.lit("rationale_for")).alias("edge_id"))


def stale_bindings(memories: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, id): active memories of whose comma-separated paths one is no file (project_id, path)."""
    parts = active(memories).where("where_path <> ''").select("project_id", "id", F.explode(F.split("where_path", ",")).alias("p")).withColumn("path", text.trim_space(F.col("p"))).where("path <> ''")
    return parts.join(files.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti").select("project_id", "id").distinct()


def session_links(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions that have memories, the guard of their deletion."""
    return sessions.join(memories.select(F.col("session_id").alias("id"), "project_id"), ["project_id", "id"], "left_semi")
