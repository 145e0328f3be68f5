"""Writes as data flow: saves, updates, deletions, reviews, compaction and project moves.

Tables are append-only logs read through a latest-wins view; an operation takes frames and returns frames. :class:`knowloom.sinks.store.Store`
publishes several of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators.memory import busy_topics, first_of, relations_of, stale
from knowloom.operators.search import active

DAY = 24 * 3600 * 1_000_000


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; all columns come from that one row. One aggregation, merged on the sending side."""
    rest = [c for c in log.columns if c not in keys]
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(*keys, "_r.*").select(*log.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with the same keys; missing columns are null.

    Of several incoming rows of one key the one seen last stays, then the one made last, then the highest revision, where
    there are such columns; the content decides between equal ones, so a repeated run has the same outcome.
    """
    have = set(incoming.columns)
    times = [F.col(c) for c in ("last_seen_at", "created_at") if c in have]
    order = ([F.coalesce(*times)] if times else []) + [F.col(c) for c in ("created_at", "updated_at", "revision_count") if c in have]
    newest = latest(incoming, keys, [*order, F.to_json(F.struct(*sorted(have)))])
    both = current.withColumn("_seq", F.lit(0)).unionByName(newest.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_seq")]).drop("_seq")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# -- saves -------------------------------------------------------------------


def topic_versions(saves: DataFrame) -> DataFrame:
    """Saves with a topic, in time order: the first of a project's topic inserts, each later one revises it (project_id, id, action, revision, target_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id", "topic_key").orderBy("created_at", "id")
    rows = active(saves).where("topic_key <> ''").withColumn("revision", F.row_number().over(w)).withColumn("target_id", F.first("id").over(w))
    return rows.select("project_id", "id", F.when(F.col("revision") == 1, "insert").otherwise("upsert").alias("action"), "revision", "target_id")


def repeated_saves(saves: DataFrame, hours: int = 24) -> DataFrame:
    """Saves without a topic, in time order: one of equal content and category less than ``hours`` after an inserted one only raises that one's count.

    (project_id, id, action, target_id). The rows of a key stream through their task in time order with nothing but the last inserted
    row in memory, so a key may have any number of rows.
    """
    digest = scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")])
    rows = active(saves).where("topic_key IS NULL OR topic_key = ''").where("created_at IS NOT NULL")
    keyed = rows.select("project_id", "id", F.xxhash64("project_id", "category", digest).alias("k"), F.concat_ws("\x01", F.coalesce("project_id", F.lit("\x02")), F.coalesce("category", F.lit("\x02")), digest).alias("key"), F.unix_micros("created_at").alias("t"))
    limit = hours * 3600 * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, since, anchor = None, 0, None
        for b in batches:
            targets = []
            for k, t, i in zip(b.column("key").to_pylist(), b.column("t").to_pylist(), b.column("id").to_pylist()):
                if k != key or t - since >= limit:
                    key, since, anchor = k, t, i
                targets.append(anchor)
            yield pa.RecordBatch.from_arrays([b.column("project_id"), b.column("id"), pa.array(targets, pa.string())], ["project_id", "id", "target_id"])

    ordered = keyed.repartition("k").sortWithinPartitions("key", "t", "id")
    out = ordered.select("project_id", "id", "key", "t").mapInArrow(run, "project_id string, id string, target_id string")
    return out.select("project_id", "id", F.when(F.col("id") == F.col("target_id"), "insert").otherwise("bump").alias("action"), "target_id")


def classify(incoming: DataFrame, current: DataFrame, as_of: datetime) -> DataFrame:
    """What saving each incoming row does to ``current``: upsert by topic, bump of a repeat of the last 24 hours, or insert."""
    digest = scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")])
    topics = first_of(active(current).where("topic_key <> ''"), ["project_id", "topic_key"], [F.desc("created_at"), F.col("id")]).select("project_id", "topic_key", F.col("id").alias("topic_id"), F.col("revision_count").alias("_rev"))
    day = F.timestamp_micros(F.unix_micros(F.lit(as_of)) - DAY)
    recent = active(current).where(F.col("created_at") > day).withColumn("_h", digest)
    repeats = recent.groupBy("project_id", "category", "_h").agg(F.min_by("id", F.struct("created_at", "id")).alias("repeat_id"))
    rows = incoming.withColumn("_h", digest).join(topics, ["project_id", "topic_key"], "left").join(repeats, ["project_id", "category", "_h"], "left")
    has_topic = F.coalesce(F.col("topic_key") != "", F.lit(False))
    action = F.when(has_topic & F.col("topic_id").isNotNull(), "upsert").when(~has_topic & F.col("repeat_id").isNotNull(), "bump").otherwise("insert")
    target = F.when(action == "upsert", F.col("topic_id")).when(action == "bump", F.col("repeat_id")).otherwise(F.col("id"))
    return rows.select("project_id", "id", action.alias("action"), target.alias("target_id"), F.when(action == "upsert", F.coalesce("_rev", F.lit(0)) + 1).alias("revision"))


def prepare(incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Rows as they are stored: redacted, with content hash, review date and times filled in."""
    fields = ("what", "why", "where_path", "learned", "git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps")
    rows = incoming.withColumns({c: text.redact(F.col(c)) for c in fields})
    now = F.lit(as_of)
    return rows.withColumns({
        "normalized_hash": scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")]),
        "review_after": F.coalesce("review_after", scalar.review_after(F.col("category"), now)),
        "created_at": F.coalesce("created_at", now), "last_seen_at": F.coalesce("last_seen_at", now), "duplicate_count": F.lit(0).cast("bigint"),
    })


def save(incoming: DataFrame, current: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(memories, actions): ``current`` after saving ``incoming`` in the order of created_at and id, all at ``as_of``.

    A save with a topic revises the topic's newest active memory, or makes it, so that of several saves of one topic in a batch the last one's
    content stays and each counts as a revision. One without raises the count of an active memory of equal content and category made in the 24
    hours before, or is inserted, and its repeats in the batch count on it. Rows are prepared as :func:`prepare` does.
    actions: (project_id, id, action, target_id), one row for each save: insert, upsert or bump, and the memory it went to.
    """
    c = F.col
    rows = prepare(incoming, as_of).withColumn("_topic", F.coalesce(c("topic_key") != "", F.lit(False)))
    cols, place = incoming.columns, F.struct("created_at", "id")
    live = active(current)
    old_topics = first_of(live.where("topic_key <> ''"), ["project_id", "topic_key"], [F.desc("created_at"), c("id")]).select("project_id", "topic_key", F.struct("id", "revision_count", "duplicate_count", "created_at", "pinned", "change_id").alias("_old"))
    topics = rows.where("_topic").groupBy("project_id", "topic_key").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*cols), place).alias("_last"), F.min(place).alias("_first")).join(old_topics, ["project_id", "topic_key"], "left")
    kept = {
        "id": F.coalesce("_old.id", "_first.id"), "revision_count": F.coalesce("_old.revision_count", F.lit(0)) + c("_n"), "duplicate_count": F.coalesce("_old.duplicate_count", F.lit(0)).cast("bigint"),
        "created_at": F.coalesce("_old.created_at", "_first.created_at"), "last_seen_at": F.lit(as_of), "pinned": F.coalesce("_old.pinned", "_last.pinned"), "change_id": F.coalesce("_last.change_id", "_old.change_id"), "deleted_at": F.lit(None).cast("timestamp"),
    }
    revised = topics.select(*[kept.get(x, c(f"_last.{x}")).alias(x) for x in cols], c("_old").isNotNull().alias("_was"), c("_first.id").alias("_head"))
    digest = scalar.content_hash(*[c(x) for x in ("what", "why", "learned", "where_path")])
    recent = live.where(c("created_at") > F.timestamp_micros(F.unix_micros(F.lit(as_of)) - DAY)).withColumn("normalized_hash", digest)
    key = ["project_id", "category", "normalized_hash"]
    old_repeats = recent.groupBy(*key).agg(F.min_by(F.struct(*current.columns), place).alias("_old"))
    plain = rows.where(~c("_topic")).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*cols), place).alias("_first")).join(old_repeats, key, "left")
    was = c("_old").isNotNull()
    counted = {"duplicate_count": F.when(was, F.coalesce("_old.duplicate_count", F.lit(0)) + c("_n")).otherwise(c("_n") - 1).cast("bigint"), "revision_count": F.when(was, c("_old.revision_count")).otherwise(F.coalesce("_first.revision_count", F.lit(0))).cast("bigint"), "last_seen_at": F.lit(as_of)}
    repeated = plain.select(*[counted.get(x, F.when(was, c(f"_old.{x}") if x in current.columns else F.lit(None)).otherwise(c(f"_first.{x}"))).alias(x) for x in cols], was.alias("_was"), c("_first.id").alias("_head"), *[c(k).alias(f"_{k}") for k in key])
    new = revised.select(*cols).unionByName(repeated.select(*cols))
    by_topic = rows.where("_topic").select(*["project_id", "id", "topic_key"]).join(revised.select("project_id", "topic_key", c("id").alias("target_id"), "_was", "_head"), ["project_id", "topic_key"])
    by_content = rows.where(~c("_topic")).select("id", *key).join(repeated.select(*[c(f"_{k}").alias(k) for k in key], c("id").alias("target_id"), "_was", "_head"), key)
    done = lambda df, again: df.select("project_id", "id", F.when(~c("_was") & (c("id") == c("_head")), "insert").otherwise(again).alias("action"), "target_id")
    return upsert(current, new, ["project_id", "id"]), done(by_topic, "upsert").unionByName(done(by_content, "bump"))


def update(memories: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """``changes`` (project_id, id, any fields): null keeps a field and an empty string clears it; the revision rises and the hash follows."""
    fields = [c for c in changes.columns if c not in ("project_id", "id")]
    new = changes.select("project_id", "id", *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    rows = memories.join(new, ["project_id", "id"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    value = lambda c: F.when(hit & F.col(f"_new_{c}").isNotNull(), text.redact(F.col(f"_new_{c}"))).otherwise(F.col(c))
    rows = rows.withColumns({c: value(c) for c in fields})
    rows = rows.withColumns({
        "revision_count": F.when(hit, F.coalesce("revision_count", F.lit(0)) + 1).otherwise(F.col("revision_count")),
        "last_seen_at": F.when(hit, F.lit(as_of)).otherwise(F.col("last_seen_at")),
        "normalized_hash": F.when(hit, scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")])).otherwise(F.col("normalized_hash")),
    })
    return rows.select(*memories.columns)


def _marked(rows: DataFrame, keys: DataFrame, sets: dict[str, Column]) -> DataFrame:
    hit = keys.select("project_id", "id").distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, ["project_id", "id"], "left")
    return out.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in sets.items()}).select(*rows.columns)


def pin(memories: DataFrame, keys: DataFrame, pinned: bool = True) -> DataFrame:
    return _marked(memories, keys, {"pinned": F.lit(pinned)})


def soft_delete(memories: DataFrame, relations: DataFrame, keys: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Memories with ``keys`` marked deleted, and the relations that touch none of them."""
    touched = relations_of(relations).join(keys.select("project_id", F.col("id").alias("memory_id")), ["project_id", "memory_id"], "left_semi")
    kept = relations.join(touched.select("project_id", F.col("relation_id").alias("id")).distinct(), ["project_id", "id"], "left_anti")
    return _marked(memories, keys, {"deleted_at": F.coalesce("deleted_at", F.lit(as_of))}), kept


def hard_delete(memories: DataFrame, keys: DataFrame) -> DataFrame:
    return memories.join(keys.select("project_id", "id"), ["project_id", "id"], "left_anti")


def mark_reviewed(memories: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    now = F.lit(as_of)
    return _marked(memories, keys, {"review_after": scalar.review_after(F.col("category"), now), "last_seen_at": now})


def prune(memories: DataFrame, as_of: datetime, days: int = 90, apply: bool = False, **kw) -> DataFrame:  # noqa: ANN003
    """The stale transient memories, or with ``apply`` the table with those marked deleted."""
    old = stale(memories, as_of, days, **kw)
    return _marked(memories, old, {"deleted_at": F.lit(as_of)}) if apply else old


def ignore_conflicts(relations: DataFrame, keys: DataFrame) -> DataFrame:
    return _marked(relations, keys, {"status": F.lit("ignored"), "judged_by": F.lit("user")})


def judge(relations: DataFrame, judgments: DataFrame, memories: DataFrame) -> DataFrame:
    """Relations with ``judgments`` added: both ends active and different; of one source, target and type the last stays."""
    live = active(memories).select("project_id", "id").distinct()
    ok = judgments.where(F.col("source_id") != F.col("target_id"))
    for end in ("source_id", "target_id"):
        ok = ok.join(live.withColumnRenamed("id", end), ["project_id", end], "left_semi")
    both = relations.withColumn("_seq", F.lit(0)).unionByName(ok.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["project_id", "source_id", "target_id", "relation_type"], [F.col("_seq"), F.col("created_at"), F.col("id")]).drop("_seq")


# -- compaction --------------------------------------------------------------


def _folded(rows: DataFrame, column: str) -> DataFrame:
    """(project_id, topic_key, column): the distinct parts of a group's texts in the order of their first appearance.

    Parts are made distinct before they are gathered, so what a task holds of a group is no more than the text that comes out of it.
    """
    parts = rows.select("project_id", "topic_key", "created_at", "id", F.posexplode(F.split(column, r" \| ")).alias("pos", "p")).withColumn("part", text.trim_space(F.col("p"))).where("part <> ''")
    first = parts.groupBy("project_id", "topic_key", "part").agg(F.min(F.struct("created_at", "id", "pos")).alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " | ")
    return first.groupBy("project_id", "topic_key").agg(joined.alias(column))


def compact(memories: DataFrame, newer_than: datetime | None = None) -> DataFrame:
    """One synthesis for each topic of several active memories: the latest one's content with all distinct reasons and lessons.

    Session and metadata come from the last row with a session, else from the latest; revision is the highest plus the
    group's size, which is also the duplicate count. With a watermark only topics with a newer row are folded.
    """
    topics = busy_topics(memories, newer_than=newer_than).select("project_id", "topic_key")
    rows = active(memories).join(topics, ["project_id", "topic_key"], "left_semi")
    place = F.struct("created_at", "id")
    meta = F.struct("git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps", "session_id", "last_seen_at", "review_after", "pinned")
    with_session = F.coalesce(F.col("session_id") != "", F.lit(False))
    head = rows.groupBy("project_id", "topic_key").agg(
        F.max_by(F.struct("category", "what", "where_path", "created_at"), place).alias("l"),
        F.coalesce(F.max_by(F.when(with_session, meta), F.when(with_session, place)), F.max_by(meta, place)).alias("m"),
        (F.coalesce(F.max("revision_count"), F.lit(0)) + F.count(F.lit(1))).alias("revision_count"), F.count(F.lit(1)).alias("duplicate_count"),
    )
    keys = ["project_id", "topic_key"]
    out = head.select(*keys, "l.*", "m.*", "revision_count", "duplicate_count").join(_folded(rows, "why"), keys, "left").join(_folded(rows, "learned"), keys, "left").fillna("", ["why", "learned"])
    return out.withColumn("normalized_hash", scalar.content_hash(F.col("what"), F.col("why"), F.col("learned"), F.col("where_path"))).withColumn("id", scalar.new_id(F.col("project_id"), F.col("topic_key"), F.col("created_at").cast("string")))


def apply_compaction(memories: DataFrame, syntheses: DataFrame, as_of: datetime) -> DataFrame:
    """The table with the folded rows marked deleted and the syntheses added."""
    folded = active(memories).join(syntheses.select("project_id", "topic_key"), ["project_id", "topic_key"], "left_semi")
    return _marked(memories, folded, {"deleted_at": F.lit(as_of)}).unionByName(syntheses, allowMissingColumns=True)


# -- projects and changes ----------------------------------------------------


def empty_projects(projects: DataFrame, memories: DataFrame) -> DataFrame:
    return projects.join(active(memories).select(F.col("project_id").alias("id")).distinct(), "id", "left_anti")


def register(projects: DataFrame, paths: DataFrame, as_of: datetime) -> DataFrame:
    """``projects`` with a row for each of ``paths`` (path[, name]) that has none yet; the id follows from the path, the name from its last part."""
    path = F.regexp_replace(text.trim_space(F.col("path")), "/+$", "")
    named = F.coalesce(F.col("name"), F.substring_index(path, "/", -1)) if "name" in paths.columns else F.substring_index(path, "/", -1)
    rows = paths.where(path != "").select(F.substring(F.sha2(path, 256), 1, 12).alias("id"), named.alias("name"), path.alias("path"), F.lit(as_of).alias("created_at"))
    return insert_or_ignore(projects, rows, ["id"])


def consolidate(tables: dict[str, DataFrame], source: str, target: str) -> dict[str, DataFrame]:
    """Every table with the rows of one project moved to another; the project row itself goes."""
    moved = lambda t: t.withColumn("project_id", F.when(F.col("project_id") == source, target).otherwise(F.col("project_id")))
    return {k: t.where(F.col("id") != source) if k == "projects" else moved(t) for k, t in tables.items()}


def delete_project(tables: dict[str, DataFrame], project: str, as_of: datetime | None = None) -> dict[str, DataFrame]:
    """Without a time every row of a project goes; with one its memories are marked deleted and the rest stays."""
    if as_of is None:
        return {k: t.where(F.col("id" if k == "projects" else "project_id") != project) for k, t in tables.items()}
    memories = tables["memories"]
    gone = F.when((F.col("project_id") == project) & F.col("deleted_at").isNull(), F.lit(as_of)).otherwise(F.col("deleted_at"))
    return tables | {"memories": memories.withColumn("deleted_at", gone)}


def active_changes(changes: DataFrame, path: str | None = None, n: int = 10) -> DataFrame:
    """Changes neither archived nor rejected, those whose path holds ``path``, newest first, with the progress of their tasks."""
    rows = changes.where(~F.col("status").isin("archived", "rejected"))
    if path:
        rows = rows.where(F.lower("where_path").contains(path.lower()))
    top = first_of(rows, ["project_id"], [F.desc_nulls_last("created_at"), F.col("id")], n)
    return top.select("project_id", "rank", "id", "slug", "status", "title", text.task_summary(F.col("tasks")).alias("progress"))
