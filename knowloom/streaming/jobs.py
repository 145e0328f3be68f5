"""Streaming jobs that keep derived tables fresh.

Each takes a streaming frame and returns one, or starts a query with a checkpoint; all state that grows is bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knowloom.functions import scalar
from knowloom.operators.conflicts import conflict_pairs, entered_links, title_classes
from knowloom.operators.lifecycle import compact
from knowloom.runtime import cut, shared_path
from knowloom.sinks.store import Store
from knowloom.tables import MEMORIES


def chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Memories from a folder of JSON files as they arrive; each file is seen once."""
    return spark.readStream.schema(MEMORIES).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").json(path)


def with_digest(saves: DataFrame) -> DataFrame:
    return saves.withColumn("digest", scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")]))


def first_saves(saves: DataFrame, window: str = "24 hours") -> DataFrame:
    """Saves without those that repeat content and category within the window; later rows than the watermark are dropped by it."""
    return with_digest(saves).withWatermark("created_at", window).dropDuplicatesWithinWatermark(["project_id", "category", "digest"])


def counted_saves(saves: DataFrame, hours: int = 24) -> DataFrame:
    """(project_id, id, repeats, last_seen_at): inserted saves with the number of repeats less than ``hours`` later, sent on each change.

    State of a key is one row and goes when its hours have passed in event time.
    """
    limit = pd.Timedelta(hours=hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        anchor, since, repeats = state.get if state.exists else (None, None, 0)
        since = pd.Timestamp(since) if since is not None else None
        out: dict[str, tuple] = {}
        for i, t in zip(rows["id"], rows["created_at"]):
            if anchor is None or t - since >= limit:
                anchor, since, repeats = i, t, 0
            else:
                repeats += 1
            out[anchor] = (key[0], anchor, repeats, t)
        state.update((anchor, since.to_pydatetime(), repeats))
        state.setTimeoutTimestamp(max(int(since.timestamp() * 1000) + int(limit.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(list(out.values()), columns=["project_id", "id", "repeats", "last_seen_at"])

    keyed = with_digest(saves).withWatermark("created_at", "1 hour").select("project_id", "category", "digest", "id", "created_at").groupBy("project_id", "category", "digest")
    return keyed.applyInPandasWithState(step, "project_id string, id string, repeats int, last_seen_at timestamp", "anchor string, since timestamp, repeats int", "update", GroupStateTimeout.EventTimeTimeout)


def write_bursts(saves: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(project_id, started, ended, n): saves of a project that follow one another within the gap."""
    by = saves.withWatermark("created_at", late).groupBy("project_id", F.session_window("created_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("project_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def upsert_memories(stream: DataFrame, store: Store, checkpoint: str, keys: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Each batch replaces the rows of equal keys in the store's memories, at the cost of the batch; a repeated batch changes nothing.

    Of several versions in one batch the one seen last stays, then the one made last, then the highest revision; the content decides between equal ones.
    """
    from knowloom.operators.lifecycle import upsert

    def apply(batch: DataFrame, epoch: int) -> None:
        newest = upsert(batch.limit(0), batch, list(keys))  # one row a key
        if "memories" in store.versions():
            store.append("memories", newest, list(keys))
        else:
            store.commit(memories=newest)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_conflicts(store: Store, as_of: datetime, threshold: float = 0.45, apply: bool = True) -> DataFrame:
    """Pairs of classes of similar titles with a side newer than the last applied scan; a dry run moves nothing, so it can be repeated.

    Applying enters pending relations, the membership of the classes (conflict_classes) and the new mark in one commit: a relation between
    the representatives of two classes and one from each member to its representative, so that no pair is lost, none within a
    class either, and copies of one title stay linear in their number.
    """
    memories, projects, relations = (store.read(t) for t in ("memories", "projects", "memory_relations"))
    found = conflict_pairs(memories, projects, relations, threshold)
    if apply:
        found = cut(found, "conflicts")
        new = entered_links(found, memories, relations)
        new = new.select(
            scalar.new_id(F.col("project_id"), F.col("source_id"), F.col("target_id")).alias("id"), "project_id", "source_id", "target_id", F.lit("conflicts_with").alias("relation_type"), F.lit("pending").alias("status"),
            F.col("similarity").alias("score"), F.format_string("High description similarity (%.0f%%) between %s and %s", F.col("similarity") * 100, F.col("source_id"), F.col("target_id")).alias("reason"),
            F.lit("system").alias("judged_by"), F.lit(as_of).alias("created_at"),
        )
        store.commit(
            memory_relations=relations.unionByName(new, allowMissingColumns=True), projects=projects.withColumn("last_conflict_scan_at", F.lit(as_of)),
            conflict_classes=title_classes(memories).select("project_id", "class_id", "id"),
        )
    return found


def compact_store(store: Store, as_of: datetime, newer_than: datetime | None = None) -> int:
    """Fold the topics that changed since ``newer_than`` and move the mark; the number of syntheses."""
    from knowloom.operators.lifecycle import apply_compaction

    memories, projects = store.read("memories"), store.read("projects")
    folded = compact(memories, newer_than)
    n = folded.count()
    if n:
        store.commit(memories=apply_compaction(memories, folded, as_of), projects=projects.withColumn("last_compaction_at", F.lit(as_of)))
    else:
        store.commit(projects=projects.withColumn("last_compaction_at", F.lit(as_of)))
    return n


def run_once(stream: DataFrame) -> DataFrame:
    """What a stream has to say of the files that are there, written to the shared folder by one available-now run and read back."""
    spark = stream.sparkSession
    root = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def every(stream: DataFrame, minutes: int, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A periodic job over what has arrived, every ``minutes``; stopping it processes what is there first."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()


def flush(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()
