"""References to records that do not exist.

Keys become integers in their sort order, parent keys compress to contiguous runs of integers, and a
reference is looked up as-of: it is an orphan when the run that starts last at or before it has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.runtime import BROADCAST_BYTES, cut, filled, measured_bytes, release, salted_join

#: monotonically_increasing_id() keeps the partition above this bit and counts up within it.
_BLOCK_BITS = 33


def key_codes(parents: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """An integer for each distinct key of either side, rising with the key inside a block.

    Both sides are reduced to distinct keys before the shuffle by range, so a parent that a third of
    all rows refer to counts once. Columns: the keys, is_parent, is_ref, code, block.
    The table is written to the shared folder: the codes must not change when a lost task is repeated.
    """
    both = parents.select(*keys, F.lit(1).alias("p")).unionByName(refs.select(*keys, F.lit(0).alias("p")))
    distinct = both.groupBy(*keys).agg((F.max("p") == 1).alias("is_parent"), (F.min("p") == 0).alias("is_ref"))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("code", F.monotonically_increasing_id())
    return cut(placed.withColumn("block", F.shiftright("code", _BLOCK_BITS)), "codes")


def parent_runs(codes: DataFrame) -> DataFrame:
    """Contiguous runs (block, run_start, run_end) of the parents' codes."""
    w = Window.partitionBy("block").orderBy("code")
    island = codes.where("is_parent").select("block", "code", (F.col("code") - F.row_number().over(w)).alias("island"))
    return island.groupBy("block", "island").agg(F.min("code").alias("run_start"), F.max("code").alias("run_end")).drop("island")


def orphan_keys(codes: DataFrame, keys: list[str]) -> DataFrame:
    """The referenced keys that lie beyond the end of the run preceding them."""
    runs = parent_runs(codes).select("block", F.col("run_start").alias("code"), "run_end", *[F.lit(None).cast("string").alias(k) for k in keys], F.lit(0).alias("is_key"))
    refs = codes.where("is_ref").select("block", "code", F.lit(None).cast("long").alias("run_end"), *keys, F.lit(1).alias("is_key"))
    w = Window.partitionBy("block").orderBy("code", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    asof = runs.unionByName(refs).withColumn("run_end", F.last("run_end", ignorenulls=True).over(w))
    return asof.where((F.col("is_key") == 1) & (F.col("run_end").isNull() | (F.col("code") > F.col("run_end")))).select(*keys)


def orphan_references(refs: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``refs`` whose ``keys`` no row of ``parents`` has; all columns of ``refs`` are kept.

    Nulls: a reference with a null in a key is no reference and is left out; parents with a null key are
    ignored. Strings compare exactly. Repeated rows stay repeated; empty inputs give an empty result, or,
    for empty parents, every reference. Other columns of either side may have any name but ``_salt``.
    """
    whole = lambda df: df.dropna(subset=keys)
    codes = key_codes(whole(parents), whole(refs), keys)
    lost = cut(orphan_keys(codes, keys), "orphans")
    release(codes)
    if measured_bytes(lost) <= BROADCAST_BYTES:
        return refs.join(F.broadcast(lost), keys, "left_semi")
    return salted_join(whole(refs), lost, keys, "left_semi")


def broken_references(graph_edges: DataFrame, graph_nodes: DataFrame, relations: DataFrame, memories: DataFrame) -> DataFrame:
    """References of both link tables that cannot be followed: (tbl, project_id, row_id, field_name, kind, created_at).

    kind is missing, deleted or late as TESTDATA.md has it; a target that is deleted and late counts as deleted.
    Null and blank references and rows without project are no references. created_at is null for graph_edges, which have no time.
    """
    ends = graph_edges.select(
        "project_id",
        F.col("id").alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("key")) for c in ("source_id", "target_id")])).alias("e"),
    ).select("project_id", "row_id", "e.field_name", "e.key")
    edge_refs = ends.where(filled("key"))
    keys = ["project_id", "key"]
    edges = orphan_references(edge_refs, graph_nodes.select("project_id", F.col("id").alias("key")), keys).select(
        F.lit("graph_edges").alias("tbl"), "project_id", "row_id", "field_name", F.lit("missing").alias("kind"), F.lit(None).cast("timestamp").alias("created_at")
    )
    rel = relations.select("project_id", F.col("id").alias("row_id"), F.col("target_id").alias("key"), "created_at").where(filled("key"))
    targets = memories.select("project_id", F.col("id").alias("key"), "deleted_at", F.col("created_at").alias("born_at"))
    shape = lambda df, kind: df.select(
        F.lit("memory_relations").alias("tbl"), "project_id", "row_id", F.lit("target_id").alias("field_name"), kind.alias("kind"), "created_at"
    )
    gone = shape(orphan_references(rel, targets, keys), F.lit("missing"))
    state = F.when(F.col("deleted_at").isNotNull(), F.lit("deleted")).when(F.col("born_at") > F.col("created_at"), F.lit("late"))
    unusable = targets.dropna(subset=keys)
    held = shape(salted_join(rel, unusable, keys), state).where(F.col("kind").isNotNull())
    return edges.unionByName(gone).unionByName(held).dropDuplicates(["tbl", "project_id", "row_id", "field_name", "kind"])


def reference_report(broken: DataFrame) -> DataFrame:
    """Broken references counted per table, field, kind and month of created_at (null where there is no time)."""
    month = F.date_format("created_at", "yyyy-MM")
    return broken.groupBy("tbl", "field_name", "kind", month.alias("period")).agg(F.count(F.lit(1)).alias("n_rows"))
