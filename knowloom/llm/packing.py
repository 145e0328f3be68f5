"""Filling fixed-capacity containers with items.

Best-fit decreasing over all documents at once. Sizes are integers up to the capacity, so equal items and equal
bins are handled as runs: the plan is made from the histogram of sizes, with a segment tree over remaining
capacities that finds the tightest open bin, and has one row for each run of equal items that goes to a run of
equal bins. Documents get their place in their run by a distributed rank, and their bin from the plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.runtime import broadcast_if_small, cut

PLAN = T.StructType([T.StructField("container", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("size", "rank_from", "rank_to", "first_bin", "per_bin")])


class SegmentTree:
    """Which remaining capacities 0..capacity have open bins; finds the least that is at least a size in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 2
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        i = at + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        if i >= 2 * self.leaves:
            return None
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def pack_runs(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on (size, count) pairs: rows (size, rank_from, rank_to, first_bin, per_bin).

    The item of a size with rank r in rank_from <= r < rank_to goes to bin first_bin + (r - rank_from) // per_bin.
    The outcome is that of placing item by item, largest first, in the tightest open bin, the first made of equal ones.
    """
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # heaps of (first bin, bins)
    tree, bins, plan = SegmentTree(capacity), 0, []

    def put(left: int, first: int, count: int) -> None:
        if count:
            heapq.heappush(open_bins[left], (first, count))
            tree.set(left, True)

    for size, count in sorted(histogram, reverse=True):
        at = 0
        while at < count:
            left = tree.tightest(size)
            if left is None:
                left, first, have = capacity, bins, -(-(count - at) // (capacity // size)) if size else 1
                bins += have
            else:
                first, have = heapq.heappop(open_bins[left])
                tree.set(left, bool(open_bins[left]))
            each = left // size if size else count
            take = min(count - at, have * each)
            full, rest = divmod(take, each)
            plan.append((size, at, at + take, first, each))
            put(left - each * size, first, full)
            if rest:
                put(left - rest * size, first + full, 1)
                full += 1
            put(left, first + full, have - full)
            at += take
    return plan


def pieces(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, doc_id, piece, size): a document in one piece, or, if it exceeds the capacity, in full pieces and a rest."""
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in containers])
    each = sizes.select("doc_id", "n_tokens", F.explode(kinds).alias("k")).select("doc_id", "n_tokens", "k.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("bigint")
    cutted = each.select("container", "doc_id", "n_tokens", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cutted.select("container", "doc_id", F.col("piece").cast("int").alias("piece"), F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, bin_id, doc_id, piece, n_tokens): every document's place in the bins of every container kind.

    ``sizes``: (doc_id, n_tokens), doc_id unique. Bins of a kind count from 0 and hold at most its capacity. A document
    is in one piece unless it exceeds the capacity. Documents without tokens take no room and lie in the fullest bin. Null
    sizes count as 0. Containers need a positive capacity; others, and null ones, are left out, and without any
    container, or without documents, the result is empty. Equal sizes go by doc_id. What comes to the driver is the
    histogram of sizes, at most capacity + 1 rows a kind, and never a row for each document.
    """
    spark = sizes.sparkSession
    containers = [(n, int(c)) for n, c in containers if n is not None and c is not None and c > 0]
    if not containers:
        return spark.createDataFrame([], "container string, bin_id bigint, doc_id bigint, piece int, n_tokens bigint")
    items = pieces(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), containers)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["container", "size", "doc_id", "piece"]
    placed = cut(items.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("code", F.monotonically_increasing_id()), "items")
    placed = placed.withColumn("block", F.shiftright("code", 33))
    # runs of one size within a block, at most blocks + sizes of them; the rank continues over the blocks
    runs = placed.groupBy("container", "size", "block").agg(F.min("code").alias("first_code"), F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("container", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))), "runs")
    histogram: dict[str, list[tuple[int, int]]] = {}
    for r in runs.groupBy("container", "size").agg(F.sum("count").alias("count")).collect():
        histogram.setdefault(r["container"], []).append((r["size"], r["count"]))
    plan = [(name, *row) for name, capacity in containers for row in pack_runs(histogram.get(name, []), capacity)]
    # a plan row takes up a size's items or a run of bins, and makes two runs of bins at most: some rows for each size, whatever the number of documents;
    # runs are at most sizes + blocks a container. Both are measured all the same, and join by a shuffle beyond the bound.
    where = broadcast_if_small(spark.createDataFrame(plan, PLAN))
    ranked = placed.join(broadcast_if_small(runs.drop("count")), ["container", "size", "block"]).withColumn("rank", F.col("code") - F.col("first_code") + F.col("before"))
    binned = ranked.join(where, ["container", "size"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    bin_id = F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_bin"))
    return binned.select("container", bin_id.cast("bigint").alias("bin_id"), "doc_id", "piece", F.col("size").alias("n_tokens"))


def fill_report(packed: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, n_bins, n_pieces, n_tokens, fill): how much of the bins' room is used."""
    kinds = packed.sparkSession.createDataFrame([(n, int(c)) for n, c in containers if n is not None and c], "container string, capacity bigint")
    by = packed.groupBy("container").agg((F.max("bin_id") + 1).alias("n_bins"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return by.join(F.broadcast(kinds), "container").select("container", "n_bins", "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"))
