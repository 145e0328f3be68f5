"""Mixing sources to target weights.

Every source gets its share of the tokens. A document's expected number of copies follows its weight; its whole
part is allocated for certain, and the fractional part is drawn by Pareto order sampling: documents rank by
random odds divided by inclusion odds, and the first are taken until the source's tokens are reached.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.runtime import cut

#: A document of this many tokens counts half as much as a very long one; a few words carry little.
HALF_WEIGHT = 64
#: Weight classes to a doubling of the size, and classes of the ranking by which the boundary is found.
CLASSES, RANKS = 4, 4096


def size_class(n_tokens) -> F.Column:  # noqa: ANN001
    """Documents of about one size; a class has one weight. Empty documents have class -1."""
    return F.when(n_tokens > 0, F.floor(F.log2(n_tokens.cast("double")) * CLASSES)).otherwise(F.lit(-1)).cast("int")


def class_weight(size_class: int) -> float:
    size = 2.0 ** (size_class / CLASSES)
    return size / (size + HALF_WEIGHT)


def expected_copies(tokens: dict[int, int], quota: float, most: int) -> dict[int, float]:
    """Expected copies of each size class, proportional to its weight, at most ``most``, that add up to ``quota`` tokens."""
    have = sum(tokens.values())
    if quota >= most * have:
        return {c: float(most) for c in tokens}
    capped: set[int] = set()
    while True:
        free = {c: n for c, n in tokens.items() if c not in capped}
        scale = (quota - most * sum(tokens[c] for c in capped)) / sum(class_weight(c) * n for c, n in free.items())
        over = {c for c in free if scale * class_weight(c) > most}
        if not over:
            return {c: float(most) if c in capped else scale * class_weight(c) for c in tokens}
        capped |= over


def plan_quotas(totals: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, tuple[float, float, int]]:
    """(share, quota, most repeats) of each source that has tokens.

    Shares are those of the targets, made to add up to 1 over the sources that have tokens. Without ``total`` the mix is as large as it
    can be with every share met; with a larger one, sources that reach their most repeats fall short.
    """
    usable = [(s, w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m > 0 and totals.get(s, 0) > 0]
    whole = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    if total is None:
        total = min(m * totals[s] / (w / whole) for s, w, m in usable)
    return {s: (w / whole, min(total * w / whole, float(m * totals[s])), m) for s, w, m in usable}


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, copies, n_tokens): the documents drawn, each with its number of copies.

    ``sizes``: (doc_id, source, n_tokens). Sources not named in ``targets`` (source, target_share, max_repeats), null
    sources and documents without tokens give nothing; named sources without documents leave their share to the others. Of a source named twice the
    last target holds. No document has more than max_repeats copies; a source misses its quota by at most
    half of the document at the boundary. The draw depends on ``seed`` and doc_id alone; ties go by doc_id. Empty inputs give an
    empty result. What comes to the driver are totals by source and size class.
    """
    spark = sizes.sparkSession
    targets = list({s: (s, w, m) for s, w, m in targets}.values())
    named = [s for s, _, _ in targets if s is not None]
    docs = sizes.where(F.col("source").isin(named) & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"), size_class(F.col("n_tokens")).alias("cls"))
    classes: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "cls").agg(F.sum("n_tokens").alias("n")).collect():
        classes.setdefault(r["source"], {})[r["cls"]] = r["n"]
    quotas = plan_quotas({s: sum(c.values()) for s, c in classes.items()}, targets, total)
    plan, rest = [], []
    for s, (_, quota, most) in quotas.items():
        copies = expected_copies(classes[s], quota, most)
        whole = {c: min(most, math.floor(x + 1e-9)) for c, x in copies.items()}
        plan += [(s, c, whole[c], max(0.0, x - whole[c]) if whole[c] < most else 0.0) for c, x in copies.items()]
        rest.append((s, quota - sum(whole[c] * n for c, n in classes[s].items())))
    if not plan:
        return docs.where("false").select("doc_id", "source", F.lit(0).alias("copies"), "n_tokens")
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, cls int, whole int, part double"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    odds = (draw / (1 - draw)) / (F.col("part") / (1 - F.col("part")))
    ranked = docs.join(plan_df, ["source", "cls"]).withColumn("q", F.when(F.col("part") > 0, odds))
    ranked = ranked.withColumn("rank", F.floor(F.col("q") / (1 + F.col("q")) * RANKS).cast("int"))
    quota_df = F.broadcast(spark.createDataFrame(rest, "source string, rest double"))
    # the rank class in which a source reaches its tokens: classes before it are taken whole, only its own documents are ordered
    sums = ranked.where("rank IS NOT NULL").groupBy("source", "rank").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(quota_df, "source")
    edge = edge.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select("source", F.col("rank").alias("edge"), "before", "rest")
    edge = cut(edge, "edge")
    known = ranked.join(F.broadcast(edge), "source", "left")
    within = known.where(F.col("rank") == F.col("edge")).withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    # a document is taken while half of it still lies within the quota
    chosen = within.where(F.col("before") + F.col("sum") - F.col("n_tokens") / 2 <= F.col("rest")).select("doc_id", F.lit(1).alias("extra"))
    sure = known.where("rank IS NULL OR edge IS NULL OR rank <> edge").withColumn("copies", F.col("whole") + F.when(F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("rank") < F.col("edge"))), 1).otherwise(0))
    drawn = known.where(F.col("rank") == F.col("edge")).join(chosen, "doc_id", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    cols = ["doc_id", "source", "copies", "n_tokens"]
    return sure.select(cols).unionByName(drawn.select(cols)).where("copies > 0")


def share_report(drawn: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """(source, target_share, share_reached, n_tokens, n_docs, most_copies), one row for each named source, drawn from or not."""
    by = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most"))
    found = {r["source"]: r for r in by.collect()}  # a row for each named source
    whole = sum(r["n"] for r in found.values())
    rows = []
    for s, w in {s: w for s, w, _ in targets if s is not None}.items():
        r = found.get(s)
        rows.append((s, float(w), round(r["n"] / whole, 6), r["n"], r["docs"], r["most"]) if r else (s, float(w), 0.0, 0, 0, 0))
    return drawn.sparkSession.createDataFrame(rows, "source string, target_share double, share_reached double, n_tokens bigint, n_docs bigint, most_copies int")
