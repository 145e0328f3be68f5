"""Memories with similar titles, found through an inverted index of rare tokens.

Titles with the same tokens form one class, so copies never multiply. Two classes with a Jaccard similarity of
at least t share one of the first n - ceil(t * n) + 1 of their n tokens when all tokens are ordered by
rarity, at places that leave enough tokens after them; only these are joined, frequent tokens spread. Parity bits of the tokens, which no similar
pair fails, sort out most others before anything is exchanged, and every candidate is checked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators.search import active
from knowloom.runtime import cut, hot_keys, salted_join


def title_classes(memories: DataFrame) -> DataFrame:
    """(project_id, class_id, id, created_at, tokens): active memories; class_id is the least id with the same title tokens."""
    rows = active(memories).select("project_id", "id", "created_at", F.array_sort(F.array_distinct(text.title_tokens(F.col("what")))).alias("tokens"))
    keyed = rows.withColumn("_key", F.md5(F.array_join("tokens", "\x01")))
    least = keyed.groupBy("project_id", "_key").agg(F.min("id").alias("class_id"))
    return keyed.join(least, ["project_id", "_key"]).drop("_key")


def class_summary(classes: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a class: its tokens, n_members, and whether it has a member newer than the project's last scan."""
    since = projects.select(F.col("id").alias("project_id"), F.col("last_conflict_scan_at").alias("_since"))
    new = F.col("_since").isNull() | (F.col("created_at") > F.col("_since"))
    rows = classes.join(since, "project_id", "left")
    return rows.groupBy("project_id", "class_id").agg(F.min_by("tokens", "id").alias("tokens"), F.count(F.lit(1)).alias("n_members"), F.max(F.coalesce(new, F.lit(False))).alias("has_new"))


def _linked(relations: DataFrame) -> DataFrame:
    """(project_id, x, y), x < y: pairs of ids that a relation links in either direction."""
    return relations.where(F.col("source_id") != F.col("target_id")).select("project_id", F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y")).distinct()


def conflict_pairs(memories: DataFrame, projects: DataFrame, relations: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(project_id, a, b, similarity, n_pairs): classes of similar titles that no relation links completely yet.

    At least one side has a member newer than the project's last scan. a = b stands for the pairs within a class of several
    members. n_pairs counts the pairs of members that no relation links in either direction; titles without tokens
    are alike with similarity 1. Similarity is exact; no pair of classes is left out.
    """
    whole = cut(title_classes(memories), "classes")
    summary = cut(class_summary(whole, projects), "summary")
    classes = whole.select("project_id", "id", "class_id")
    tokens = summary.select("project_id", "class_id", F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(rarity, ["project_id", "token"]).groupBy("project_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"), F.expr("bit_xor(shiftleft(1L, CAST(pmod(xxhash64(token), 64) AS INT)))").alias("bits"))
    n = F.size("o")
    first = F.slice(F.transform("o", lambda x: x["token"]), F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    prefix = cut(ordered.select("project_id", "class_id", "bits", n.alias("n"), F.posexplode(first).alias("pos", "token")), "prefix")
    keys = ["project_id", "token"]
    end = lambda x: prefix.select(*keys, F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"pos{x}"), F.col("bits").alias(f"bits{x}"))
    met = salted_join(end("a"), end("b"), keys, hot=cut(hot_keys(prefix, keys), "hot")).where("a < b")
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    # from the first token that two classes share no more can follow than the shorter rest
    enough = 1 + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) - 1 >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    # 64 parity bits of the tokens differ in no more places than the titles in tokens
    alike = F.bit_count(F.col("bitsa").bitwiseXOR(F.col("bitsb"))) <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    found = met.where(fits & enough & alike).select("project_id", "a", "b").distinct()
    side = lambda x: summary.select("project_id", F.col("class_id").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n_members").alias(f"n{x}"), F.col("has_new").alias(f"new{x}"))
    across = found.join(side("a"), ["project_id", "a"]).join(side("b"), ["project_id", "b"])
    across = across.withColumn("similarity", scalar.jaccard(F.col("ta"), F.col("tb"))).where((F.col("similarity") >= threshold) & (F.col("newa") | F.col("newb")))
    across = across.select("project_id", "a", "b", "similarity", (F.col("na") * F.col("nb")).alias("all_pairs"))
    within = summary.where((F.col("n_members") > 1) & F.col("has_new")).select("project_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"), F.expr("n_members * (n_members - 1) div 2").alias("all_pairs"))
    known = _linked(relations)
    of = lambda x, c: classes.select("project_id", F.col("id").alias(x), F.col("class_id").alias(c))
    linked = known.join(of("x", "cx"), ["project_id", "x"]).join(of("y", "cy"), ["project_id", "y"])
    linked = linked.groupBy("project_id", F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).agg(F.count(F.lit(1)).alias("n_linked"))
    out = across.unionByName(within).join(linked, ["project_id", "a", "b"], "left").withColumn("n_pairs", F.col("all_pairs") - F.coalesce("n_linked", F.lit(0)))
    return out.where("n_pairs > 0").select("project_id", "a", "b", "similarity", "n_pairs")


def entered_links(pairs: DataFrame, memories: DataFrame, relations: DataFrame) -> DataFrame:
    """(project_id, source_id, target_id, similarity): the links that an applying scan enters for ``pairs`` of :func:`conflict_pairs`.

    One link between the two representatives (class ids) of each pair of classes, and one from each member of a class in ``pairs`` to its
    representative, where no relation links the two yet. With the membership of :func:`title_classes` they hold every similar pair of memories, also within a class, in as
    many rows as there are class pairs and members; the pairs themselves are never written out.
    """
    across = pairs.where("a <> b").select("project_id", F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity")
    touched = pairs.select("project_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("class_id")).distinct()
    members = title_classes(memories).where("id <> class_id").join(touched, ["project_id", "class_id"], "left_semi")
    within = members.select("project_id", F.col("class_id").alias("source_id"), F.col("id").alias("target_id"), F.lit(1.0).alias("similarity"))
    links = across.unionByName(within).withColumns({"x": F.least("source_id", "target_id"), "y": F.greatest("source_id", "target_id")})
    return links.join(_linked(relations), ["project_id", "x", "y"], "left_anti").drop("x", "y")
