"""Ranked full-text search over memories.

:func:`build_index` writes a posting for each word of each text, ordered by word. A search reads the postings of its words only, counts the
hits of its phrases by memory (one row of corpus statistics comes to the driver), and looks up the memories that have any; only the
best rows of each project are exchanged then.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.runtime import broadcast_if_small, cut, with_once

FIELDS = ("what", "why", "learned")
K1, B = 1.2, 0.75
#: Weight of a hit in each field.
WEIGHTS = (10.0, 5.0, 2.0)
#: Letters with marks and their plain forms.
MARKED = "áàâäãåāăąçćčďđéèêëēěęíìîïīłñńňóòôöõøōőřšśşťúùûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiilnnnoooooooorssstuuuuuuuyyzzz"
COSINE_FLOOR = 0.15
COMPACT = ("id", "category", "what", "topic_key", "revision_count", "duplicate_count", "created_at")


def fts_text(c: Column) -> Column:
    """Lower-case runs of letters and digits without marks, a blank before and after each; every other character separates."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def plain_tokens(query: str) -> list[str]:
    """The same for a query, on the driver."""
    import re

    return re.findall(r"[^\W_]+", query.lower().translate(str.maketrans(MARKED, PLAIN)))


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool


def phrases(query: str) -> list[Phrase]:
    """The phrases of a query; those without letters or digits are left out."""
    found = [Phrase(tuple(plain_tokens(t)), prefix) for t, prefix in text.fts_phrases(query)]
    return [p for p in found if p.tokens]


def title_phrases(title: str) -> list[Phrase]:
    """Exact phrases of a title's tokens, each once."""
    import re

    words = [w for w in re.findall(r"[^\W_][\w-]*|[-_][\w-]*", title.lower()) if w not in text.STOP_WORDS and len(w.encode()) > 1]
    found = [Phrase(tuple(plain_tokens(w)), False) for w in dict.fromkeys(words)]
    return [p for p in found if p.tokens]


@dataclass(frozen=True)
class SearchIndex:
    """Postings (token, id, field, pos, len) by token, one for each word of each text, written; the number of memories and of words."""

    postings: DataFrame
    n: int
    total: int


def build_index(memories: DataFrame) -> SearchIndex:
    """The postings of all memories, deleted ones too; ``len`` is the number of words of the memory. Repeated words of one place in the order are spread over partitions."""
    arrays = [F.filter(F.split(F.trim(fts_text(F.col(c))), " "), lambda x: x != "") for c in FIELDS]
    rows = with_once(memories.select("id", *FIELDS), {f"_t{i}": a for i, a in enumerate(arrays)})
    size = sum((F.size(f"_t{i}") for i in range(len(FIELDS))), F.lit(0))
    at = lambda i: lambda x, p: F.struct(x.alias("token"), F.lit(i).alias("field"), p.alias("pos"))
    places = F.flatten(F.array(*[F.transform(f"_t{i}", at(i)) for i in range(len(FIELDS))]))
    words = rows.select("id", size.alias("len"), F.explode(places).alias("p")).select("p.token", "id", "p.field", "p.pos", "len")
    order = ["token", "id", "field", "pos"]
    postings = cut(words.repartitionByRange(*order).sortWithinPartitions(*order), "postings")
    return SearchIndex(postings, memories.count(), postings.count())


def phrase_hits(index: SearchIndex, wanted: list[Phrase], weights: tuple[float, ...]) -> DataFrame:
    """(id, len, f0 ..): the weighed hits of each phrase in each memory that has any, from the postings of the phrases' words.

    A phrase begins where all its words stand in a row; its last word may match a prefix.
    """
    c = F.col
    is_word = lambda p, i: c("token").startswith(p.tokens[i]) if p.prefix and i == len(p.tokens) - 1 else c("token") == p.tokens[i]
    parts = [(k, i, is_word(p, i)) for k, p in enumerate(wanted) for i in range(len(p.tokens))]
    found = index.postings.where(reduce(lambda a, b: a | b, (x for _, _, x in parts)))
    role = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"))) for k, i, x in parts]))
    placed = found.select("id", "len", "field", "pos", F.explode(role).alias("r")).select("id", "len", "field", c("r.k").alias("k"), (c("pos") - c("r.i")).alias("start"), F.pow(F.lit(2), c("r.i")).cast("long").alias("bit"))
    whole = F.element_at(F.array(*[F.lit(2 ** len(p.tokens) - 1).cast("long") for p in wanted]), c("k") + 1)
    begun = placed.repartition("id").groupBy("id", "len", "field", "k", "start").agg(F.bit_or("bit").alias("bits")).where(c("bits") == whole)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), c("field") + 1)
    return begun.groupBy("id", "len").agg(*[F.sum(F.when(c("k") == k, weight).otherwise(0.0)).alias(f"f{k}") for k in range(len(wanted))])


def score(memories: DataFrame, wanted: list[Phrase], weights: tuple[float, ...] = WEIGHTS, index: SearchIndex | None = None) -> DataFrame:
    """Rows with at least one hit: ``_bm25`` (the more negative, the better) and ``_matched``, the number of phrases hit.

    Statistics span all memories of the index, whatever their project, deleted ones too.
    """
    index = index or build_index(memories)
    found = cut(phrase_hits(index, wanted, weights), "hits")
    stats = found.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(wanted))]).first()  # one row
    n, mean = index.n, index.total / max(1, index.n)
    matched, total = F.lit(0), F.lit(0.0)
    for k in range(len(wanted)):
        nk, f = stats[f"n{k}"], F.col(f"f{k}")
        idf = math.log((n - nk + 0.5) / (nk + 0.5))
        idf = idf if idf > 0 else 1e-6
        total = total + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))
        matched = matched + (f > 0).cast("int")
    scored = found.select("id", matched.alias("_matched"), (-total).alias("_bm25"))
    return memories.join(broadcast_if_small(scored), "id")


def tri_factor(as_of: datetime) -> Column:
    """BM25 times importance times recency."""
    return F.col("_bm25") * scalar.importance(F.col("pinned"), F.col("category"), F.col("revision_count")) * scalar.recency(as_of, F.col("created_at"))


def path_matches(path: str | None, paths: list[str] | None = None) -> Column:
    """where_path holds ``path`` (ASCII case aside) or is one of ``paths``; true without either."""
    cut = (path or "").encode()[:200].decode(errors="ignore")
    by_text = F.lower("where_path").contains(cut.lower()) if cut else None
    by_set = F.col("where_path").isin(*paths) if paths else None
    if by_text is None and by_set is None:
        return F.lit(True)
    return F.coalesce(by_text if by_set is None else by_set if by_text is None else by_text | by_set, F.lit(False))


def active(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("deleted_at").isNull())


def _ranked(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of each project, with their ``rank``."""
    w = Window.partitionBy("project_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= offset + limit) & (F.col("rank") > offset))


def search(
    memories: DataFrame, query: str, as_of: datetime, mode: str = "all", category: str | None = None, path: str | None = None,
    paths: list[str] | None = None, limit: int = 10, offset: int = 0, plain: bool = False, index: SearchIndex | None = None,
) -> DataFrame:
    """The best memories of each project: project_id, the compact columns, score and rank.

    ``mode`` all wants every phrase, any wants one. ``plain`` ranks by BM25 alone. Without a query the newest come first; a
    query of which nothing is left finds nothing. Titles come out redacted. Ties go by id.
    """
    wanted_rows = path_matches(path, paths) & (F.col("category") == category if category else F.lit(True))
    if not query.strip():
        rows = active(memories).where(wanted_rows).withColumn("score", F.lit(None).cast("double"))
        rows = _ranked(rows, [F.desc_nulls_last("created_at"), F.col("id")], limit, offset)
    else:
        wanted = phrases(query)
        if not wanted:
            rows = memories.where("false").withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.lit(0))
        else:
            found = active(score(memories, wanted, index=index)).where(wanted_rows)
            if mode != "any":
                found = found.where(F.col("_matched") == len(wanted))
            found = found.withColumn("score", F.col("_bm25") if plain else tri_factor(as_of))
            rows = _ranked(found, [F.col("score"), F.col("id")], limit, offset)
    return rows.withColumn("what", text.redact(F.col("what"))).select("project_id", *COMPACT, "score", "rank")


def hybrid(memories: DataFrame, query: str, as_of: datetime, category: str | None = None, path: str | None = None, paths: list[str] | None = None, limit: int = 10, index: SearchIndex | None = None) -> DataFrame:
    """Strict matches first; a project with fewer than ``limit`` gets looser ones whose title is near the query.

    Of the 2 * limit best rows with any phrase, those with a cosine of at least 0.15 follow in the order
    of their score raised by half the cosine. One look at the postings serves both passes.
    """
    wanted = phrases(query)
    if not wanted:
        return search(memories, query, as_of, category=category, path=path, paths=paths, limit=limit)
    found = active(score(memories, wanted, index=index)).where(path_matches(path, paths) & (F.col("category") == category if category else F.lit(True)))
    found = found.withColumn("score", tri_factor(as_of)).withColumn("strict", F.col("_matched") == len(wanted))
    found = cut(found, "found")
    # each limit applies before the exchange: the best of any kind, and the best strict ones
    broad = _ranked(found, [F.col("score"), F.col("id")], 2 * limit).where(~F.col("strict"))
    pool = _ranked(found.where("strict"), [F.col("score"), F.col("id")], limit).unionByName(broad)
    near = scalar.cosine_to(scalar.query_terms(query), F.col("what"))
    pool = with_once(pool, {"_cos": F.when(~F.col("strict"), near)}).where(F.col("strict") | (F.col("_cos") >= COSINE_FLOOR))
    pool = pool.withColumn("score", F.when(F.col("strict"), F.col("score")).when(F.col("score") == 0, -F.col("_cos")).otherwise(F.col("score") * (1 + 0.5 * F.col("_cos"))))
    rows = _ranked(pool, [F.desc("strict"), F.col("score"), F.col("id")], limit)
    return rows.withColumn("what", text.redact(F.col("what"))).select("project_id", *COMPACT, "score", "rank", "strict")


def similar_titles(memories: DataFrame, title: str, limit: int = 5, threshold: float = 0.85, index: SearchIndex | None = None) -> DataFrame:
    """Memories whose title shares most tokens with ``title``: of the 3 * limit best of each project, the first ``limit`` at or above the threshold."""
    wanted = title_phrases(title)
    found = active(score(memories, wanted, (1.0, 1.0, 1.0), index)) if wanted else active(memories).where("false").withColumn("_bm25", F.lit(0.0))
    best = _ranked(found, [F.col("_bm25"), F.col("id")], limit * 3)
    mine = F.array_distinct(text.title_tokens(F.lit(title)))
    near = best.withColumn("_sim", scalar.jaccard(mine, text.title_tokens(F.col("what")))).where(F.col("_sim") >= threshold)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("rank"))).where(F.col("rank") <= limit)
    return first.select("project_id", "id", "category", "what", scalar.round2(F.col("_sim")).alias("similarity"), "rank")


def preflight(memories: DataFrame, title: str, what: str, threshold: float = 0.45, pool: int = 30, index: SearchIndex | None = None) -> DataFrame:
    """Rules that a proposal may break: project_id, memory_id, category, what, pinned, similarity, severity, verdict.

    Standards, decisions and architecture that share a token, pinned ones first; at or above the threshold a pinned rule blocks and any other warns.
    ``verdict`` is the worst of the project; a project without issues has no row and passes.
    """
    wanted = title_phrases(title + " " + what)
    rules = F.col("category").isin("standard", "decision", "architecture")
    found = active(score(memories, wanted, (1.0, 1.0, 1.0), index)).where(rules) if wanted else active(memories).where("false").withColumn("_bm25", F.lit(0.0))
    best = _ranked(found, [F.desc_nulls_last("pinned"), F.col("_bm25"), F.col("id")], pool)
    mine = F.array_distinct(text.title_tokens(F.lit(title + " " + what)))
    near = best.withColumn("_sim", scalar.jaccard(mine, text.title_tokens(F.col("what")))).where(F.col("_sim") >= threshold)
    severity = F.when(F.coalesce("pinned", F.lit(False)), "BLOCK").otherwise("WARN")
    issues = near.select("project_id", F.col("id").alias("memory_id"), "category", "what", F.coalesce("pinned", F.lit(False)).alias("pinned"), scalar.round2(F.col("_sim")).alias("similarity"), severity.alias("severity"))
    return issues.withColumn("verdict", F.min("severity").over(Window.partitionBy("project_id")))
