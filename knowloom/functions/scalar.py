"""Hashes, ages, weights and similarities as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import STOP_WORDS, raw_tokens

DAY_MICROS = 86_400_000_000
#: Days until a memory is due for review, by category; others as the default.
REVIEW_DAYS = {"decision": 180, "architecture": 180, "standard": 360, "bugfix": 90, "idea": 90}
REVIEW_DEFAULT = 180
#: Weight of a category in the ranking.
CATEGORY_WEIGHT = {"decision": 0.05, "architecture": 0.04, "standard": 0.03, "bugfix": 0.01}


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by NUL, nulls as empty."""
    parts: list[Column] = []
    for f in fields:
        parts += [F.coalesce(f, F.lit("")), F.lit("\x00")]
    return F.sha2(F.concat(*parts[:-1]), 256)


def new_id(*key: Column) -> Column:
    """16 hexadecimal digits that a repeated task makes again, from the columns that name the row."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 16)


def parse_time(c: Column) -> Column:
    """RFC 3339 or ``YYYY-MM-DD HH:MM:SS``; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def review_days(category: Column) -> Column:
    c = F.lower(category)
    out = F.lit(REVIEW_DEFAULT)
    for name, days in REVIEW_DAYS.items():
        out = F.when(c == name, days).otherwise(out)
    return out


def review_after(category: Column, since: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(since) + review_days(category).cast("bigint") * DAY_MICROS)


def age_days(as_of: datetime, t: Column) -> Column:
    """Whole days between ``t`` and ``as_of``, truncated towards zero as hours / 24."""
    micros = F.unix_micros(F.lit(as_of)) - F.unix_micros(t)
    return (F.signum(micros) * F.floor(F.abs(micros) / DAY_MICROS)).cast("bigint")


def recency(as_of: datetime, created_at: Column) -> Column:
    """1 for new or undated rows, falling slowly with the age in days."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of)) - F.unix_micros(created_at)) / DAY_MICROS)
    return F.lit(1.0) / (F.lit(1.0) + F.lit(0.001) * F.coalesce(age, F.lit(0.0)))


def importance(pinned: Column, category: Column, revisions: Column) -> Column:
    """At least 1: pinned rows, weighty categories and up to ten revisions add to it."""
    tier = F.lit(0.0)
    for name, weight in CATEGORY_WEIGHT.items():
        tier = F.when(category == name, weight).otherwise(tier)
    return 1.0 + F.coalesce(pinned, F.lit(False)).cast("int") * 0.25 + tier + F.least(F.coalesce(revisions, F.lit(0)), F.lit(10)) * 0.01


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared, either): how many distinct elements two arrays share, and how many are in either."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; two empty arrays are alike."""
    shared, either = overlap(a, b)
    return F.when(either == 0, 1.0).otherwise(shared / either)


def subword_terms(text: Column) -> Column:
    """array of struct(term, w): words weigh 2, their three-character pieces a half; stop words are skipped."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(raw_tokens(text), lambda t: ~F.array_contains(stop, t))
    whole = F.transform(words, lambda w: F.struct(F.concat(F.lit("w:"), w).alias("term"), F.lit(2.0).alias("w")))
    starts = lambda w: F.when(F.length(w) >= 3, F.sequence(F.lit(1), F.length(w) - 2)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(words, lambda w: F.transform(starts(w), lambda i: F.struct(F.concat(F.lit("g:"), F.substring(w, i, F.lit(3))).alias("term"), F.lit(0.5).alias("w")))))
    return F.concat(whole, grams)


def subword_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w): sparse vectors of unit length, one row a term. Texts without terms have no row."""
    terms = df.select(F.col(key), F.explode(subword_terms(F.col(text))).alias("t")).select(key, "t.*").groupBy(key, "term").agg(F.sum("w").alias("w"))
    norm = terms.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return terms.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def query_terms(text: str) -> dict[str, float]:
    """The unit vector of one short text, for the driver: a query's terms become literals of the plan."""
    import math
    import re

    out: dict[str, float] = {}
    for w in re.findall(r"[^\W_]+(?:[-_]*[^\W_]+)*|[\w-]+", text.lower()):
        if w in STOP_WORDS:
            continue
        out["w:" + w] = out.get("w:" + w, 0.0) + 2.0
        for i in range(len(w) - 2):
            g = "g:" + w[i : i + 3]
            out[g] = out.get(g, 0.0) + 0.5
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / norm for k, v in out.items()} if norm else {}


def cosine_to(vector: dict[str, float], text: Column) -> Column:
    """Cosine of a text's subword vector with a fixed one, row by row without a join; 0 for empty vectors."""
    terms = subword_terms(text)
    names = F.array_distinct(F.transform(terms, lambda t: t["term"]))
    weight = lambda n: F.aggregate(F.filter(terms, lambda t: t["term"] == n), F.lit(0.0), lambda a, t: a + t["w"])
    fixed = F.create_map(*[x for k, v in vector.items() for x in (F.lit(k), F.lit(v))]) if vector else F.create_map(F.lit(""), F.lit(0.0))
    weighed = F.transform(names, lambda n: F.struct(weight(n).alias("w"), F.coalesce(F.try_element_at(fixed, n), F.lit(0.0)).alias("q")))
    dot = F.aggregate(weighed, F.lit(0.0), lambda a, t: a + t["w"] * t["q"])
    norm = F.sqrt(F.aggregate(weighed, F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / norm))).otherwise(0.0)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def json_long(metadata: Column, key: str) -> Column:
    """A whole number in a node's metadata, null where the JSON is absent or broken or the value is none."""
    return F.floor(F.get_json_object(metadata, f"$.{key}").try_cast("double")).cast("bigint")


def json_double(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}").try_cast("double")


def json_carve(c: Column, opening: str = "{") -> Column:
    """The JSON object or array within prose: from the first opening to the last closing bracket, null without one."""
    pattern = r"(?s)(\{.*\})" if opening == "{" else r"(?s)(\[.*\])"
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found)
