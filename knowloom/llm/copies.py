"""Duplicates hidden by formatting differences.

Records get a canonical digest that formatting does not reach. The hashes of the digests fall into as many ranges as
filters of a fixed size need, and each range is one pass: every partition notes in two Bloom filters which digests it saw
once and which repeatedly; the filters merge block by block, and the merged filter of repeats marks the records that may
have a copy. Only those are shuffled and grouped exactly. All others are singletons without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.runtime import cut, read_cut, release, salted_join, shared_path

#: Bits of the filter for each record, and of one pass's filter (32 MB, the bound of what is broadcast at once). More records take more passes.
BITS_PER_RECORD, PASS_BITS = 16, 1 << 28
_HASHES = 4
_BLOCK = 1 << 13  # bytes
#: Where a new ``label: value`` part may begin; group 2 is the label with its colon.
PART = r"(^|[;|\n,/])[^\p{L}\p{N}]*(\p{L}+[^\p{L}\p{N}:]*:)"


def letters_and_digits(c: Column) -> Column:
    """Letters and digits only, in lower case, with ß as ss, which its capitals read as."""
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit("ß"), F.lit("ss"))


def canonical_field(c: Column) -> Column:
    """The letters and digits of a field; of two or more ``label: value`` parts, those of the sorted parts.

    Null is as empty. A field counts as made of parts when nothing but punctuation stands before the first label.
    """
    c = F.coalesce(c, F.lit(""))
    parts = F.transform(F.split(F.regexp_replace(c, PART, "\x01$2"), "\x01"), letters_and_digits)
    labelled = (F.size(parts) > 2) & (F.element_at(parts, 1) == "")
    return F.when(labelled, F.array_join(F.array_sort(parts), "\x01")).otherwise(letters_and_digits(c))


def canonical_digests(records: DataFrame, scope: str, key: str, fields: list[str]) -> DataFrame:
    """(key, scope, digest, h): a 128-bit digest of scope and the canonical fields in any order, and 64 bits for the filters."""
    texts = F.array_sort(F.array(*[canonical_field(F.col(f)) for f in fields]))
    named = F.concat_ws("\x02", F.coalesce(F.col(scope), F.lit("\x03")), F.array_join(texts, "\x02"))
    return records.select(F.col(key).alias("key"), F.unhex(F.md5(named)).alias("digest")).withColumn("h", F.xxhash64("digest"))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 64-bit hashes, one row for each of the hash functions (double hashing)."""
    u = h.astype(np.int64).view(np.uint64)
    a, b = u, (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1) for i in range(_HASHES)])


def _set(filt: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(filt, (pos >> np.uint64(3)).astype(np.int64).ravel(), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8)).ravel())


def _has(filt: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((filt[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _pressed(bits: np.ndarray) -> bytes:
    """A block for the shuffle; most bits of one partition's filter are not set."""
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def _bits(pressed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(pressed), np.uint8)


def repeat_filter(digests: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of hashes seen more than once, over all partitions: bits / 8 bytes, gathered block by block."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, more = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(batch["h"].to_numpy(), return_counts=True)
            pos = _positions(h, bits)
            again = (n > 1) | _has(once, pos).astype(bool)
            _set(more, pos[:, again])
            _set(once, pos)
        for i in range(0, len(once), _BLOCK):
            a = once[i : i + _BLOCK]
            if a.any():
                yield pd.DataFrame({"block": [i // _BLOCK], "once": [_pressed(a)], "more": [_pressed(more[i : i + _BLOCK])]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, more = _bits(group["once"].iloc[0]).copy(), _bits(group["more"].iloc[0]).copy()
        for a, b in zip(map(_bits, group["once"].iloc[1:]), map(_bits, group["more"].iloc[1:])):
            more |= b | (once & a)
            once |= a
        return pd.DataFrame({"block": [group["block"].iloc[0]], "once": [_pressed(once)], "more": [_pressed(more)]})

    schema = "block int, once binary, more binary"
    parts = digests.select("h").mapInPandas(build, schema).withColumn("wave", F.spark_partition_id() % 64)
    waves = parts.groupBy("block", "wave").applyInPandas(lambda g: merge(g), schema)
    whole = np.zeros(bits // 8, np.uint8)
    for row in waves.groupBy("block").applyInPandas(lambda g: merge(g), schema).select("block", "more").toLocalIterator():
        bits_of = _bits(row.more)
        whole[row.block * _BLOCK : row.block * _BLOCK + len(bits_of)] = bits_of
    return whole


def passes_and_bits(rows: int, pass_bits: int = PASS_BITS) -> tuple[int, int]:
    """How many ranges of hashes a number of records takes, and the bits of each range's filter: a power of two, BITS_PER_RECORD a record at least."""
    ranges = max(1, -(-rows * BITS_PER_RECORD // pass_bits))
    each = -(-rows // ranges) * BITS_PER_RECORD
    return ranges, max(8 * _BLOCK, 1 << (each - 1).bit_length() if each else 0)


def mark_repeats(digests: DataFrame, pass_bits: int = PASS_BITS) -> DataFrame:
    """(key, digest, again): whether a record may have a copy; false is certain. One pass over each range of hashes, read from a folder of its own."""
    spark = digests.sparkSession
    ranges, bits = passes_and_bits(digests.count(), pass_bits)
    by_range, marked = shared_path(spark, "ranges"), shared_path(spark, "marked")
    # the range comes from other bits of the hash than the place in the filter
    digests.withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int")).write.partitionBy("range").parquet(by_range)
    schema = T.StructType([*digests.schema.fields, T.StructField("range", T.IntegerType())])
    for k in range(ranges):
        part = spark.read.schema(schema).parquet(by_range).where(F.col("range") == k).drop("range")
        seen = spark.sparkContext.broadcast(repeat_filter(part, bits))

        def maybe(batches: Iterator[pd.DataFrame], seen=seen) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for b in batches:
                again = _has(seen.value, _positions(b.pop("h").to_numpy(), bits)).astype(bool)
                yield b.assign(again=again)

        kind = digests.schema["key"].dataType.simpleString()
        part.select("key", "digest", "h").mapInPandas(maybe, f"key {kind}, digest binary, again boolean").write.mode("append").parquet(marked)
        seen.destroy()
    out = read_cut(spark, marked, T.StructType([digests.schema["key"], digests.schema["digest"], T.StructField("again", T.BooleanType())]))
    release(read_cut(spark, by_range, schema))
    return out


def copy_groups(records: DataFrame, scope: str = "project_id", key: str = "id", fields: tuple[str, ...] = ("what", "why"), pass_bits: int = PASS_BITS) -> DataFrame:
    """(key, group_id, n_copies) for every record: group_id is the least key among its copies, itself for a singleton.

    Copies agree in ``scope`` and, but for formatting, in ``fields`` (see :func:`canonical_field`; the fields may
    have traded places). Null and empty fields are alike, records empty in all fields are copies of one another
    within their scope, null scopes form a scope of their own. Keys are taken to be unique. Whole texts of any length count.
    An empty table gives an empty result; extra columns are not looked at.
    """
    digests = cut(canonical_digests(records, scope, key, list(fields)), "digests")
    marked = mark_repeats(digests, pass_bits)
    release(digests)
    repeats = marked.where("again").select("key", "digest")
    groups = repeats.groupBy("digest").agg(F.min("key").alias("group_id"), F.count(F.lit(1)).alias("n_copies"))
    exact = salted_join(repeats, groups, ["digest"]).select("key", "group_id", "n_copies")
    alone = marked.where(~F.col("again")).select("key", F.col("key").alias("group_id"), F.lit(1).cast("long").alias("n_copies"))
    return exact.unionByName(alone)
