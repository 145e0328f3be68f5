"""Near-duplicate records with small edits.

Covering locality-sensitive hashing over word sets. Two sets of n and m words with a Jaccard similarity of at
least t differ in at most r = (1 - t) / (1 + t) * (n + m) words. Words are dealt to r // (s + 1) + 1 parts, so that in
some part the sets differ in at most s words. In each part every word draws a non-zero vector of s + 1 bits, and
table v keeps the words whose vector has an odd product with v: for any s vectors some v is even with all of them,
so in that table the pair agrees exactly. No pair within the radius is missed, whatever the draw.
Candidates pass a check of 128 parity bits, which cannot reject a pair within the radius, then the exact comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.runtime import broadcast_if_small, cut, release, salted_join

#: Differences that a part may hide (s above), a parameter of :func:`near_classes`: more gives longer keys, and so smaller
#: buckets, in more tables. Every value finds all pairs; 2 or 3 suit scopes of many millions of sets.
PART_RADIUS = 1
#: A task compares the keys of one way; there are as many ways as keep each at about so many bytes, KEY_BYTES a key.
WAY_BYTES, KEY_BYTES = 16 << 20, 24
#: A bucket of more sets is not compared in the task that gathered it but dealt out block against block, so that a task's work is bounded.
MOST_BUCKET, DEALT_BLOCK = 1 << 14, 1 << 13
_WORD = re.compile(r"[^\W_]+")
_CACHE = 1 << 20  # words whose hash a worker remembers
_MOST_BATCH = 50_000  # sets whose keys are dealt together
_BLOCK = 1 << 11  # rows and columns of a bucket compared at once
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _M[0] * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * _M[1]
        x = (x ^ (x >> np.uint64(27))) * _M[2]
        return x ^ (x >> np.uint64(31))


def word_sets(records: DataFrame, scope: str, key: str, fields: list[str]) -> DataFrame:
    """(key, scope, rid, n, words, digest): the distinct words of each record as sorted 64-bit hashes.

    Words are unbroken runs of letters and digits in the lower-cased fields; null is empty. The digest is of the words.
    Written to the shared folder, because rid must not change when a lost task is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets, digests = [], []
            for text in b.column("text").to_pylist():
                words = set(_WORD.findall(text.lower()))
                for w in words.difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                hashes.sort()
                sets.append(hashes.view(np.int64))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                if len(known) > _CACHE:
                    known.clear()
            n = np.array([len(s) for s in sets], np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("scope"), pa.array(n), lists, pa.array(digests, pa.binary())], ["key", "scope", "n", "words", "digest"])

    kind = records.schema[key].dataType.simpleString()
    text = records.select(F.col(key).alias("key"), F.coalesce(F.col(scope).cast("string"), F.lit("\x00")).alias("scope"), F.concat_ws(" ", *fields).alias("text"))
    sets = text.mapInArrow(run, f"key {kind}, scope string, n int, words array<bigint>, digest binary")
    return cut(sets.withColumn("rid", F.monotonically_increasing_id()), "words")


def size_bands(t: float, most: int) -> list[tuple[int, int, int, int]]:
    """(band, low, high, top): sets of low <= n < high meet sets of up to top words in this band. Each pair meets in the band of its smaller set."""
    out, low, band = [], 1, 0
    while low <= most:
        high = max(low + 1, int(np.ceil(low / t)))
        out.append((band, low, high, int((high - 1) / t + 1e-9)))
        low, band = high, band + 1
    return out


def most_differences(t: float, n: int | np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return np.floor((1 - t) / (1 + t) * (np.asarray(n) + m) + 1e-9)


def key_counts(sizes: np.ndarray, t: float, s: int) -> np.ndarray:
    """How many keys :func:`table_keys` gives a set of each size."""
    out = np.zeros(len(sizes), np.int64)
    for _, low, high, top in size_bands(t, int(sizes.max(initial=0))):
        out[(sizes >= low) & (sizes <= top)] += (int(most_differences(t, high - 1, top)) // (s + 1) + 1) * ((1 << (s + 1)) - 1)
    return out


def count_ways(sets: DataFrame, t: float, s: int, way_bytes: int = WAY_BYTES) -> int:
    """The number of ways for all keys of ``sets``, from the histogram of their sizes: one row a size comes to the driver."""
    rows = sets.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()
    sizes, counts = np.array([r["n"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64)
    total = int((key_counts(sizes, t, s) * counts).sum()) * KEY_BYTES
    return max(sets.sparkSession.sparkContext.defaultParallelism, -(-total // way_bytes))


def table_keys(words: np.ndarray, sizes: np.ndarray, scopes: np.ndarray, t: float, s: int = PART_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tables for a batch of sets: (keys, index of the set). words: hashes of all sets in turn; scopes: a hash for each set."""
    keys, owner = [], []
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for band, low, high, top in size_bands(t, int(sizes.max(initial=0))):
        members = np.flatnonzero((sizes >= low) & (sizes <= top))
        if not len(members):
            continue
        parts = int(most_differences(t, high - 1, top)) // (s + 1) + 1
        n = sizes[members]
        pick = np.repeat(starts[members] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w = words[pick]
        drawn = _mix(w, 2 * band)
        cell = np.repeat(np.arange(len(members)) * parts, n) + ((drawn >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, w, drawn = cell[order], w[order], drawn[order]
        vector = np.uint64(1) + (drawn & np.uint64(0xFFFFFF)) % np.uint64((1 << (s + 1)) - 1)
        value = _mix(w, 2 * band + 1)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        place = _mix(np.repeat(scopes[members], parts) ^ np.tile(_mix(np.arange(parts, dtype=np.uint64), band), len(members)), band)
        for v in range(1, 1 << (s + 1)):
            odd = (np.bitwise_count(vector & np.uint64(v)) & 1).astype(np.uint64)
            kept = np.zeros(len(members) * parts, np.uint64)
            kept[cell[first]] = np.add.reduceat(value * odd, first)
            keys.append(_mix(kept ^ place, v))
            owner.append(np.repeat(members, parts))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def parity_bits(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits a set, as two columns of 64: bit i is the parity of the words that hash to i."""
    at = _mix(words, 77)
    one = np.uint64(1) << (at & np.uint64(63))
    low = (at >> np.uint64(6)) & np.uint64(1) == 0
    both = np.stack([np.where(low, one, np.uint64(0)), np.where(low, np.uint64(0), one)], axis=1)
    out = np.zeros((len(sizes), 2), np.uint64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(both, np.concatenate([[0], np.cumsum(sizes)[:-1]])[some], axis=0)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed; each leads with its length."""
    raw = b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, columns in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        width = np.dtype(kind).itemsize * columns
        planes = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n)
        values = np.ascontiguousarray(planes.T).view(kind).reshape((n, columns) if columns > 1 else n)
        out.append(values)
        at += 8 + n * width
    return out


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until each has ``least`` rows, the last as many as are left."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _deal(sets: DataFrame, t: float, s: int, ways: int) -> DataFrame:
    """(way, blob): the keys of all sets, dealt by key range; a blob has the keys of one batch in order, and what its sets need.

    With many ways batches are joined, so that a blob still has keys enough to share what its sets need.
    """
    least = min(_MOST_BATCH, 16 * ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, ways, dtype=np.float64) / ways * 2.0**64).astype(np.uint64)
        for b in _gathered(batches, least):
            column = b.column("words")
            words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            rids = b.column("rid").to_numpy(zero_copy_only=False)
            scopes = b.column("scope_hash").to_numpy(zero_copy_only=False).view(np.uint64)
            keys, owner = table_keys(words, sizes, scopes, t, s)
            bits = parity_bits(words, sizes)
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            ids, blobs = [], []
            for way in range(ways):
                k, o = keys[cuts[way] : cuts[way + 1]], owner[cuts[way] : cuts[way + 1]]
                if len(k):
                    own, index = np.unique(o, return_inverse=True)
                    ids.append(way)
                    blobs.append(_pack(np.diff(k, prepend=np.uint64(0)), index.astype(np.uint32), rids[own], sizes[own].astype(np.uint32), bits[own]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["way", "blob"])

    return sets.select("rid", "n", "words", F.xxhash64("scope").alias("scope_hash")).mapInArrow(run, "way int, blob binary")


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of sets the parity bits and the sizes leave possible; a and b may be of any shape that broadcasts."""
    apart = np.bitwise_count(bits[a, 0] ^ bits[b, 0]).astype(np.int16) + np.bitwise_count(bits[a, 1] ^ bits[b, 1])
    total, least = n[a] + n[b], np.minimum(n[a], n[b])
    return (apart <= (1 - t) / (1 + t) * total + 1e-9) & (least >= t * (total - least) - 1e-9)


def _buckets(keys: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in key order, where each bucket of equal keys begins, its size)."""
    order = np.argsort(keys, kind="stable")
    keys, index = keys[order], index[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return index, first, np.diff(np.append(first, len(keys)))


def block_pairs(left: np.ndarray, right: np.ndarray | None, n: np.ndarray, bits: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs between two blocks of sets, or within one, in squares of bounded memory."""
    for i in range(0, len(left), _BLOCK):
        other = left[i:] if right is None else right
        for j in range(0, len(other), _BLOCK):
            a, b = left[i : i + _BLOCK], other[j : j + _BLOCK]
            x, y = np.nonzero(_near(a[:, None], b[None, :], n, bits, t))
            if right is None and j == 0:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield a[x], b[y]


def bucket_pairs(keys: np.ndarray, index: np.ndarray, n: np.ndarray, bits: np.ndarray, t: float, most: int = MOST_BUCKET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs among the sets that share a key, in buckets of up to ``most``. Buckets of one small size are compared together."""
    index, first, count = _buckets(keys, index)
    n = n.astype(np.float32)
    for c in np.unique(count[(count > 1) & (count <= most)]):
        at = first[count == c]
        if c <= 24:
            member = index[at[:, None] + np.arange(c)]
            for i in range(c - 1):
                a, b = member[:, i : i + 1], member[:, i + 1 :]
                x, y = np.nonzero(_near(a, b, n, bits, t))
                if len(x):
                    yield a[x, 0], b[x, y]
        else:
            for f in at:
                yield from block_pairs(index[f : f + c], None, n, bits, t)


def large_buckets(keys: np.ndarray, index: np.ndarray, most: int = MOST_BUCKET) -> Iterator[np.ndarray]:
    """The members of each bucket of more than ``most`` sets."""
    index, first, count = _buckets(keys, index)
    for f, c in zip(first[count > most], count[count > most]):
        yield index[f : f + c]


def _compare_blocks(blocks: DataFrame, t: float) -> DataFrame:
    """Possible pairs of the dealt blocks of large buckets, one row of two blocks (the second empty within one) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ((np.int64, 1), (np.uint32, 1), (np.uint64, 2))
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                parts = [_unpack(x.as_py(), *kinds) for x in (left, right) if x.as_py() is not None]
                rid, n, bits = (np.concatenate([p[k] for p in parts]) for k in range(3))
                cut_at = len(parts[0][0])
                one, two = np.arange(cut_at), np.arange(cut_at, len(rid)) if len(parts) > 1 else None
                for a, b in block_pairs(one, two, n.astype(np.float32), bits, t):
                    a, b = rid[a], rid[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint").where("a <> b")


def candidate_pairs(sets: DataFrame, t: float, s: int = PART_RADIUS, way_bytes: int = WAY_BYTES) -> DataFrame:
    """Distinct pairs (a, b) of rids, a < b, that share a key in some table and that the parity bits do not rule out.

    A task compares the buckets of its range of keys; the members of a bucket too large for that are dealt out in
    blocks, and every pair of blocks is a row of its own for the whole cluster.
    """
    ways = count_ways(sets, t, s, way_bytes)
    most, size = MOST_BUCKET, DEALT_BLOCK

    def compare(blobs: list[bytes]) -> pa.RecordBatch:
        kept_keys, kept_index, rids, sizes, bits, base = [], [], [], [], [], 0
        for blob in blobs:
            k, i, r, z, p = _unpack(blob, (np.uint64, 1), (np.uint32, 1), (np.int64, 1), (np.uint32, 1), (np.uint64, 2))
            kept_keys.append(np.cumsum(k, dtype=np.uint64))
            kept_index.append(i.astype(np.int64) + base)
            rids.append(r)
            sizes.append(z)
            bits.append(p)
            base += len(r)
        keys, index = np.concatenate(kept_keys), np.concatenate(kept_index)
        rid, n, bit = np.concatenate(rids), np.concatenate(sizes), np.concatenate(bits)
        packed, waiting = [], 0
        for a, b in bucket_pairs(keys, index, n, bit, t, most):
            a, b = rid[a], rid[b]
            packed.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            waiting += len(a)
            if waiting > 1 << 20:
                packed, waiting = [np.unique(np.concatenate(packed), axis=0)], 0
        pairs = np.unique(np.concatenate(packed), axis=0) if packed else np.empty((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        left, right = [], []
        for member in large_buckets(keys, index, most):
            blocks = [_pack(rid[m], n[m], bit[m]) for m in (member[k : k + size] for k in range(0, len(member), size))]
            for i, x in enumerate(blocks):
                left += [x] * (len(blocks) - i)
                right += [None, *blocks[i + 1 :]]
        none = [None] * len(pairs)
        a = pa.array(np.concatenate([pairs[:, 0], np.zeros(len(left), np.int64)]))
        b = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(left), np.int64)]))
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "left": pa.array(none + left, pa.binary()), "right": pa.array(none + right, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for way, blob in zip(batch.column("way").to_pylist(), batch.column("blob").to_pylist()):
                held.setdefault(way, []).append(blob)
        for way in sorted(held):
            yield compare(held.pop(way))

    # each way is a partition of its own
    found = cut(_deal(sets, t, s, ways).repartitionById(ways, "way").mapInArrow(run, "a bigint, b bigint, left binary, right binary"), "compared")
    dealt = found.where("left IS NOT NULL").select("left", "right").repartition(ways)
    return found.where("left IS NULL").select("a", "b").unionByName(_compare_blocks(dealt, t)).distinct()


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_classes(records: DataFrame, scope: str = "project_id", key: str = "id", fields: tuple[str, ...] = ("what", "why", "learned"), t: float = 0.7, s: int = PART_RADIUS) -> tuple[DataFrame, DataFrame]:
    """All pairs of records of one scope whose word sets have a Jaccard similarity of at least ``t``, without repeating copies.

    Returns (members, pairs). members: (key, class_id), every record with the least key of those that have the same
    words. pairs: (a, b, similarity), class ids a < b. Together they hold every pair of similar records.
    A record without words is a class of its own and in no pair; null scopes form a scope of their own. Keys
    are taken to be unique; a repeated row comes out as often as it occurs. Texts are read whole; extra columns are not looked at.
    """
    sets = word_sets(records, scope, key, list(fields))
    worded = sets.where("n > 0")
    named = worded.groupBy("scope", "digest").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    copies = cut(salted_join(worded.select("key", "scope", "digest"), named.where("_n > 1").drop("_n"), ["scope", "digest"]).select("key", "class_id"), "copies")
    again = copies.where("key <> class_id").select("key")
    single = worded.join(broadcast_if_small(again), "key", "left_anti")
    found = cut(candidate_pairs(single, t, s), "candidates")
    ends = cut(found.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ends")
    needed = sets.join(broadcast_if_small(ends), "rid", "left_semi")
    side = lambda x: needed.select(F.col("rid").alias(x), F.col("key").alias(f"{x}_key"), F.col("scope").alias(f"{x}_scope"), F.col("words").alias(f"{x}_words"))
    both = found.join(side("a"), "a").join(side("b"), "b").where("a_scope = b_scope").withColumn("similarity", jaccard(F.col("a_words"), F.col("b_words")))
    pairs = both.where(F.col("similarity") >= t).select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"), "similarity")
    pairs = cut(pairs, "pairs")
    members = cut(sets.select("key").join(copies, "key", "left").select("key", F.coalesce("class_id", "key").alias("class_id")), "members")
    release(sets, copies, found, ends)
    return members, pairs


def near_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of classes written out for their records, and all pairs within a class.

    Only for results that are stated as pairs of records: copies multiply.
    """
    one = lambda x: members.select(F.col("class_id").alias(x), F.col("key").alias(f"{x}_key"))
    across = pairs.join(one("a"), "a").join(one("b"), "b")
    within = one("a").join(members.select(F.col("class_id").alias("a"), F.col("key").alias("b_key")), "a").where("a_key < b_key")
    return across.select("a_key", "b_key").unionByName(within.select("a_key", "b_key")).select(F.least("a_key", "b_key").alias("id_a"), F.greatest("a_key", "b_key").alias("id_b"))


def near_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): each record with its class, the least class reached through similar pairs, and how many classes its own is similar to."""
    from knowloom.llm.components import connected_groups

    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_groups(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "class_id")
    known = groups.join(links, "class_id")
    return members.join(known, "class_id", "left").select(F.col("key").alias("id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
