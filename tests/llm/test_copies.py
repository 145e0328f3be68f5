import numpy as np
from pyspark.sql import functions as F

from knowloom.llm.copies import PASS_BITS, _has, _positions, _set, canonical_field, copy_groups, passes_and_bits
from knowloom.tables import MEMORIES


def _groups(spark, rows):
    df = spark.createDataFrame([{"id": i, "project_id": p, "what": a, "why": b} for i, p, a, b in rows], MEMORIES)
    return {r.key: (r.group_id, r.n_copies) for r in copy_groups(df).collect()}


def test_formatting_order_and_swapped_fields(spark):
    rows = [
        ("a", "p", "Fix the cache-loader", "cause: x y; window: z"),
        ("b", "p", "  FIX   the *CacheLoader*!", "- WINDOW : Z\n- Cause: * X\ny"),
        ("c", "p", "(cause:x y | Window:z)", "fix the cache loader"),
        ("d", "p", "Fix the cache-loader", "cause: x z; window: y"),
        ("e", "q", "Fix the cache-loader", "cause: x y; window: z"),
        ("f", "p", "GROSSE Straße", None),
        ("g", "p", "", "große STRASSE."),
        ("h", "p", None, None),
        ("i", "p", "?!", " "),
        ("j", None, "one", "two"),
        ("k", None, "two", "one"),
        ("l", "p", "reads: one, two", "x"),
        ("m", "p", "reads: two, one", "x"),
    ]
    got = _groups(spark, rows)
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "f", "h": "h", "i": "h", "j": "j", "k": "j", "l": "l", "m": "m"}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["a"][1] == 3 and got["d"][1] == 1


def test_empty_table(spark):
    assert _groups(spark, []) == {}


def test_hot_group_and_long_text(spark):
    df = spark.range(0, 3000).selectExpr("cast(id AS string) AS id", "'p' AS project_id", "case when id % 3 = 0 then repeat('ab ', 50000) else concat('t', id) end AS what", "'w' AS why", "1 AS digest", "id AS h")
    got = copy_groups(df.repartition(7)).collect()
    assert len(got) == 3000
    assert {r.n_copies for r in got if int(r.key) % 3 == 0} == {1000} and {r.n_copies for r in got if int(r.key) % 3} == {1}


def test_several_passes_change_nothing(spark):
    df = spark.range(0, 60_000).selectExpr("cast(id AS string) AS id", "'p' AS project_id", "concat('t', id % 50000) AS what", "'w' AS why").repartition(5)
    assert passes_and_bits(60_000, 1 << 18)[0] == 4
    got = copy_groups(df, pass_bits=1 << 18)
    assert got.count() == 60_000 and got.where("n_copies = 2").count() == 20_000 and got.where("n_copies = 1").count() == 40_000


def test_filters_keep_their_bits_a_record_at_any_size():
    for rows in (0, 1, 5_000, 16_777_216, 16_777_217, 10**9, 10**11):
        ranges, bits = passes_and_bits(rows)
        assert bits & (bits - 1) == 0 and bits <= PASS_BITS and ranges * bits >= 16 * rows


def test_filter_has_no_false_negative():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = passes_and_bits(len(h))[1]
    f = np.zeros(bits // 8, np.uint8)
    _set(f, _positions(h, bits))
    assert _has(f, _positions(h, bits)).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    assert _has(f, _positions(other, bits)).mean() < 0.01


def test_single_label_is_no_part_list(spark):
    df = spark.createDataFrame([("Session checkpoint: a b",), ("x: 1; y: 2",), ("z x: 1; y: 2",), (None,)], "c string").select(canonical_field(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["sessioncheckpointab", "\x01x1\x01y2", "zx1y2", ""]
