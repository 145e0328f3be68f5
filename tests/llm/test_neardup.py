import random

import numpy as np
import pytest

from knowloom.llm import neardup
from knowloom.llm.neardup import bucket_pairs, most_differences, near_classes, near_groups, near_pairs, parity_bits, size_bands, table_keys
from knowloom.tables import MEMORIES


def _brute(rows, t=0.7):
    import re

    sets = [(i, p, set(re.findall(r"[^\W_]+", " ".join(x for x in f if x).lower()))) for i, p, *f in rows]
    out = set()
    for k, (i, p, a) in enumerate(sets):
        for j, q, b in sets[k + 1 :]:
            if p == q and a | b and len(a & b) / len(a | b) >= t:
                out.add((min(i, j), max(i, j)))
    return out


def _rows(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and", "a"] * 20
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            words = rows[rnd.randrange(len(rows))][2].split()
            for _ in range(rnd.randrange(0, 9)):
                k = rnd.randrange(len(words) + 1)
                words[k : k + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
            if rnd.random() < 0.3:
                rnd.shuffle(words)
        else:
            words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 8, 20, 40, 90]))]
        rows.append((f"m{i:04d}", rnd.choice(["p", "p", "q", None]), " ".join(words), rnd.choice([None, "", "x"]), None))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([dict(zip(("id", "project_id", "what", "why", "learned"), r)) for r in rows], MEMORIES)


def test_every_pair_of_similar_records_is_found(spark):
    rows = _rows()
    rows += [("e1", "p", None, None, None), ("e2", "p", "", "?!", None), ("c1", "p", rows[0][2].upper(), rows[0][3], None), ("c2", rows[0][1], rows[0][2], rows[0][3], None)]
    members, pairs = near_classes(_frame(spark, rows))
    got = [(r.id_a, r.id_b) for r in near_pairs(members, pairs).collect()]
    want = _brute(rows)
    assert len(got) == len(set(got))
    assert set(got) == want


def test_groups_hold_linked_records(spark):
    rows = [("a", "p", "one two three four five six seven eight nine ten", None, None), ("b", "p", "one two three four five six seven eight nine", None, None),
            ("c", "p", "one two three four five six seven eight", None, None), ("d", "p", "One, two three four five six seven eight!", None, None), ("z", "p", "other", None, None)]
    got = {r.id: (r.class_id, r.group_id, r.n_links) for r in near_groups(*near_classes(_frame(spark, rows), t=0.85)).collect()}
    assert got == {"a": ("a", "a", 1), "b": ("b", "a", 2), "c": ("c", "a", 1), "d": ("c", "a", 1), "z": ("z", "z", 0)}


def test_empty_and_clashing_columns(spark):
    members, pairs = near_classes(_frame(spark, []))
    assert members.count() == 0 and pairs.count() == 0
    df = spark.createDataFrame([("a", "p", "x y", "1"), ("b", "p", "y x", "2")], "id string, project_id string, what string, digest string").selectExpr("*", "'' AS why", "'' AS learned", "1 AS n", "2 AS rid")
    assert [tuple(r) for r in near_pairs(*near_classes(df)).collect()] == [("a", "b")]


@pytest.mark.parametrize("s", [0, 1, 2])
def test_tables_cover_the_radius(s):
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 120))
        m = int(rng.integers(n, max(n + 1, int(n / 0.7) + 1)))
        shared = int(np.ceil(0.7 / 1.7 * (n + m) - 1e-9))
        if shared > n:
            continue
        pool = rng.integers(0, 2**63, n + m - shared).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n:]])
        keys, owner = table_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), np.zeros(2, np.uint64), 0.7, s)
        assert set(keys[owner == 0]) & set(keys[owner == 1])
        bits = parity_bits(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= most_differences(0.7, len(a), len(b))


def test_bands_join_every_allowed_pair_of_sizes():
    bands = size_bands(0.7, 300)
    for n in range(1, 200):
        for m in range(n, min(300, int(n / 0.7 + 1e-9)) + 1):
            assert any(low <= n < high and m <= top for _, low, high, top in bands)


def test_buckets_too_large_for_a_task_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_BUCKET", 4)
    monkeypatch.setattr(neardup, "DEALT_BLOCK", 3)
    rows = _rows(seed=6, n=80)
    got = {(r.id_a, r.id_b) for r in near_pairs(*near_classes(_frame(spark, rows))).collect()}
    assert got == _brute(rows)


def test_larger_radius_finds_the_same(spark):
    rows = _rows(seed=7, n=60)
    assert {(r.id_a, r.id_b) for r in near_pairs(*near_classes(_frame(spark, rows), s=2)).collect()} == _brute(rows)


def test_large_buckets_go_in_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 7)
    bits = np.zeros((40, 2), np.uint64)
    got = [(min(x, y), max(x, y)) for a, b in bucket_pairs(np.full(40, 5, np.uint64), np.arange(40), np.full(40, 9), bits, 0.7) for x, y in zip(a, b)]
    assert len(got) == len(set(got)) == 40 * 39 // 2


def test_ways_follow_the_counted_keys(spark):
    sizes = np.array([1, 7, 40, 90])
    keys, owner = table_keys(np.arange(sizes.sum()).astype(np.uint64), sizes, np.zeros(4, np.uint64), 0.7)
    assert (np.bincount(owner) == neardup.key_counts(sizes, 0.7, 1)).all()
    rows = _rows(seed=8, n=90)
    sets = neardup.word_sets(_frame(spark, rows), "project_id", "id", ["what", "why", "learned"]).where("n > 0")
    few, many = (neardup.count_ways(sets, 0.7, 1, b) for b in (1 << 30, 1 << 13))
    assert few == spark.sparkContext.defaultParallelism < many
    pairs = lambda w: sorted((r.a, r.b) for r in neardup.candidate_pairs(sets, 0.7, 1, w).collect())
    assert pairs(1 << 30) == pairs(1 << 13)
