import bisect
import random

import pytest

from knowloom.llm.packing import SegmentTree, fill_report, pack, pack_runs

SIZES = "doc_id bigint, n_tokens bigint"


def _brute(sizes, capacity):
    """Item by item, largest first, tightest open bin, lowest bin of equal ones."""
    left, place = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= s
        place.append((s, i))
    return sorted(place), left


def _histogram(sizes):
    return [(s, sizes.count(s)) for s in set(sizes)]


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_item_by_item(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 32, 100])
    sizes = [rnd.choice([rnd.randint(0, capacity), capacity // 3 or 1, 1]) for _ in range(rnd.randint(0, 120))]
    got = [(s, first + (r - a) // k) for s, a, b, first, k in pack_runs(_histogram(sizes), capacity) for r in range(a, b)]
    assert sorted(got) == _brute(sizes, capacity)[0]


def test_segment_tree_finds_the_tightest():
    rnd = random.Random(1)
    tree, have = SegmentTree(50), []
    for _ in range(400):
        x = rnd.randint(0, 50)
        if x in have:
            have.remove(x)
            tree.set(x, False)
        else:
            bisect.insort(have, x)
            tree.set(x, True)
        q = rnd.randint(0, 50)
        assert tree.tightest(q) == next((h for h in have if h >= q), None)


def test_millions_of_items_make_a_small_plan():
    plan = pack_runs([(s, 1_000_003) for s in range(1, 513)], 512)
    assert len(plan) < 20_000 and sum(b - a for _, a, b, _, _ in plan) == 512 * 1_000_003


def test_frames_whole_documents_and_capacity(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 5, 30, 99, 100, 101, 250, 1234]) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), SIZES).repartition(5)
    kinds = [("small", 100), ("large", 1000), ("none", 0), (None, 5)]
    rows = pack(df, kinds).collect()
    for kind, capacity in kinds[:2]:
        mine = [r for r in rows if r.container == kind]
        whole, bins = {}, {}
        for r in mine:
            whole.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
        assert max(bins.values()) <= capacity and set(bins) == set(range(len(bins)))
        for i, n in enumerate(sizes):
            n = n or 0
            assert sum(x for _, x in whole[i]) == n and [p for p, _ in sorted(whole[i])] == list(range(max(1, -(-n // capacity))))
        items = [r.n_tokens for r in mine]
        assert sorted((r.n_tokens, r.bin_id) for r in mine) == _brute(items, capacity)[0]
    report = {r.container: r for r in fill_report(pack(df, kinds), kinds).collect()}
    assert report["small"].n_tokens == sum(x or 0 for x in sizes)


def test_empty_inputs(spark):
    df = spark.createDataFrame([], SIZES)
    assert pack(df, [("a", 10)]).count() == 0 and pack(df, []).count() == 0
    assert [tuple(r) for r in pack(spark.createDataFrame([(1, 0), (2, 0)], SIZES), [("a", 10)]).orderBy("doc_id").collect()] == [("a", 0, 1, 0, 0), ("a", 0, 2, 0, 0)]
