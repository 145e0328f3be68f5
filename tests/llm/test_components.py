import random

from knowloom.llm import components
from knowloom.llm.components import connected_groups, relation_links
from knowloom.tables import MEMORIES, MEMORY_RELATIONS


def _groups(spark, pairs, schema="src string, dst string"):
    return {r.id: r.group_id for r in connected_groups(spark.createDataFrame(pairs, schema)).collect()}


def _brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_chain_hub_cycle_repeats_and_nulls(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    random.Random(3).shuffle(chain)
    hub = [("hub", f"h{i:03d}") for i in range(200)]
    odd = [("x", "y"), ("y", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "a"), ("a", None)]
    pairs = chain + hub + odd
    assert _groups(spark, pairs) == _brute(pairs)


def test_hubs_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ARCS", 20)
    rnd = random.Random(8)
    pairs = [("hub", f"h{i:03d}") for i in range(300)] + [(f"h{rnd.randrange(300):03d}", f"x{i}") for i in range(80)] + [("y1", "y2"), ("y2", "y3")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert components.hubs(edges) == ["hub"]
    assert _groups(spark, pairs) == _brute(pairs)


def test_empty_and_extra_columns(spark):
    assert _groups(spark, []) == {}
    got = connected_groups(spark.createDataFrame([("b", "a", "v", 1)], "src string, dst string, center string, score int"))
    assert {(r.id, r.group_id) for r in got.collect()} == {("a", "a"), ("b", "a")}


def test_random_graph(spark):
    rnd = random.Random(5)
    pairs = [(str(rnd.randrange(400)), str(rnd.randrange(400))) for _ in range(220)]
    assert _groups(spark, pairs) == _brute(pairs)


def test_links_of_relations(spark):
    mem = spark.createDataFrame([{"id": i, "project_id": p} for i, p in [("a", "p"), ("b", "p"), ("c", "q"), ("d", "p")]], MEMORIES)
    rows = [("a", "b", "Relates To"), ("b", "a", " RELATES-to\t"), ("a", "c", "supersedes"), ("a", "a", "supersedes"), ("b", "d", "conflicts_with"),
            ("d", None, "supersedes"), ("d", "b", None), ("b", "d", "superSedes"), ("a", "", "relatesTo")]
    rel = spark.createDataFrame([{"id": str(i), "project_id": "p", "source_id": s, "target_id": t, "relation_type": k} for i, (s, t, k) in enumerate(rows)], MEMORY_RELATIONS)
    assert {(r.src, r.dst) for r in relation_links(rel, mem).collect()} == {("a", "b"), ("b", "d")}
