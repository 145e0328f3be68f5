import datetime as dt

from knowloom.operators.references import broken_references, orphan_references, reference_report
from knowloom.tables import GRAPH_EDGES, GRAPH_NODES, MEMORIES, MEMORY_RELATIONS


def _df(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def test_orphans_with_nulls_blanks_ties_and_clashing_columns(spark):
    parents = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "c", 3), (None, "a", 4), ("p", None, 5), ("p", "a", 6)], "project_id string, key string, code int")
    refs = spark.createDataFrame(
        [("p", "a", 1), ("p", "c", 2), ("p", "c", 2), ("q", "c", 3), ("p", "", 4), ("p", None, 5), (None, "a", 6), ("p", "A", 7), ("p", "zz", 8)],
        "project_id string, key string, block int",
    )
    got = sorted((r.project_id, r.key, r.block) for r in orphan_references(refs, parents, ["project_id", "key"]).collect())
    assert got == [("p", "", 4), ("p", "A", 7), ("p", "c", 2), ("p", "c", 2), ("p", "zz", 8)]


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "project_id string, key string")
    refs = spark.createDataFrame([("p", "a")], "project_id string, key string")
    assert orphan_references(refs, empty, ["project_id", "key"]).count() == 1
    assert orphan_references(empty, refs, ["project_id", "key"]).count() == 0


def test_hot_key_and_many_runs_match_brute_force(spark):
    parents = spark.range(0, 3000).selectExpr("'p' AS project_id", "cast(id*2 AS string) AS key")
    refs = spark.range(0, 6000).selectExpr("'p' AS project_id", "case when id % 3 = 0 then '1' else cast(id AS string) end AS key", "id")
    got = {r.id for r in orphan_references(refs, parents, ["project_id", "key"]).collect()}
    have = {str(2 * i) for i in range(3000)}
    assert got == {i for i in range(6000) if ("1" if i % 3 == 0 else str(i)) not in have}


def test_kinds_and_report(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    mem = _df(spark, MEMORIES, [
        {"id": "m1", "project_id": "p", "created_at": t(1)},
        {"id": "m2", "project_id": "p", "created_at": t(1), "deleted_at": t(2)},
        {"id": "m3", "project_id": "p", "created_at": t(9)},
        {"id": "m4", "project_id": "q", "created_at": t(1)},
        {"id": "m5", "project_id": "p", "created_at": t(9), "deleted_at": t(10)},
    ])
    rel = _df(spark, MEMORY_RELATIONS, [{"id": f"r{i}", "project_id": "p", "target_id": k, "created_at": t(5)} for i, k in enumerate(["m1", "m2", "m3", "m4", " ", None, "x", "m5"])])
    nodes = _df(spark, GRAPH_NODES, [{"project_id": "p", "id": "n"}])
    edges = _df(spark, GRAPH_EDGES, [{"id": "e", "project_id": "p", "source_id": "n", "target_id": "gone"}] * 2 + [{"id": "f", "project_id": "q", "source_id": "n", "target_id": ""}])
    broken = broken_references(edges, nodes, rel, mem)
    got = sorted((r.tbl, r.row_id, r.field_name, r.kind) for r in broken.collect())
    assert got == [
        ("graph_edges", "e", "target_id", "missing"), ("graph_edges", "f", "source_id", "missing"),
        ("memory_relations", "r1", "target_id", "deleted"), ("memory_relations", "r2", "target_id", "late"),
        ("memory_relations", "r3", "target_id", "missing"), ("memory_relations", "r6", "target_id", "missing"), ("memory_relations", "r7", "target_id", "deleted"),
    ]
    assert {(r.kind, r.period): r.n_rows for r in reference_report(broken).where("tbl = 'memory_relations'").collect()} == {
        ("deleted", "2024-01"): 2, ("late", "2024-01"): 1, ("missing", "2024-01"): 2,
    }
