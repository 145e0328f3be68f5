from pyspark.sql import functions as F

from knowloom.functions.scalar import json_double, json_long
from knowloom.operators import build as B
from knowloom.operators import graph as G

FILES = {
    "index.js": "import { help } from './utils';\nimport React from 'react';\nfunction start() {\n  help();\n}\n",
    "utils.js": "export function help() { return 1; }\n",
    "components/Button.tsx": "import { help } from '../utils';\nexport class Button {}\n",
    "main.py": "def go():\n    return run()\n\ndef run():\n    pass\n",
    "main.go": "package main\n\nfunc callerFunc() {\n\thelperFunc()\n}\n\nfunc helperFunc() {\n}\n",
    "schema.sql": "CREATE TABLE users (\n id INT PRIMARY KEY\n);\nCREATE TABLE posts (id INT);\nCREATE INDEX ix ON users (id);\nCREATE VIEW v AS SELECT 1;\nCREATE TYPE mood AS ENUM ('a');\n",
    "docs/README.md": "# Title\nSee [code](../main.py) and [[guide]].\n", "docs/guide.md": "## Part\n",
    "package.json": '{"dependencies": {"react": "1"}}',
}
S = "project_id string, path string, mtime_ms bigint, size bigint, content string"


def _files(spark, files, t=1):
    return spark.createDataFrame([("p", k, t if isinstance(t, int) else t.get(k, 1), len(v), v) for k, v in files.items()], S)


def _key(edges):
    return {(r.source_id, r.target_id, r.relation_type) for r in edges.collect()}


def test_build(spark):
    nodes, edges = B.build_graph(_files(spark, FILES))
    kinds = {r.node_type: r.n for r in nodes.where("path = 'schema.sql' AND id <> path").groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"table": 2, "index": 1, "view": 1, "type": 1}
    got = _key(edges)
    for e in [
        ("index.js", "utils.js", "imports"), ("components/Button.tsx", "utils.js", "imports"), ("index.js", "pkg:react", "imports"), ("package.json", "pkg:react", "depends_on"),
        ("main.go:callerFunc", "main.go:helperFunc", "calls"), ("main.py:go", "main.py:run", "calls"), ("index.js:start", "utils.js:help", "calls"), ("schema.sql", "schema.sql:users", "contains"),
        ("docs/README.md", "main.py", "references"), ("docs/README.md", "docs/guide.md", "references"), ("docs/README.md", "docs/README.md:Title", "contains"),
    ]:
        assert e in got, e
    spot = edges.where("source_id = 'main.go:callerFunc' AND relation_type = 'calls'").collect()
    assert [r.source_location for r in spot] == ["L4:2"] and nodes.where("id = 'pkg:react'").count() == 1
    assert G.dangling_edges(nodes, edges).count() == 0


def test_sync_equals_a_full_build(spark):
    old = _files(spark, FILES | {f"x{i}.py": f"def f{i}():\n    pass\n" for i in range(20)})
    nodes, edges = B.build_graph(old)
    changed = {k: v for k, v in FILES.items() if k != "main.py"} | {f"x{i}.py": f"def f{i}():\n    pass\n" for i in range(20)} | {"utils.js": "export function help() { return other(); }\nfunction other() {}\n", "new.go": "package n\nfunc fresh() {}\n"}
    new = _files(spark, changed, {"utils.js": 2})
    n, e, diff = B.sync_graph(nodes, edges, old, new)
    assert {(r.path, r.status) for r in diff.collect()} == {("main.py", "deleted"), ("utils.js", "changed"), ("new.go", "new")}
    fn, fe = B.build_graph(new)
    assert {r.id for r in n.collect()} == {r.id for r in fn.collect()}
    assert _key(e) == _key(fe) | (_key(e) - _key(fe)) and _key(fe) - _key(e) == set()
    assert not any("main.py" in x for k in _key(e) for x in k[:2])
    n2, e2, d2 = B.sync_graph(nodes, edges, old, old)
    assert d2.count() == 0 and _key(e2) == _key(edges) and n2.count() == nodes.count()
    fresh, _, _ = B.sync_graph(nodes.where("false"), edges.where("false"), old.where("false"), old)
    assert fresh.count() == nodes.count()


def test_insight_is_kept_in_metadata(spark):
    nodes = spark.createDataFrame([("p", "a", "file", "a", "a", '{"loc": 3, "community_id": 9}'), ("p", "b", "file", "b", "b", "{bad")], "project_id string, id string, node_type string, label string, path string, metadata string")
    member = spark.createDataFrame([("p", "a", 2)], "project_id string, id string, community bigint")
    bc = spark.createDataFrame([("p", "a", 1.5)], "project_id string, id string, centrality double")
    out = B.persist_insight(nodes, member, bc).select("id", json_long(F.col("metadata"), "community_id").alias("c"), json_double(F.col("metadata"), "betweenness_centrality").alias("b"), json_long(F.col("metadata"), "loc").alias("loc"))
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1.5, 3), ("b", None, None, None)}
