import json
import os
import time

import pytest
from pyspark.sql import functions as F

from knowloom.operators import specs
from knowloom.sinks import exports
from knowloom.sinks.store import Store, inside, orphan_files, write_files
from knowloom.sources import extract as E
from knowloom.sources import files as S
from knowloom.sources import memories as IN
from knowloom.streaming import jobs
from knowloom.tables import MEMORIES

DOC = """# Auth

## Purpose
Skipped MUST prose.

## ADDED Requirements

### Requirement: Login
Users MUST log in.
Second line.

#### Scenario: ok
- **GIVEN** a user
- WHEN: they enter
- THEN it works
- nonsense

#### Scenario: bad
- **THEN** refused

### Requirement:

## MODIFIED Requirements
### Requirement: Logout
Sessions end.

## REMOVED Requirements
### Requirement: Old

## RENAMED Requirements
- **FROM:** `A`
- **TO:** `B`
- FROM: C
- TO: D
"""


def test_delta_parsing_and_round_trip(spark):
    d = specs.parse_deltas(DOC)
    assert [(x["op"], x["requirement"], x["rename_to"]) for x in d] == [("ADDED", "Login", None), ("MODIFIED", "Logout", None), ("REMOVED", "Old", None), ("RENAMED", "A", "B"), ("RENAMED", "C", "D")]
    assert d[0]["body"] == "Users MUST log in.\nSecond line." and [len(s["steps"]) for s in d[0]["scenarios"]] == [3, 1]
    assert d[0]["scenarios"][0]["steps"][1] == {"keyword": "WHEN", "text": "they enter"}
    assert specs.parse_deltas(specs.render_deltas(d)) == d and specs.parse_deltas(None) == []
    rows = specs.delta_rows(spark.createDataFrame([("p", DOC), ("q", None)], "project_id string, content string")).collect()
    assert len(rows) == 5 and rows[0].scenarios[0].steps[0].text == "a user"


def test_merge_sequence(spark):
    cur = f"project_id string, capability_path string, requirement string, body string, scenarios array<{specs.SCENARIO}>"
    dl = f"project_id string, capability_path string, op string, requirement string, rename_to string, body string, scenarios array<{specs.SCENARIO}>, sort_order int"
    two = [{"name": "a", "steps": []}, {"name": "b", "steps": []}]
    step = lambda *rows: spark.createDataFrame([("p", "auth", *r) for r in rows], dl)
    state = spark.createDataFrame([], cur)
    for rows, want in [
        ([("ADDED", "Login", None, "MUST", two, 0), ("ADDED", "Logout", None, "x", [], 1)], {"Login": 2, "Logout": 0}),
        ([("MODIFIED", "Login", None, "MUST", two[:1], 0)], {"Login": 1, "Logout": 0}),
        ([("RENAMED", "Logout", "Sign Out", "", [], 0)], {"Login": 1, "Sign Out": 0}),
        ([("REMOVED", "Sign Out", None, "", [], 0)], {"Login": 1}),
    ]:
        d = step(*rows)
        if rows[0][0] == "MODIFIED":
            assert [r.issue for r in specs.validate_deltas(state, d).collect()] == ["drops scenario b"]
        state, problems = specs.merge_deltas(state, d)
        assert problems.count() == 0
        state = spark.createDataFrame(state.drop("rfc2119").collect(), cur)
        assert {r.requirement: len(r.scenarios) for r in state.collect()} == want
    _, problems = specs.merge_deltas(state, step(("RENAMED", "Nope", "X", "", [], 0), ("RENAMED", "Login", "Login", "", [], 1), ("ADDED", "Login", None, "", [], 2), ("ADDED", "", None, "", [], 3)))
    assert {(r.op, r.requirement, r.problem) for r in problems.collect()} == {("RENAMED", "Nope", "no such requirement"), ("RENAMED", "Login", "invalid rename"), ("ADDED", "Login", "exists already"), ("ADDED", "", "no name")}
    page = specs.capability_markdown(state).first()
    assert page.path == "specs/auth/spec.md" and "### Requirement: Login\nMUST\n\n#### Scenario: a" in page.content
    assert specs.capability_digest(state).first().requirements == "Login"


FILES = {
    "index.js": "import React from 'react';\nimport { x } from './utils';\n// NOTE: keep\nexport function start() { helper(1); }\n/* function hidden() {} */\nclass App {}\n",
    "main.py": "import os\nfrom .models import X\n\ndef go(a):\n    return helper(a)\n\nclass _K:\n    pass\n",
    "broken.py": "def ok(:\n  pass\nclass C\n",
    "main.go": 'package main\nimport (\n "fmt"\n x "net/http"\n)\nfunc (s *T) Run() { helper() }\nfunc main() {}\ntype T struct {}\n',
    "a.rs": "use std::io;\npub fn f() {}\nstruct S;\n",
    "schema.sql": "CREATE TABLE a (\n id INT PRIMARY KEY,\n b VARCHAR(3) NOT NULL DEFAULT 'x',\n CONSTRAINT c CHECK (id > 0)\n);\nCREATE TABLE b (a_id INT REFERENCES a(id));\nCREATE UNIQUE INDEX ia ON a (b);\nCREATE VIEW v AS SELECT 1;\nCREATE TYPE mood AS ENUM ('x', 'y');\n",
    "README.md": "# Title\n```mermaid\n# no\n```\n```py\nx\n```\n## Two\n[a](b.md) [[c|d]]\n",
    "p.html": "<a href='x.html'>x</a><img src=y.png><p id='k'>",
    "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}',
    "go.mod": "module m\ngo 1.2\nrequire (\n a/b v1\n)\nrequire c/d v2\n",
    "requirements.txt": "# c\nflask==1\n-r x\nnumpy>=2; python\n",
    "Cargo.toml": "[package]\nname = 'x'\n[dependencies]\nserde = '1'\n[dev]\ny = '2'\n",
    "Gemfile": "gem 'rails', '7'\n",
    "composer.json": "broken",
    "node_modules/skip.js": "x", "secret.pem": "x", "build/out.js": "x", "notes.bin": "x", "gen/a.py": "x = 1", "gen/keep.py": "y = 1",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    (root / ".gitignore").write_text("# c\ngen/*\n!gen/keep.py\n")
    return str(root)


def test_scan_and_graph(spark, tree):
    assert S.ensure_ignore_file(tree) and not S.ensure_ignore_file(tree)
    files = S.scan(spark, tree, "p").cache()
    names = {r.path for r in files.collect()}
    assert names == set(FILES) - {"node_modules/skip.js", "secret.pem", "build/out.js", "notes.bin", "gen/a.py"}
    found = E.extract(files)
    rows = [(r.path, r.kind, r.name, r.type, r.line) for r in found.collect()]
    for want in [
        ("index.js", "symbol", "start", "function", 4), ("index.js", "symbol", "App", "class", 6), ("index.js", "import", "react", None, 1), ("index.js", "import", "./utils", None, 2),
        ("index.js", "call", "helper", None, 4), ("index.js", "rationale", "NOTE: keep", None, 3), ("main.py", "symbol", "go", "function", 4), ("main.py", "import", ".models", None, 2), ("main.py", "call", "helper", None, 5),
        ("broken.py", "symbol", "ok", "function", 1), ("main.go", "symbol", "Run", "function", 6), ("main.go", "import", "net/http", None, 2), ("a.rs", "symbol", "f", "function", 2), ("a.rs", "import", "std::io", None, 1),
        ("schema.sql", "symbol", "a", "table", 1), ("schema.sql", "symbol", "ia", "index", 7), ("schema.sql", "symbol", "v", "view", 8), ("schema.sql", "symbol", "mood", "type", 9), ("schema.sql", "foreign_key", "b -> a", None, 6),
        ("README.md", "symbol", "Title", "section", 1), ("README.md", "symbol", "mermaid", "diagram", 2), ("README.md", "symbol", "py", "code_block", 5), ("README.md", "import", "b.md", None, 9), ("README.md", "import", "c", None, 9),
        ("p.html", "import", "x.html", None, 1), ("p.html", "import", "y.png", None, 1),
    ]:
        assert want in rows, want
    assert not any(r[2] in ("hidden", "no", "main") for r in rows)
    meta = {r.name: r.meta for r in found.where("type = 'table'").collect()}
    assert meta["a"] == "id INT notnull pk; b VARCHAR(3) notnull default=x"
    deps = {(r.source_id, r.target_id) for r in E.dependencies(files.where(F.col("path").isin(*S.MANIFESTS))).collect()}
    assert deps == {("package.json", "pkg:react"), ("package.json", "pkg:jest"), ("go.mod", "pkg:a/b"), ("go.mod", "pkg:c/d"), ("requirements.txt", "pkg:flask"), ("requirements.txt", "pkg:numpy"), ("Cargo.toml", "pkg:serde"), ("Gemfile", "pkg:rails")}
    nodes = S.file_nodes(files).unionByName(S.symbol_nodes(found))
    got = {r.id: r for r in nodes.collect()}
    assert json.loads(got["main.go"].metadata)["entry_point"] and got["README.md:Title"].node_type == "section" and got["index.js"].label == "index.js"


@pytest.mark.parametrize(
    "path, rules, want",
    [("a/b.log", ["*.log"], True), ("a/b.log", ["*.log", "!b.log"], False), ("x/a.txt", ["/a.txt"], False), ("a.txt", ["/a.txt"], True), ("d/e/f", ["d/"], True), ("d", ["d/"], False), ("a/x/y/b", ["a/**/b"], True), ("a/b", ["a/**/b"], True), ("q1.c", ["q?.c"], True), ("#x", ["#x"], False), ("!x", ["\\!x"], True)],
)
def test_ignore_rules(path, rules, want):
    assert S.is_ignored(path, rules) is want


def test_imports_refuse_and_report(spark, tmp_path):
    rows = [{"id": "a", "what": "w", "revision_count": 1, "normalized_hash": "h"}, {"id": "../x", "what": "w"}]
    (tmp_path / "all.json").write_text(json.dumps(rows))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps(rows[0] | {"what": "password=abcdefghijkl", "normalized_hash": "g"}))
    (tmp_path / "c" / "b.json").write_text("{broken")
    current = spark.createDataFrame([{**dict.fromkeys(MEMORIES.names), "id": "a", "project_id": "p", "what": "old", "revision_count": 1, "normalized_hash": "h"}], MEMORIES)
    good, broken = IN.read_chunks(spark, str(tmp_path / "c"))
    table, refused, diverging = IN.import_memories(current, good, "p")
    assert [r.what for r in table.collect()] == ["password=[REDACTED_SECRET]"] and [r.reason for r in diverging.collect()] == ["other content"] and broken.count() == 1
    _, refused, _ = IN.import_memories(current, IN.read_json(spark, str(tmp_path / "all.json")), "p")
    assert [r.id for r in refused.collect()] == ["../x"]
    assert IN.parse_change("# Change: T\n- **Status:** draft\n- **Where:** `a/b`\n## What\nx\ny\n## Tasks\n- [ ] z") == {"title": "T", "status": "draft", "where_path": "a/b", "what": "x\ny", "tasks": "- [ ] z"}
    s = IN.Settings.layered(IN.parse_flat_yaml("conflict_threshold: 0.6 # c\ngraph_boost: false\nodd: x"), {"default_review_limit": "7", "max_field_chars": "bad"})
    assert (s.conflict_threshold, s.graph_boost, s.default_review_limit, s.max_field_chars, s.extra) == (0.6, False, 7, 1000, {"odd": "x"})


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(a=spark.range(3), b=spark.range(1))
    with pytest.raises(Exception):
        store.commit(a=spark.range(9), b=spark.range(2).select(F.expr("raise_error('no')").alias("id")))
    assert store.read("a").count() == 3
    store.commit(a=spark.range(5))
    assert store.read("a").count() == 5 and store.read("b").count() == 1 and len(store.vacuum()) >= 2
    with pytest.raises(ValueError):
        inside(str(tmp_path), "../x")


def test_store_appends_and_merges_parts(spark, tmp_path, monkeypatch):
    from knowloom.sinks import store as St

    monkeypatch.setattr(St, "MOST_PARTS", 3)
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    store.commit(t=rows(("a", 1), ("b", 1)), o=rows(("x", 1)))
    store.append("t", rows(("a", 2), ("c", 2)), ["k"])
    store.append("t", rows(("c", None)), ["k"])
    seen = lambda: sorted(map(tuple, store.read("t").collect()))
    assert seen() == [("a", 2), ("b", 1), ("c", None)] and len(store.versions()["t@parts"]["paths"]) == 2 and store.vacuum() == []
    store.append("t", rows(("b", 3)), ["k"])
    assert seen() == [("a", 2), ("b", 3), ("c", None)] and "t@parts" not in store.versions() and len(store.vacuum()) == 4
    store.append("t", rows(("b", 4)), ["k"])
    store.commit(t=rows(("z", 0)))
    assert seen() == [("z", 0)] and store.read("o").count() == 1


def test_files_and_exports(spark, tmp_path):
    rows = [{**dict.fromkeys(MEMORIES.names), "id": i, "project_id": "p", "what": "w|x", "where_path": "a.go:3", "category": "qa"} for i in "ab"]
    m = spark.createDataFrame(rows, MEMORIES)
    root = str(tmp_path / "chunks")
    write_files(exports.memory_json(m), root)
    assert orphan_files(root, exports.memory_json(m.where("id = 'a'"))) == ["b.json"] and sorted(os.listdir(root)) == ["a.json"]
    assert exports.export_json(m, str(tmp_path / "m.json")) == 2 and json.loads((tmp_path / "m.json").read_text())[0]["what"] == "w|x"
    assert "File: [[../files/a.go]]" in exports.memory_notes(m).first().content
    n = spark.createDataFrame([("p", "a", "file", "A<b>", "a", None), ("p", "b", "file", "B", "b", None)], "project_id string, id string, node_type string, label string, path string, metadata string")
    e = spark.createDataFrame([("x", "p", "a", "b", "calls", "EXTRACTED", None)], "id string, project_id string, source_id string, target_id string, relation_type string, confidence string, source_location string")
    member = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "project_id string, id string, community bigint")
    bc = member.select("project_id", "id", F.lit(1.0).alias("centrality"))
    pages = {r.path: r.content for r in exports.wiki_pages(n, e, member, bc).collect()}
    assert set(pages) == {"index.md", "community-001.md", "community-002.md"} and "A&lt;b&gt;" in pages["index.md"] and "## Leads to" in pages["community-001.md"]
    assert exports.html_view(n, e, member, str(tmp_path / "g.html")) == 2 and "<canvas" in (tmp_path / "g.html").read_text()
    assert {r.line for r in exports.cypher(n, e).where("kind = 1").collect()} == {'MATCH (a {id: "a"}), (b {id: "b"}) MERGE (a)-[:CALLS]->(b);'}
    assert exports.graph_json(n, e).count() == 3


def _chunk(folder, i, minutes, **kw):
    row = {"id": i, "project_id": "p", "category": "qa", "what": "same", "created_at": time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime(1_700_000_000 + minutes * 60))} | kw
    (folder / f"{i}.json").write_text(json.dumps(row))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i, t in [("a", 0), ("b", 10), ("c", 60 * 23), ("d", 60 * 25)]:
        _chunk(src, i, t)
    _chunk(src, "o", 5, what="other")

    def run(df, mode="append"):
        q = df.writeStream.format("memory").queryName(f"q{time.time_ns()}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(q.name).collect()

    stream = lambda: jobs.chunk_stream(spark, str(src))
    assert {r.id for r in run(jobs.first_saves(stream()))} >= {"o"} and len(run(jobs.first_saves(stream()))) in (2, 3)
    got = {r.id: r.repeats for r in run(jobs.counted_saves(stream()), "update")}
    assert got == {"a": 2, "d": 0, "o": 0}
    store = Store(spark, str(tmp_path / "store"))
    q = jobs.upsert_memories(stream(), store, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    _chunk(src, "a", 0, what="newer")
    os.utime(src / "a.json", (time.time() + 5, time.time() + 5))
    assert store.read("memories").count() == 5
    _chunk(src, "z", 0)
    jobs.upsert_memories(stream(), store, str(tmp_path / "ckpt")).awaitTermination(120)
    assert store.read("memories").count() == 6


def test_upsert_keeps_the_newest_version_within_a_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    at = lambda hour: f"2024-01-01T{hour:02}:00:00.000Z"
    versions = [("u", 1, 0), ("u", 5, 1), ("v", 5, 1), ("v", 1, 0), ("w", None, 2), ("w", None, 1)]
    for n, (i, seen, revision) in enumerate(versions):
        row = {"id": i, "project_id": "p", "what": f"{i}{seen}{revision}", "created_at": at(0), "last_seen_at": seen and at(seen), "revision_count": revision}
        (src / f"{n}.json").write_text(json.dumps(row))
        os.utime(src / f"{n}.json", (1_700_000_000 + n,) * 2)
    store = Store(spark, str(tmp_path / "store"))
    jobs.upsert_memories(jobs.chunk_stream(spark, str(src)), store, str(tmp_path / "ckpt")).awaitTermination(120)
    assert {r.id: r.what for r in store.read("memories").collect()} == {"u": "u51", "v": "v51", "w": "wNone2"}


def test_scheduled_scans(spark, tmp_path):
    import datetime as dt

    from knowloom.tables import MEMORY_RELATIONS, PROJECTS

    store = Store(spark, str(tmp_path / "s"))
    t = dt.datetime(2024, 1, 1)
    rows = [{**dict.fromkeys(MEMORIES.names), "id": i, "project_id": "p", "what": w, "topic_key": "k", "created_at": t} for i, w in [("a", "tune ledger cache"), ("b", "tune ledger cache now")]]
    store.commit(memories=spark.createDataFrame(rows, MEMORIES), projects=spark.createDataFrame([("p",) + (None,) * 5], PROJECTS), memory_relations=spark.createDataFrame([], MEMORY_RELATIONS))
    assert jobs.scan_conflicts(store, t, apply=False).count() == 1 and store.read("memory_relations").count() == 0
    jobs.scan_conflicts(store, t)
    assert store.read("memory_relations").count() == 1 and jobs.scan_conflicts(store, t).count() == 0
    assert jobs.compact_store(store, t) == 1 and jobs.compact_store(store, t, t) == 0


def test_applied_scan_links_every_member_in_linear_rows(spark, tmp_path):
    import datetime as dt
    from itertools import combinations

    from knowloom.tables import MEMORY_RELATIONS, PROJECTS

    store = Store(spark, str(tmp_path / "s"))
    old, mark, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    titles = {"a": "tune ledger cache", "b": "ledger cache tune", "c": "tune ledger cache now", "d": "tune ledger cache now", "d2": "now tune ledger cache", "e": "rename exporter fields"}
    memory = lambda i, w, t: {**dict.fromkeys(MEMORIES.names), "id": i, "project_id": "p", "what": w, "created_at": t}
    linked = {**dict.fromkeys(MEMORY_RELATIONS.names), "id": "r", "project_id": "p", "source_id": "d", "target_id": "c", "relation_type": "conflicts_with", "status": "judged"}
    store.commit(memories=spark.createDataFrame([memory(i, w, old) for i, w in titles.items()], MEMORIES), projects=spark.createDataFrame([("p",) + (None,) * 5], PROJECTS), memory_relations=spark.createDataFrame([linked], MEMORY_RELATIONS))
    links = lambda: sorted(tuple(sorted((r.source_id, r.target_id))) for r in store.read("memory_relations").collect())

    def similar():
        """Pairs that the relations and the classes stand for."""
        cls = {r.id: r.class_id for r in store.read("conflict_classes").collect()}
        between = {tuple(sorted((cls[x], cls[y]))) for x, y in links()}
        return {(x, y) for x, y in combinations(sorted(cls), 2) if tuple(sorted((cls[x], cls[y]))) in between}

    jobs.scan_conflicts(store, mark)
    assert links() == [("a", "b"), ("a", "c"), ("c", "d"), ("c", "d2")] and similar() == set(combinations(["a", "b", "c", "d", "d2"], 2))
    assert {(r.source_id, r.target_id): r.score for r in store.read("memory_relations").where("status = 'pending'").collect()} == {("a", "b"): 1.0, ("a", "c"): 0.75, ("c", "d2"): 1.0}
    store.commit(memories=store.read("memories").unionByName(spark.createDataFrame([memory("z", "now tune ledger cache", now)], MEMORIES)))
    jobs.scan_conflicts(store, now)
    assert links() == [("a", "b"), ("a", "c"), ("c", "d"), ("c", "d2"), ("c", "z")] and similar() == set(combinations(["a", "b", "c", "d", "d2", "z"], 2))
    jobs.scan_conflicts(store, now)
    assert len(links()) == 5
