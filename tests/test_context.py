import datetime as dt

from knowloom.operators import code as C
from knowloom.operators import context as X
from knowloom.operators import specs
from knowloom.runtime import FrameCache, clean, cut
from knowloom.sources.memories import parse_change
from knowloom.tables import CHANGES, MEMORIES, conform, schema_report

NODES = "project_id string, id string, node_type string, label string, path string, metadata string"
EDGES = "id string, project_id string, source_id string, target_id string, relation_type string, confidence string, source_location string"
T = dt.datetime(2024, 3, 4)


def _nodes(spark):
    meta = {"pkg/a.go": '{"community_id": 3}', "lib/far.go": '{"community_id": 3}'}
    return spark.createDataFrame([("p", i, "file", i.split("/")[-1], i, meta.get(i)) for i in ("pkg/a.go", "pkg/b.go", "lib/far.go", "x.go")] + [("p", "spec:auth", "spec", "auth", "auth", None)], NODES)


def _edges(spark):
    rows = [("pkg/b.go", "pkg/a.go", "calls"), ("pkg/a.go", "lib/far.go", "imports"), ("pkg/a.go", "spec:auth", "implements")]
    return spark.createDataFrame([(f"{a}-{b}", "p", a, b, r, "EXTRACTED", None) for a, b, r in rows], EDGES)


def _memories(spark):
    rows = [("m1", "pkg/a.go:12"), ("m2", "lib/far.go"), ("m3", "other.go")]
    return spark.createDataFrame([{**dict.fromkeys(MEMORIES.names), "id": i, "project_id": "p", "what": i, "where_path": w, "created_at": T} for i, w in rows], MEMORIES)


def test_boost_by_community_and_folder(spark):
    got = {r.id: r.boosted for r in X.graph_boosted(_memories(spark), _nodes(spark), "pkg/a.go").collect()}
    assert got == {"m1": False, "m2": True}
    at = spark.createDataFrame([("p", "pkg/b.go")], "project_id string, id string")
    assert {r.path for r in X.community_paths(_nodes(spark), at).collect()} == {"pkg/a.go", "pkg/b.go"}


def test_context_pack(spark):
    ch = conform(spark.createDataFrame([("c", "p", "s", "draft", "T", "pkg/a.go", "- [x] a", T)], "id string, project_id string, slug string, status string, title string, where_path string, tasks string, created_at timestamp"), CHANGES)
    caps = spark.createDataFrame([("p", "auth", "Login"), ("p", "auth", "Logout")], "project_id string, capability_path string, requirement string")
    rows = X.context_pack(_nodes(spark), _edges(spark), _memories(spark), "pkg/a.go", changes=ch, capabilities=caps).collect()
    got = {(r.section, r.id, r.detail) for r in rows}
    assert got >= {("node", "pkg/a.go", "intermediate LOW 1 2"), ("memory", "m1", "m1"), ("dependent", "pkg/b.go", "calls"), ("dependency", "lib/far.go", "imports"), ("blast", "pkg/b.go", "1 calls"), ("change", "c", "draft T 1/1 (100%)"), ("capability", "auth", "2: Login · Logout")}


def test_snippets(spark):
    files = spark.createDataFrame([("p", "a.go", "\n".join(f"l{i}" for i in range(1, 81)))], "project_id string, path string, content string")
    nodes = spark.createDataFrame([("p", "a.go:f", "function", "f", "a.go", '{"line": 3}'), ("p", "a.go:g", "function", "g", "a.go", '{"line": 79}'), ("p", "a.go:h", "function", "h", "a.go", '{"line": 99}')], NODES)
    got = {r.id: r.text for r in C.snippet(files, nodes).collect()}
    assert got["a.go:g"] == "l79\nl80" and got["a.go:f"].startswith("l3\n") and got["a.go:f"].endswith("l62\n... [truncated, 18 more lines]") and "a.go:h" not in got


def test_change_documents_round_trip(spark):
    row = {**dict.fromkeys(CHANGES.names), "id": "1", "project_id": "p", "slug": "s", "status": "draft", "title": "T", "what": "x\ny", "where_path": "a/b", "tasks": "- [ ] z", "created_at": T}
    df = spark.createDataFrame([row, row | {"id": "2", "slug": "old", "status": "archived", "archived_at": T}], CHANGES)
    pages = {r.path: r.content for r in specs.change_markdown(df).collect()}
    assert set(pages) == {"changes/s.md", "changes/archive/2024-03-04-old.md"}
    assert parse_change(pages["changes/s.md"]) == {"title": "T", "status": "draft", "slug": "s", "where_path": "a/b", "what": "x\ny", "tasks": "- [ ] z"}
    deltas = spark.createDataFrame([("p", "1", "## REMOVED Requirements\n\n### Requirement: R")], "project_id string, change_id string, content string")
    text = {r.path: r.content for r in specs.change_markdown(df, deltas).collect()}["changes/s.md"]
    assert [d["requirement"] for d in specs.parse_deltas(text)] == ["R"]


def test_schemas_caches_and_cleaning(spark):
    old = spark.createDataFrame([("a", "7", "x")], "id string, revision_count string, gone string")
    new = conform(old, MEMORIES)
    assert new.schema == MEMORIES or [f.dataType for f in new.schema] == [f.dataType for f in MEMORIES]
    assert new.first().revision_count == 7
    report = schema_report({"memories": old})
    assert ("memories", "revision_count", "is string") in report and ("projects", "", "missing table") in report and ("memories", "what", "missing column") in report
    cache, made = FrameCache(2), []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert cache.get("a", 1, lambda: make(3)).count() == 3 and cache.get("a", 1, lambda: make(4)).count() == 3 and cache.get("a", 2, lambda: make(5)).count() == 5
    cache.get("b", 1, lambda: make(1))
    cache.get("c", 1, lambda: make(1))
    assert made == [3, 5, 1, 1] and len(cache._held) == 2
    cut(spark.range(1))
    clean(spark)
    assert cut(spark.range(2)).count() == 2


def test_links_from_memories_and_capabilities_to_code(spark):
    from knowloom.operators.memory import code_links, stale_bindings

    assert {(r.memory_id, r.node_id) for r in code_links(_memories(spark), _nodes(spark)).collect()} == {("m1", "pkg/a.go"), ("m2", "lib/far.go")}
    files = _nodes(spark).select("project_id", "path")
    assert {r.id for r in stale_bindings(_memories(spark), files).collect()} == {"m1", "m3"}  # a line mark is no file name
    ch = spark.createDataFrame([("p", "c1", "auth", "./pkg/a.go:3"), ("p", "c2", "auth", "pkg/a.go"), ("p", "c3", "", "x.go"), ("p", "c4", "other", "x.go")], "project_id string, id string, capability_path string, where_path string")
    req = spark.createDataFrame([("p", "c1"), ("p", "c2"), ("p", "c3")], "project_id string, change_id string")
    got = {(r.source_id, r.target_id, r.relation_type) for r in specs.capability_edges(ch, req, _nodes(spark)).collect()}
    assert got == {("pkg/a.go", "spec:auth", "implements")}


CURRENT = [("p", "auth", "Login", "Users MUST log in."), ("p", "auth", "Logout", "Sessions SHALL end."), ("p", "auth", "Idle", "It MAY wait."), ("q", "auth", "Login", "Old text.")]
DELTAS = [
    ("p", "auth", "RENAMED", "Logout", "Sign Out", "", 0), ("p", "auth", "RENAMED", "Nope", "Other", "", 1), ("p", "auth", "ADDED", "Reset", None, "It SHOULD NOT leak token: abcdefghijklmnop", 2),
    ("p", "auth", "ADDED", "Login", None, "dup", 3), ("p", "auth", "MODIFIED", "Sign Out", None, "Sessions MUST end.", 4), ("q", "auth", "MODIFIED", "New", None, "plain", 5), ("p", "auth", "REMOVED", "Idle", None, "", 6), ("p", "auth", "REMOVED", "Gone", None, "", 7),
]


def test_merge_of_fixed_deltas(spark):
    current = spark.createDataFrame([(*r, None) for r in CURRENT], f"project_id string, capability_path string, requirement string, body string, scenarios array<{specs.SCENARIO}>")
    deltas = spark.createDataFrame([(*r, None) for r in DELTAS], f"project_id string, capability_path string, op string, requirement string, rename_to string, body string, sort_order int, scenarios array<{specs.SCENARIO}>")
    state, _ = specs.merge_deltas(current, deltas)
    assert {(r.project_id, r.requirement, r.body) for r in state.collect()} == {
        ("p", "Login", "Users MUST log in."), ("p", "Sign Out", "Sessions MUST end."), ("p", "Reset", "It SHOULD NOT leak token: [REDACTED_SECRET]"), ("q", "Login", "Old text."), ("q", "New", "plain"),
    }


def test_merge_query_runs_over_all_memories_with_a_change(spark, tmp_path):
    from knowloom.plans.code import merged

    said = [  # change, topic, what, why, deleted
        ("c1", "auth", "Login", "Users MUST log in.", False), ("c1", "auth", "Logout", "Sessions SHALL end.", False), ("c1", "auth", "Idle", "It MAY wait.", False), ("c2", "auth", " Sign Out ", "Sessions SHALL end.", False),
        ("c2", "auth", "Reset", "It MUST expire.", False), ("c3", "auth", "Login", "Users SHOULD log in.", False), ("c3", "auth", "Sign Out", "Sessions MUST end.", False), ("c3", "auth", "Idle", "x", True),
        ("c2", None, "Other", None, False), ("", "auth", "No change", "x", False), (None, "auth", "None", "x", False),
    ]
    rows = [{**dict.fromkeys(MEMORIES.names), "id": f"m{i:02}", "project_id": "p", "change_id": c, "topic_key": t, "what": w, "why": y, "created_at": T + dt.timedelta(hours=i), "deleted_at": T if gone else None} for i, (c, t, w, y, gone) in enumerate(said)]
    spark.createDataFrame(rows, MEMORIES).write.parquet(str(tmp_path / "memories.parquet"))
    got = sorted((r.capability_path, r.requirement, r.body, r.words) for r in merged(spark, str(tmp_path)).collect())
    assert got == [("auth", "Login", "Users SHOULD log in.", "SHOULD"), ("auth", "Reset", "It MUST expire.", "MUST"), ("auth", "Sign Out", "Sessions MUST end.", "MUST"), ("general", "Other", "", "")]
