"""Saves applied to the table, sessions, prompts, changes, commits and links."""

import datetime as dt

from pyspark.sql import functions as F

from knowloom.operators import agent, changes, lifecycle, links, sessions, specs
from knowloom.sinks.store import Store
from knowloom.tables import CHANGES, GRAPH_EDGES, GRAPH_NODES, MEMORIES, MEMORY_RELATIONS, PROJECTS, SESSIONS, USER_PROMPTS

NOW = dt.datetime(2024, 6, 1, 12)


def _frame(spark, schema, *rows):
    return spark.createDataFrame([{**dict.fromkeys(schema.names), "project_id": "p", **r} if "project_id" in schema.names else {**dict.fromkeys(schema.names), **r} for r in rows], schema)


def _mem(spark, *rows):
    return _frame(spark, MEMORIES, *[{"category": "journal", "created_at": NOW - dt.timedelta(hours=2)} | r for r in rows])


def test_save_revises_counts_and_inserts(spark):
    current = _mem(spark, {"id": "t1", "what": "old", "topic_key": "k", "revision_count": 3, "duplicate_count": 2, "pinned": True}, {"id": "r1", "what": "same", "duplicate_count": 1, "revision_count": 1},
                   {"id": "far", "what": "long ago", "created_at": NOW - dt.timedelta(days=2)}, {"id": "gone", "what": "deleted", "topic_key": "g", "deleted_at": NOW})
    new = _mem(spark, *[{"id": i, "what": w, "topic_key": k, "created_at": NOW + dt.timedelta(minutes=n)} for n, (i, w, k) in enumerate([
        ("a", "one", "k"), ("b", "two password=abcdefghijkl", "k"), ("c", "same", None), ("d", "same", ""), ("e", "fresh", None), ("f", "fresh", None), ("g1", "long ago", None), ("h", "new topic", "n"), ("i", "newer", "n"), ("j", "revived", "g")])])
    table, actions = lifecycle.save(new, current, NOW)
    rows = {r.id: r for r in table.collect()}
    assert {r.id: (r.action, r.target_id) for r in actions.collect()} == {"a": ("upsert", "t1"), "b": ("upsert", "t1"), "c": ("bump", "r1"), "d": ("bump", "r1"), "e": ("insert", "e"), "f": ("bump", "e"), "g1": ("insert", "g1"), "h": ("insert", "h"), "i": ("upsert", "h"), "j": ("insert", "j")}
    assert set(rows) == {"t1", "r1", "far", "gone", "e", "g1", "h", "j"}
    assert (rows["t1"].what, rows["t1"].revision_count, rows["t1"].duplicate_count, rows["t1"].pinned) == ("two password=[REDACTED_SECRET]", 5, 2, True) and rows["t1"].created_at == NOW - dt.timedelta(hours=2)
    assert (rows["r1"].duplicate_count, rows["r1"].last_seen_at) == (3, NOW) and rows["e"].duplicate_count == 1
    assert (rows["h"].what, rows["h"].revision_count) == ("newer", 2) and rows["gone"].deleted_at is not None
    again, acts = lifecycle.save(new.where("false"), current, NOW)
    assert again.count() == 4 and acts.count() == 0


def test_upsert_is_the_same_in_any_order(spark):
    rows = [{"id": "u", "what": str(k), "revision_count": k, "last_seen_at": NOW} for k in (1, 3, 2)] + [{"id": "v", "what": "x"}, {"id": "v", "what": "y"}]
    for order in (rows, rows[::-1]):
        got = {r.id: r.what for r in lifecycle.upsert(_mem(spark, {"id": "u", "what": "old", "revision_count": 9, "last_seen_at": NOW}), _mem(spark, *order), ["id"]).collect()}
        assert got == {"u": "3", "v": "y"}


def test_sessions_begin_end_and_go(spark):
    have = _frame(spark, SESSIONS, {"id": "old", "status": "Active "}, {"id": "done", "status": "completed", "summary": "s"}, {"id": "used", "status": "active"})
    begun = sessions.start_sessions(have, spark.createDataFrame([("p", "goal", "dir", "new"), ("p", "g", "d", "old")], "project_id string, goal string, directory string, id string"), NOW)
    assert {r.id: r.status for r in begun.collect()} == {"old": "Active ", "done": "completed", "used": "active", "new": "active"}
    assert len(sessions.start_sessions(have, spark.createDataFrame([("p", "g", "d")], "project_id string, goal string, directory string"), NOW).where("started_at IS NOT NULL").first().id) == 16
    ends = spark.createDataFrame([("p", "old", "token: abcdefghijklmnop"), ("p", "done", "x"), ("p", "none", "x")], "project_id string, id string, summary string")
    ended = {r.id: r for r in sessions.end_sessions(begun, ends, NOW).collect()}
    assert ended["old"].status == "completed" and ended["old"].ended_at == NOW and "abcdefghijklmnop" not in ended["old"].summary and ended["done"].summary == "s" and ended["new"].status == "active"
    told = sessions.summarise_sessions(begun, spark.createDataFrame([("p", "new", "G", "D", "A", None, "F")], "project_id string, id string, goal string, discoveries string, accomplished string, next_steps string, files string"))
    assert told.where("id = 'new'").first().summary == "Goal: G\nDiscoveries: D\nAccomplished: A\nNext Steps: \nFiles: F"
    kept, refused = sessions.delete_sessions(begun, _mem(spark, {"id": "m", "session_id": "used"}), begun.where("id IN ('used', 'old')"))
    assert {r.id for r in kept.collect()} == {"done", "used", "new"} and [r.id for r in refused.collect()] == ["used"]


def test_prompts_and_passive_notes(spark):
    have = _frame(spark, USER_PROMPTS, {"id": "q", "content": "x"})
    got = sessions.capture_prompts(have, spark.createDataFrame([("p", "s", "  ask password=abcdefghijkl ", "n"), ("p", None, " \n", "blank"), ("p", None, None, "null")], "project_id string, session_id string, content string, id string"), NOW)
    assert {r.id: r.content for r in got.collect()} == {"q": "x", "n": "ask password=[REDACTED_SECRET]"}
    table, actions = sessions.capture_passive(_mem(spark), spark.createDataFrame([("p", "saw it", "why", "s1", "a"), ("p", "saw it", "why", "s2", "b")], "project_id string, what string, why string, session_id string, id string"), NOW)
    row = table.first()
    assert (row.id, row.category, row.learned, row.duplicate_count) == ("a", "journal", "saw it", 1) and {r.action for r in actions.collect()} == {"insert", "bump"}


def test_changes_are_made_edited_and_found(spark):
    none = _frame(spark, CHANGES)
    made, refused = changes.create_changes(none, _frame(spark, CHANGES, {"slug": "add-login", "title": "Add"}, {"slug": "add-login", "title": "Add twice"}, {"slug": "../x", "title": "t"}, {"slug": " ", "title": "t"}, {"slug": "b", "title": None}, {"slug": "a/b", "title": "t", "project_id": None}), NOW)
    assert [(r.slug, r.status, r.capability_path, len(r.id)) for r in made.collect()] == [("add-login", "draft", "add-login", 16)]
    assert sorted(r.problem for r in refused.collect()) == ["no project", "no slug", "no title", "slug is taken", "unsafe slug"]
    i = made.first().id
    edited = changes.update_changes(made, spark.createDataFrame([("p", i, "New", None)], "project_id string, id string, title string, what string"), NOW)
    target = lambda cap: changes.set_capability(edited, spark.createDataFrame([("p", i, cap)], "project_id string, id string, capability_path string"), NOW).first()
    assert edited.first().title == "New" and target("auth").capability_path == "auth" and target(" ").capability_path == "add-login"
    found = changes.find_changes(edited, spark.createDataFrame([("p", i), ("p", "add-login"), ("p", "zz")], "project_id string, name string"))
    assert {r.name for r in found.collect()} == {i, "add-login"} and changes.by_status(edited, "draft").count() == 1 and changes.by_status(edited, "applied").count() == 0
    linked = changes.link_memories(_mem(spark, {"id": "m", "change_id": "x"}, {"id": "d", "deleted_at": NOW}), spark.createDataFrame([("p", "m", ""), ("p", "d", "c")], "project_id string, memory_id string, change_id string"))
    assert {r.id: r.change_id for r in linked.collect()} == {"m": None, "d": None}


DELTAS = f"project_id string, change_id string, {specs.DELTA}"
CAPS = f"project_id string, capability_path string, requirement string, body string, scenarios array<{specs.SCENARIO}>"


def test_commit_has_all_four_effects_or_none(spark, tmp_path):
    ch = _frame(spark, CHANGES, *[{"id": i, "slug": i, "status": "validated", "capability_path": cap} for i, cap in (("good", "auth"), ("bad", "auth"))])
    d = spark.createDataFrame([("p", "good", "ADDED", "Login", None, "MUST", None, 0), ("p", "bad", "RENAMED", "None", "X", "", None, 0)], DELTAS)
    d = changes.replace_deltas(d, spark.createDataFrame([("p", "good", "ADDED", "Sign in", None, "MUST", None, 0)], DELTAS))
    assert {r.requirement for r in changes.deltas_of(d, ch).collect()} == {"Sign in", "None"}
    decisions = _mem(spark, *[{"id": f"m-{i}", "category": "decision", "what": i, "topic_key": f"decision/{i}", "change_id": i} for i in ("good", "bad", "unknown")])
    tables = {"memories": _mem(spark), "changes": ch, "deltas": d, "capabilities": spark.createDataFrame([], CAPS)}
    new, problems = changes.commit_changes(tables, decisions, NOW)
    assert {(r.change_id, r.problem) for r in problems.collect()} == {("bad", "no such requirement"), ("unknown", "no such change")}
    store = Store(spark, str(tmp_path / "s"))
    store.commit(**new)
    assert [(r.id, r.change_id) for r in store.read("memories").collect()] == [("m-good", "good")]
    assert {r.id: r.status for r in store.read("changes").collect()} == {"good": "applied", "bad": "validated"} and [r.requirement for r in store.read("capabilities").collect()] == ["Sign in"]


def test_links_survive_a_rebuild(spark):
    n = _frame(spark, GRAPH_NODES, {"id": "pkg/a.go", "node_type": "file", "label": "a", "path": "pkg/a.go"}, {"id": "pkg/a.go:F", "node_type": "function", "label": "F", "path": "pkg/a.go"})
    e = _frame(spark, GRAPH_EDGES, {"id": "x", "source_id": "pkg/a.go", "target_id": "pkg/a.go:F", "relation_type": "contains"}, {"id": "stale", "source_id": "gone", "target_id": "pkg/a.go", "relation_type": "rationale_for"})
    m = _mem(spark, {"id": "m", "what": "why so", "where_path": "./pkg/a.go:3", "change_id": "c"}, {"id": "o", "where_path": "elsewhere"}, {"id": "d", "where_path": "pkg/a.go", "deleted_at": NOW})
    ch = _frame(spark, CHANGES, {"id": "c", "slug": "c", "capability_path": "auth", "where_path": "pkg/a.go"})
    nodes, edges = links.relinked(n, e, m, ch)
    assert {r.id: r.node_type for r in nodes.collect()} == {"pkg/a.go": "file", "pkg/a.go:F": "function", "m": "document", "spec:auth": "spec"}
    assert {(r.source_id, r.target_id, r.relation_type) for r in edges.collect()} == {("pkg/a.go", "pkg/a.go:F", "contains"), ("m", "pkg/a.go", "rationale_for"), ("pkg/a.go", "spec:auth", "implements"), ("m", "spec:auth", "implements")}
    twice = links.relinked(nodes, edges, m, ch)
    assert twice[0].count() == 4 and twice[1].count() == 4


def test_projects_register_once(spark):
    have = _frame(spark, PROJECTS, {"id": "x", "path": "/x"})
    paths = spark.createDataFrame([("/home/me/app/",), ("/home/me/app",), (" ",)], "path string")
    got = lifecycle.register(have, paths, NOW)
    assert {(r.name, r.path) for r in got.where("id <> 'x'").collect()} == {("app", "/home/me/app")} and lifecycle.register(got, paths, NOW).count() == 2


def test_agents_apply_and_confirm(spark):
    rel = _frame(spark, MEMORY_RELATIONS, *[{"id": i, "source_id": a, "target_id": b, "relation_type": "conflicts_with", "status": s} for i, a, b, s in (("1", "a", "b", "pending"), ("2", "c", "d", "pending"), ("3", "e", "f", "pending"), ("4", "a", "b", "judged"))])
    judged = spark.createDataFrame([("p", "b", "a", "supersedes", "r"), ("p", "c", "d", "not_conflict", ""), ("p", "e", "f", None, None)], "project_id string, a string, b string, verdict string, reason string")
    got = {(r.source_id, r.target_id, r.relation_type, r.status) for r in agent.applied_verdicts(rel, judged, NOW).collect()}
    assert got == {("b", "a", "supersedes", "judged"), ("c", "d", "conflicts_with", "ignored"), ("e", "f", "conflicts_with", "pending"), ("a", "b", "conflicts_with", "judged")}
    issues = spark.createDataFrame([("p", "m1", "w1", True, "WARN", "WARN"), ("p", "m2", "w2", False, "WARN", "WARN"), ("q", "m3", "w3", True, "BLOCK", "BLOCK")], "project_id string, memory_id string, what string, pinned boolean, severity string, verdict string")
    answer = lambda prompt: '[{"id": "m1", "violates": true}, {"id": "m2", "violates": true}]'
    assert {(r.memory_id, r.severity, r.verdict) for r in agent.confirm_issues(issues, answer, "x").collect()} == {("m1", "BLOCK", "BLOCK"), ("m2", "WARN", "BLOCK"), ("m3", "BLOCK", "BLOCK")}
    assert {r.severity for r in agent.confirm_issues(issues, lambda _: 1 / 0, "x").where("project_id = 'p'").collect()} == {"WARN"} and agent.confirm_issues(issues, None, "x") is issues
    b = spark.createDataFrame([("p", "qa", 1, "a", "x"), ("p", "qa", 2, "b", "y")], "project_id string, section string, rank int, id string, what string")
    order = lambda ask: [r.id for r in agent.selected(b, "goal", ask).orderBy("rank").collect()]
    assert order(lambda _: '["b"]') == ["b", "a"] and order(lambda _: "none") == ["a", "b"] and order(None) == ["a", "b"]


def test_vault_mirrors_and_synced_folders(spark, tmp_path):
    import json

    from knowloom.sinks import exports
    from knowloom.sinks.store import write_mirrors
    from knowloom.sources import files as S
    from knowloom.sources.memories import read_synced
    from knowloom.tables import key_report, rebuilt

    n = _frame(spark, GRAPH_NODES, {"id": "a/b", "node_type": "file", "label": "b", "path": "a/b"}, {"id": "c", "node_type": "file", "label": "c", "path": "c"})
    e = _frame(spark, GRAPH_EDGES, {"id": "x", "source_id": "a/b", "target_id": "c", "relation_type": "calls"})
    pages = {r.path: r.content for r in exports.simple_vault(_mem(spark, {"id": "m", "what": "w"}), n, e).collect()}
    assert set(pages) == {"nodes/a_b.md", "nodes/c.md", "memories/m.md"} and pages["nodes/a_b.md"].endswith("## Relations\n\n- calls [[c]]\n") and "Relations" not in pages["nodes/c.md"]
    root = str(tmp_path / "specs")
    page = lambda *slugs: specs.change_markdown(_frame(spark, CHANGES, *[{"id": s, "slug": s, "status": "draft", "title": s} for s in slugs]))
    assert S.mirror_slugs(spark, root).count() == 0
    assert write_mirrors(page("two", "one"), root) == [] and [r.slug for r in S.mirror_slugs(spark, root).collect()] == ["one", "two"]
    assert write_mirrors(page("one"), root) == ["changes/two.md"] and [r.slug for r in S.mirror_slugs(spark, root).collect()] == ["one"]
    good, broken = read_synced(spark, str(tmp_path / "none"))
    assert good.count() == broken.count() == 0
    (tmp_path / "sync").mkdir()
    (tmp_path / "sync" / "memories.json").write_text(json.dumps([{"id": "a", "what": "w"}, {"id": "b", "revision_count": "no number"}]))
    good, broken = read_synced(spark, str(tmp_path / "sync"))
    assert [r.id for r in good.cache().collect()] == ["a"]
    (tmp_path / "sync" / "chunks").mkdir()
    (tmp_path / "sync" / "chunks" / "z.json").write_text(json.dumps({"id": "z"}))
    assert [r.id for r in read_synced(spark, str(tmp_path / "sync"))[0].collect()] == ["z"]
    assert exports.writes_whole(0, None) and exports.writes_whole(9, NOW) and not exports.writes_whole(3, NOW) and exports.writes_whole(3, NOW, True)
    double = n.unionByName(n).unionByName(_frame(spark, GRAPH_NODES, {"id": None}))
    assert key_report({"graph_nodes": double, "other": n}) == [("graph_nodes", 1, 2)] and rebuilt(double, ["project_id", "id"], ["label"]).count() == 2
    assert S.cached_git_metadata(str(tmp_path)) is S.cached_git_metadata(str(tmp_path))
