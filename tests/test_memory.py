import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowloom.operators import agent, changes, lifecycle
from knowloom.operators import memory as M
from knowloom.operators import search as S
from knowloom.operators.conflicts import conflict_pairs
from knowloom.tables import MEMORIES, MEMORY_RELATIONS, PROJECTS, SESSIONS

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)


def _ago(**kw):
    return (NOW - dt.timedelta(**kw)).replace(tzinfo=None)


def _mem(spark, *rows):
    base = {"project_id": "p", "category": "journal", "created_at": _ago(days=1), "pinned": False, "revision_count": 1, "duplicate_count": 0}
    return spark.createDataFrame([{**dict.fromkeys(MEMORIES.names), **base, **r} for r in rows], MEMORIES)


def test_pinned_rows_rank_first_with_a_lower_score(spark):
    m = _mem(spark, {"id": "a", "what": "microservice retry policy"}, {"id": "b", "what": "microservice retry policy", "pinned": True}, {"id": "c", "what": "other"}, {"id": "d", "what": "unrelated words"}, {"id": "e", "what": "more filler"})
    rows = S.search(m, "microservice retry", NOW).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a"] and rows[0].score < rows[1].score < 0


def test_hybrid_finds_what_strict_search_misses(spark):
    m = _mem(spark, {"id": "a", "what": "jwt authentication tokens with sha256 signing"}, {"id": "b", "what": "sqlite write-ahead-logging wal mode for concurrency"}, {"id": "c", "what": "filler"})
    q = "jwt authentication credentials"
    assert S.search(m, q, NOW).count() == 0
    assert [r.id for r in S.hybrid(m, q, NOW).collect()] == ["a"]
    assert S.search(m, '""', NOW).count() == 0 and [r.id for r in S.search(m, "write-ahead", NOW).collect()] == ["b"]


def test_search_agrees_with_the_embedded_index(spark):
    import sqlite3

    docs = [("alpha beta beta", "gamma", "alpha"), ("beta", "alphabet soup", ""), ("café crème", "beta gamma", "delta"), ("nothing here", "", "at all"), ("write ahead log", "beta", "gamma gamma")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(what, why, learned)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("insert into f values (?, ?, ?)", docs)
    m = _mem(spark, *[{"id": str(i + 1), "what": a, "why": b, "learned": c} for i, (a, b, c) in enumerate(docs)])
    for q, mode in [("alpha", "all"), ("beta gamma", "all"), ("alpha gamma", "any"), ("cafe", "all"), ("write-ahead", "all"), ("beta nothing", "any")]:
        want = dict(db.execute("select rowid, bm25(f, 10.0, 5.0, 2.0) from f where f match ?", (__import__("knowloom.functions.text", fromlist=["x"]).match_expression(q, mode),)).fetchall())
        got = {int(r.id): r.score for r in S.search(m, q, NOW, mode=mode, plain=True).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), (q, got, want)


def test_preflight_verdicts(spark):
    rule = {"id": "r", "category": "decision"}
    words = "Authentication using stateless JWT with server-side sessions"
    passing = _mem(spark, {**rule, "what": "Database migrations must be backward compatible"}, {"id": "x", "what": "filler"})
    assert S.preflight(passing, "Add session-based auth", "").count() == 0
    warn = _mem(spark, {**rule, "what": "Authentication uses stateless JWT with server-side sessions support"})
    assert [r.verdict for r in S.preflight(warn, "Implement session-based auth", words).collect()] == ["WARN"]
    block = _mem(spark, {**rule, "pinned": True, "what": "Stateless JWT authentication with server-side sessions is a pinned invariant"})
    assert [r.verdict for r in S.preflight(block, "Implement session-based auth", words).collect()] == ["BLOCK"]


def test_conflicts_and_their_increment(spark):
    titles = ["Use PostgreSQL for users data storage", "Replace PostgreSQL users storage with MongoDB", "Use PostgreSQL for logging systems"]
    m = _mem(spark, *[{"id": f"m{i}", "what": t, "created_at": _ago(days=9)} for i, t in enumerate(titles)], {"id": "n1", "what": "the"}, {"id": "n2", "what": "a"})
    p = spark.createDataFrame([("p", None, None, None, None, None)], PROJECTS)
    r = spark.createDataFrame([], MEMORY_RELATIONS)
    got = {(x.a, x.b): (round(x.similarity, 3), x.n_pairs) for x in conflict_pairs(m, p, r).collect()}
    assert got == {("m0", "m1"): (0.5, 1), ("n1", "n1"): (1.0, 1)}
    scanned = p.withColumn("last_conflict_scan_at", F.lit(_ago(days=0)))
    assert conflict_pairs(m, scanned, r).count() == 0
    new = m.unionByName(_mem(spark, {"id": "m9", "what": "Replace PostgreSQL users storage with MySQL", "created_at": _ago(days=-1)}))
    assert {(x.a, x.b) for x in conflict_pairs(new, scanned, r).collect()} == {("m0", "m9"), ("m1", "m9")}
    known = spark.createDataFrame([{"id": "r", "project_id": "p", "source_id": "m9", "target_id": "m0"}], MEMORY_RELATIONS)
    assert {(x.a, x.b) for x in conflict_pairs(new, scanned, known).collect()} == {("m1", "m9")}


def test_compaction(spark):
    rows = [{"id": f"m{i}", "topic_key": "architecture/database-wal", "revision_count": i + 1, "created_at": _ago(hours=2 - i), "what": f"v{i}", "why": f"x | y{i} | x", "learned": "l" if i else None, "session_id": "s" if i == 1 else None, "author": f"a{i}"} for i in range(3)]
    out = lifecycle.compact(_mem(spark, *rows, {"id": "z", "topic_key": "alone"})).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.what, r.why, r.learned, r.revision_count, r.duplicate_count, r.session_id, r.author) == ("v2", "x | y0 | y1 | y2", "l", 6, 3, "s", "a1")
    table = lifecycle.apply_compaction(_mem(spark, *rows), lifecycle.compact(_mem(spark, *rows)), NOW)
    assert S.active(table).count() == 1 and table.count() == 4


def test_timeline(spark):
    rows = [{"id": n, "created_at": _ago(minutes=10 - i)} for i, n in enumerate(["first", "second", "third", "fourth"])]
    anchors = spark.createDataFrame([("p", "second")], "project_id string, anchor_id string")
    assert {(r.id, r.position) for r in M.timeline(_mem(spark, *rows), anchors, 1, 1).collect()} == {("first", -1), ("third", 1)}


def test_prune(spark):
    rows = [{"id": "a", "created_at": _ago(days=200)}, {"id": "b"}, {"id": "c", "category": "decision", "created_at": _ago(days=200)}, {"id": "d", "pinned": True, "created_at": _ago(days=200)}]
    m = _mem(spark, *rows)
    assert [r.id for r in lifecycle.prune(m, NOW).collect()] == ["a"]
    assert {r.id for r in S.active(lifecycle.prune(m, NOW, apply=True)).collect()} == {"b", "c", "d"}


def test_updates_deletes_and_judgments(spark):
    m = _mem(spark, {"id": "a", "what": "w", "why": "y"}, {"id": "b", "what": "w"}, {"id": "g", "deleted_at": _ago(days=1)})
    ch = spark.createDataFrame([("p", "a", "new", ""), ("p", "g", "x", "x")], "project_id string, id string, what string, why string")
    out = {r.id: r for r in lifecycle.update(m, ch, NOW).collect()}
    assert (out["a"].what, out["a"].why, out["a"].revision_count) == ("new", "", 2) and out["b"].what == "w" and out["g"].what is None
    rel = lambda *rows: spark.createDataFrame([{"id": i, "project_id": "p", "source_id": s, "target_id": t, "relation_type": "supersedes", "created_at": _ago(hours=h)} for i, s, t, h in rows], MEMORY_RELATIONS)
    judged = lifecycle.judge(rel(("r1", "a", "b", 3)), rel(("r2", "a", "b", 2), ("r3", "a", "a", 1), ("r4", "a", "g", 1), ("r5", "b", "a", 1)), m)
    assert {r.id for r in judged.collect()} == {"r2", "r5"}
    keys = spark.createDataFrame([("p", "b")], "project_id string, id string")
    gone, kept = lifecycle.soft_delete(m, rel(("r1", "a", "b", 3), ("r2", "a", "x", 1)), keys, NOW)
    assert {r.id for r in S.active(gone).collect()} == {"a"} and [r.id for r in kept.collect()] == ["r2"]
    assert {r.id for r in lifecycle.hard_delete(m, keys).collect()} == {"a", "g"}
    assert lifecycle.pin(m, keys).where("pinned").count() == 1 and lifecycle.mark_reviewed(m, keys, NOW).where("review_after IS NOT NULL").count() == 1


def test_repeats_within_a_day_of_the_inserted_row(spark):
    rows = [{"id": f"m{i}", "what": "same", "created_at": _ago(hours=h)} for i, h in enumerate([100, 90, 77, 76, 60, 1])] + [{"id": "o", "what": "other", "created_at": _ago(hours=99)}, {"id": "t", "what": "same", "topic_key": "k", "created_at": _ago(hours=99)}]
    got = {r.id: (r.action, r.target_id) for r in lifecycle.repeated_saves(_mem(spark, *rows)).collect()}
    assert got == {"m0": ("insert", "m0"), "m1": ("bump", "m0"), "m2": ("bump", "m0"), "m3": ("insert", "m3"), "m4": ("bump", "m3"), "m5": ("insert", "m5"), "o": ("insert", "o")}


def test_consolidation_and_changes(spark):
    m = _mem(spark, {"id": "a"}, {"id": "b", "project_id": "q"})
    p = spark.createDataFrame([("p",) + (None,) * 5, ("q",) + (None,) * 5], PROJECTS)
    out = lifecycle.consolidate({"memories": m, "projects": p}, "q", "p")
    assert {r.project_id for r in out["memories"].collect()} == {"p"} and out["projects"].count() == 1
    assert lifecycle.delete_project({"memories": m, "projects": p}, "p")["memories"].count() == 1
    assert lifecycle.empty_projects(p, m.where("project_id = 'p'")).first().id == "q"
    schema = "project_id string, id string, slug string, status string, title string, where_path string, tasks string, created_at timestamp, updated_at timestamp, archived_at timestamp"
    c = spark.createDataFrame([("p", "1", "s", "draft", "t", "pkg/a", "- [x] a\n- [ ] b", _ago(days=1), None, None), ("p", "2", "s", "archived", "t", "pkg/a", "", _ago(days=1), None, None)], schema)
    moved = changes.move_changes(c, spark.createDataFrame([("p", "1", "applied"), ("p", "2", "nonsense")], "project_id string, id string, to_status string"), NOW)
    assert {r.id: (r.status, r.archived_at is None) for r in moved.collect()} == {"1": ("applied", False), "2": ("archived", True)}
    assert [(r.id, r.progress) for r in lifecycle.active_changes(c, "PKG").collect()] == [("1", "1/2 (50%)")]
    states = M.state_counts(c, p, M.CHANGE_STATES).where("project_id = 'p' AND n > 0").collect()
    assert {(r.status, r.n) for r in states} == {("draft", 1), ("archived", 1)}


def test_bundle_skips_what_is_shown_and_follows_the_goal(spark):
    rows = [{"id": f"d{i}", "category": "decision", "what": "plain" if i else "tune the ledger cache", "created_at": _ago(days=i + 1 if i else 50)} for i in range(6)]
    rows += [{"id": "pin", "category": "decision", "pinned": True}, {"id": "s", "category": "qa", "session_id": "s1"}]
    ses = spark.createDataFrame([("s1", "p", None, None, None, "completed", _ago(days=2), _ago(days=1))], SESSIONS)
    m = _mem(spark, *rows)
    assert [r.id for r in M.bundle(m, ses).orderBy("rank").collect()] == ["d1", "d2"]
    assert [r.id for r in M.bundle(m, ses, "ledger cache").orderBy("rank").collect()][0] == "d0"


def test_agents_fail_open(spark):
    cands = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "id string, what string, why string")
    assert agent.recall(cands, "q", None) == ([r.asDict() for r in cands.collect()], False)
    rows, used = agent.recall(cands, "q", lambda _: 'Sure: [{"id": "b", "reason": "fits"}, {"id": "zz"}]')
    assert used and [(r["id"], r["reason"]) for r in rows] == [("b", "fits")]
    assert not agent.recall(cands, "q", lambda _: 1 / 0)[1] and not agent.recall(cands, "q", lambda _: "none")[1]
    pairs = spark.createDataFrame([("p", "a", "b", "1", "2"), ("p", "c", "d", "x", "2"), ("p", "e", "f", "boom", "2")], "project_id string, a string, b string, what_a string, what_b string")

    def fake(prompt):
        if "boom" in prompt:
            raise RuntimeError
        return '{"verdict": "not_conflict"}' if '"x"' in prompt else 'ok {"verdict": "supersedes", "reason": "r"} done'

    judged = agent.judge_pairs(pairs, fake)
    assert tuple(agent.tally(judged).first()) == (1, 1, 1)
