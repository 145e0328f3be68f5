import datetime as dt
import random

import numpy as np

from knowloom.llm.survivorship import best_members, memory_claims, surviving_records, truth_model
from knowloom.tables import MEMORIES

CLAIMS = "project_id string, topic_key string, field_name string, source string, value string"


def _best(spark, rows):
    df = spark.createDataFrame(rows, MEMORIES)
    return {(r.project_id, r.topic_key, r.field_name): r.memory_id for r in best_members(df).collect()}


def test_ranking_filling_and_topic_forms(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    row = lambda i, key, **kw: {"id": i, "project_id": "p", "topic_key": key} | kw
    rows = [
        row("b", "QA / Cold__Loader ", revision_count=3, last_seen_at=t(2), author="n/a", impact="High."),
        row("a", "qa/cold-loader", revision_count=3, last_seen_at=t(2), author=" ", impact="Low.", git_commit="--"),
        row("c", "qa/cold loader", revision_count=9, deleted_at=t(3), author="gone"),
        row("d", "-qa/cold - loader", revision_count=None, last_seen_at=t(9), author="dora", next_steps="TBD"),
        row("e", "alone"),
        row("f", " "), row("g", ""), row("h", None), row("i", "- _"),
    ]
    assert _best(spark, rows) == {("p", "qa/cold-loader", "record"): "a", ("p", "qa/cold-loader", "author"): "d", ("p", "qa/cold-loader", "impact"): "a"}


def test_nulls_last_and_ties(spark):
    rows = [{"id": i, "project_id": None, "topic_key": "k", "revision_count": 1, "last_seen_at": s} for i, s in [("z", None), ("y", dt.datetime(2020, 1, 1)), ("x", None)]]
    assert _best(spark, rows) == {(None, "k", "record"): "y"}
    assert _best(spark, []) == {}


def _reference_em(claims, rounds=8):
    cells, asserted, sources = {}, {}, {}
    for p, k, f, s, v in set(claims):
        cells.setdefault((p, k, f), set()).add(s)
        if v is not None:
            asserted.setdefault((p, k, f, v), set()).add(s)
    belief = {x: len(a) / len(cells[x[:3]]) for x, a in asserted.items()}
    for _ in range(rounds):
        q = {}
        for s in {s for c in cells.values() for s in c}:
            tp = t = tn = n = 0.0
            for x, p in belief.items():
                if s in cells[x[:3]]:
                    t, n = t + p, n + 1 - p
                    tp, tn = (tp + p, tn) if s in asserted[x] else (tp, tn + 1 - p)
            q[s] = ((tp + 3) / (t + 5), (tn + 9) / (n + 10))
        for x in belief:
            o = sum(np.log(q[s][0] / (1 - q[s][1])) if s in asserted[x] else np.log((1 - q[s][0]) / q[s][1]) for s in cells[x[:3]])
            belief[x] = 1 / (1 + np.exp(-o))
    return belief


def test_truth_model_matches_plain_em_and_keeps_several_values(spark):
    rnd = random.Random(2)
    claims = []
    for g in range(40):
        for s in range(6):
            good = rnd.random() < (0.95 if s < 4 else 0.3)
            claims.append(("p", f"t{g}", "f", f"s{s}", "yes" if good else rnd.choice(["no", "maybe", None])))
            if s < 4 and g % 2:
                claims.append(("p", f"t{g}", "f", f"s{s}", "also"))
    got = truth_model(spark.createDataFrame(claims + claims[:9], CLAIMS)).collect()
    want = _reference_em(claims)
    assert {(r.project_id, r.topic_key, r.field_name, r.value) for r in got} == set(want)
    assert all(abs(r.probability - want[r.project_id, r.topic_key, r.field_name, r.value]) < 1e-4 for r in got)
    kept = {(r.topic_key, r.value) for r in got if r.retained}
    assert sum((f"t{g}", "yes") in kept for g in range(40)) >= 38 and ("t1", "also") in kept and ("t1", "yes") in kept


def test_truth_model_nulls_and_empty(spark):
    assert truth_model(spark.createDataFrame([], CLAIMS)).count() == 0
    got = truth_model(spark.createDataFrame([(None, "t", "f", "s", "v"), (None, "t", "f", "u", None), ("p", "t", "f", "s", None)], CLAIMS)).collect()
    assert [(r.project_id, r.value, r.n_sources) for r in got] == [(None, "v", 1)]


def test_claims_drop_stand_ins(spark):
    df = spark.createDataFrame([{"id": "a", "project_id": "p", "topic_key": "K", "author": "Ann", "impact": " High ", "git_commit": "?"}], MEMORIES)
    assert {(r.field_name, r.source, r.value) for r in memory_claims(df).collect()} == {("impact", "ann", "High"), ("git_commit", "ann", None), ("errors_faced", "ann", None), ("next_steps", "ann", None)}


def test_surviving_records_carry_choice_and_belief(spark):
    row = lambda i, rev, author, impact, steps=None: {"id": i, "project_id": "p", "topic_key": "t", "revision_count": rev, "author": author, "impact": impact, "next_steps": steps}
    rows = [row("a", 9, "ann", " odd "), row("b", 5, "bob", "usual"), row("c", 4, "cid", "usual"), row("d", 3, "dan", "usual", "go on"), row("e", 2, "eve", "usual")]
    rows += [row("f", 1, "ann", "alone") | {"topic_key": "u"}, {"id": "n1", "topic_key": "k", "impact": "x", "author": "q"}, {"id": "n2", "topic_key": "K", "author": "r"}]
    got = {(r.topic_key, r.field_name, r.value): r for r in surviving_records(spark.createDataFrame(rows, MEMORIES)).collect()}
    first, usual = got["t", "impact", "odd"], got["t", "impact", "usual"]
    assert first.chosen and first.memory_id == "a" and not usual.chosen and usual.retained and usual.probability > first.probability and usual.n_sources == 4
    assert got["t", "next_steps", "go on"].chosen and got["k", "impact", "x"].chosen and got["k", "impact", "x"].project_id is None
    assert not any(k[0] == "u" for k in got)  # a group of one has no record
    assert surviving_records(spark.createDataFrame([], MEMORIES)).count() == 0
