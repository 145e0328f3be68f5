import random

from knowloom.llm.mixing import class_weight, expected_copies, mix, plan_quotas, share_report

SIZES = "doc_id bigint, source string, n_tokens bigint"


def _docs(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choices(["big", "mid", "small", "unnamed", None], [60, 25, 5, 5, 5])[0]
        rows.append((i, s, max(0, int(rnd.lognormvariate(5, 1)))))
    return spark.createDataFrame(rows, SIZES), rows


TARGETS = [("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 4), ("absent", 0.1, 2)]


def test_shares_are_met_within_a_document(spark):
    df, rows = _docs(spark)
    got = mix(df, TARGETS).collect()
    total = sum(r.copies * r.n_tokens for r in got)
    assert len({r.doc_id for r in got}) == len(got)
    for s, w, m in TARGETS[:3]:
        mine = [r for r in got if r.source == s]
        assert max(r.copies for r in mine) <= m and min(r.copies for r in mine) >= 1
        assert abs(sum(r.copies * r.n_tokens for r in mine) / total - w / 0.9) < 0.01
    assert {r.source for r in got} == {"big", "mid", "small"}
    report = {r.source: r for r in share_report(mix(df, TARGETS), TARGETS).collect()}
    assert report["absent"].share_reached == 0 and abs(sum(r.share_reached for r in report.values()) - 1) < 1e-5


def test_the_draw_repeats_and_follows_the_seed(spark):
    df, _ = _docs(spark, 1500)
    one = sorted(map(tuple, mix(df, TARGETS).collect()))
    assert one == sorted(map(tuple, mix(df.repartition(7), TARGETS).collect()))
    assert one != sorted(map(tuple, mix(df, TARGETS, seed=12).collect()))


def test_too_large_a_total_reaches_the_caps(spark):
    df, rows = _docs(spark, 800)
    got = mix(df, TARGETS, total=1e9).collect()
    for s, _, m in TARGETS[:3]:
        assert {r.copies for r in got if r.source == s} == {m}
        assert len([r for r in got if r.source == s]) == sum(1 for x in rows if x[1] == s and x[2] > 0)


def test_expected_copies_add_up_and_keep_the_cap():
    tokens = {4: 100, 20: 5000, 40: 90_000}
    for quota in (10, 3000, 95_100, 150_000, 190_000, 400_000):
        x = expected_copies(tokens, quota, 2)
        assert abs(sum(x[c] * n for c, n in tokens.items()) - min(quota, 2 * 95_100)) < 1e-6 and max(x.values()) <= 2 + 1e-9
        assert x[4] <= x[20] <= x[40]
    assert class_weight(24) == 0.5


def test_quotas_without_documents_or_repeats():
    q = plan_quotas({"a": 100, "b": 0}, [("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 1), ("d", None, 1), (None, 0.1, 1)], None)
    assert q == {"a": (1.0, 200.0, 2)} and plan_quotas({}, [("a", 1.0, 1)], None) == {}


def test_empty_null_and_zero(spark):
    assert mix(spark.createDataFrame([], SIZES), TARGETS).count() == 0
    df = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, "a", 5), (4, None, 5)], SIZES)
    assert [tuple(r) for r in mix(df, [("a", 1.0, 3), ("a", 1.0, 2)]).collect()] == [(3, "a", 2, 5)]


def test_heavier_documents_are_drawn_more_often(spark):
    df = spark.range(0, 4000).selectExpr("id AS doc_id", "'a' AS source", "case when id % 2 = 0 then 8 else 512 end AS n_tokens")
    got = mix(df, [("a", 1.0, 1)], total=500_000).groupBy("n_tokens").count().collect()
    n = {r.n_tokens: r["count"] for r in got}
    assert 5 < n[512] / n[8] < 12  # weights 512/576 and 8/72
