import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowloom.functions import code, scalar, text
from knowloom.operators.search import phrases, plain_tokens


def _one(spark, value, column, schema="c string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "title, want",
    [
        ("Use clean architecture in Golang service", ["clean", "architecture", "golang", "service"]),
        ("Fixed memory leak in connection pool", ["fixed", "memory", "leak", "connection", "pool"]),
        ("a an the", []), ("", []), (None, []), ("é ü graph-store_x", ["é", "ü", "graph-store_x"]),
    ],
)
def test_title_tokens(spark, title, want):
    assert _one(spark, title, text.title_tokens(F.col("c"))) == want


@pytest.mark.parametrize("a, b, want", [("ab", "ab", 1.0), ("ab", "ac", 1 / 3), ("a", "b", 0.0), ("", "", 1.0), ("abc", "ab", 2 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>")
    assert abs(df.select(scalar.jaccard(F.col("a"), F.col("b")).alias("x")).first().x - want) < 1e-12


@pytest.mark.parametrize(
    "query, mode, want",
    [
        ("graph-store protocol", "all", '"graph-store"* "protocol"*'), ("foo AND bar", "any", '"foo"* OR "AND"* OR "bar"*'), ("-WAL memory (", "all", '"-WAL"* "memory"* "("'),
        ("a protocol", "all", '"a" "protocol"*'), ('""', "all", ""), ('foo """ bar', "all", '"foo"* "bar"*'),
    ],
)
def test_match_expressions(query, mode, want):
    assert text.match_expression(query, mode) == want


def test_phrases_and_folding():
    assert [p.tokens for p in phrases("write-ahead Élan (")] == [("write", "ahead"), ("elan",)]
    assert plain_tokens("Zoë's naïve_test") == ["zoe", "s", "naive", "test"]


KEY = "A" * 48


@pytest.mark.parametrize(
    "dirty, clean",
    [
        (f"key sk-{KEY} end", "key [REDACTED_SECRET] end"), (f"sk-ant-{'b' * 30}", "[REDACTED_SECRET]"), (f"AIzaSy{'c' * 33}", "[REDACTED_SECRET]"), ("eyJhb.eyJzd.sig_x", "[REDACTED_SECRET]"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED_SECRET]"), ("postgres://me:pw@h/db", "postgres://me:[REDACTED_SECRET]@h/db"),
        ('password = "abcdefghijkl"', 'password = "[REDACTED_SECRET]"'), ("API_KEY=abcdefghijkl", "API_KEY=[REDACTED_SECRET]"), ("token: short", "token: short"), ("", ""), (None, None),
    ],
)
def test_redaction(spark, dirty, clean):
    assert _one(spark, dirty, text.redact(F.col("c"))) == clean


@pytest.mark.parametrize("p, want", [("./a/b.go", "a/b.go"), ("a\\b.go", "a/b.go"), ("db.go:42", "db.go"), ("db.go:42:10", "db.go"), ("a:b", "a:b"), ("pkg:1x", "pkg:1x"), ("  ", ""), (None, None)])
def test_node_path(spark, p, want):
    assert _one(spark, p, text.node_path(F.col("c"))) == want


def test_topic_key_cuts_whole_characters(spark):
    long = _one(spark, "é" * 100, text.topic_key(F.lit("qa"), F.col("c")))
    assert len(long.encode()) <= 80 and long == "qa/" + "é" * 38
    assert _one(spark, "Fix -- the_thing!  now ", text.topic_key(F.lit("bugfix"), F.col("c"))) == "bugfix/fix-the-thing-now"


def test_truncate_labels_and_budget(spark):
    from knowloom.sinks.exports import within_budget

    assert _one(spark, "éabcdef", text.truncate(F.col("c"), 3)) == "éab... [truncated 4 chars]"
    assert _one(spark, "x" * 70, text.short_label(F.col("c"))) == "x" * 64 + "…"
    assert _one(spark, "ab\ncd\nefgh", within_budget(F.col("c"), 2)) == "ab\ncd\n... [truncated to fit the token budget]"


def test_rfc2119_whole_words_and_negation(spark):
    assert _one(spark, "It must not fail, MUSTACHE shall grow. may", text.rfc2119(F.col("c"))) == ["MUST NOT", "SHALL", "MAY"]
    assert _one(spark, None, text.rfc2119(F.col("c"))) == []


def test_tasks(spark):
    assert _one(spark, "- [ ] a\n- [x] b\n - [X] c\n* [x] d\nplain", text.task_summary(F.col("c"))) == "3/4 (75%)"
    assert _one(spark, "none", text.task_summary(F.col("c"))) == ""


def test_ages_are_truncated_days(spark):
    now = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 9, 11),), (dt.datetime(2024, 1, 9, 13),), (dt.datetime(2024, 1, 11, 11),), (None,)], "t timestamp")
    assert [r.x for r in df.select(scalar.age_days(now, F.col("t")).alias("x")).collect()] == [1, 0, 0, None]


def test_subword_cosines(spark):
    q = scalar.query_terms("jwt token authentication")
    assert _one(spark, "jwt auth tokens", scalar.cosine_to(q, F.col("c"))) > 0.3
    assert _one(spark, "unrelated database migration", scalar.cosine_to(q, F.col("c"))) < 0.2
    assert _one(spark, "", scalar.cosine_to(q, F.col("c"))) == 0 and _one(spark, "x", scalar.cosine_to({}, F.col("c"))) == 0
    df = spark.createDataFrame([("a", "jwt auth tokens"), ("b", "")], "id string, what string")
    mine = {r.term: r.w for r in scalar.subword_vectors(df, "id", "what").collect()}
    dot = sum(v * mine.get(k, 0) for k, v in q.items())
    assert abs(dot - _one(spark, "jwt auth tokens", scalar.cosine_to(q, F.col("c")))) < 1e-9


def test_times_ids_and_json(spark):
    assert _one(spark, "2024-01-02T03:04:05+02:00", scalar.parse_time(F.col("c"))) == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert _one(spark, "soon", scalar.parse_time(F.col("c"))) is None
    assert len(_one(spark, "x", scalar.new_id(F.col("c")))) == 16
    assert _one(spark, '{"line": 7.9', scalar.json_long(F.col("c"), "line")) is None and _one(spark, '{"line": 7.9}', scalar.json_long(F.col("c"), "line")) == 7
    assert _one(spark, 'so {"a": [1]} ok', scalar.json_carve(F.col("c"))) == '{"a": [1]}' and _one(spark, "so [1, 2] ok", scalar.json_carve(F.col("c"), "[")) == "[1, 2]"


def test_imports_and_names(spark):
    df = spark.createDataFrame([("os.path", ".py"), ("net/http", ".go"), ("fs/promises", ".ts"), ("os", ".rb")], "i string, e string")
    assert [r.x for r in df.select(code.is_stdlib(F.col("i"), F.col("e")).alias("x")).collect()] == [True, True, True, False]
    assert _one(spark, "a\nb foo\nfoo", code.first_line(F.col("c"), F.lit(" foo "))) == 2
    assert _one(spark, "x/y/z.md", code.parent_prefix(F.col("c"))) == "../../"
