"""Scalar functions over whole tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions import code, scalar, text
from knowloom.plans import sqltext as q
from knowloom.tables import table

NOW = datetime.fromisoformat(q.AS_OF).replace(tzinfo=timezone.utc)
GOAL = "reduce retries and latency of the ledger cache"


def fn_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("clean"))


def fn_redact_rows(spark: SparkSession, d: str) -> DataFrame:
    cols = ["category", "what", "why", "where_path", "learned", "git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps", "session_id", "topic_key"]
    return table(spark, d, "memories").select("id", *[text.redact(F.col(c)).alias(c) for c in cols])


def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", F.array_join(text.title_tokens(F.col("what")), " ").alias("tokens"))


def fn_topic_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", text.topic_key(F.col("category"), F.col("what")).alias("suggested"))


def fn_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", text.truncate(F.col("learned"), 100).alias("short"), text.short_label(F.col("what")).alias("label"))


def fn_path(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "graph_edges").select(F.concat_ws(":", "source_id", "source_location").alias("p"))
    return table(spark, d, "memories").select(F.col("where_path").alias("p")).unionByName(edges).where("p IS NOT NULL").distinct().select("p", text.node_path(F.col("p")).alias("clean"))


def fn_escapes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("title")
    return table(spark, d, "documents").select(
        "doc_id", text.cypher_string(c).alias("cypher"), text.cypher_label(c).alias("label"), text.file_name(c).alias("file"),
        text.mermaid(c).alias("mermaid"), text.table_cell(c).alias("cell"), text.wiki_label(c).alias("wiki"),
    )


def fn_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    goal = [t for t in GOAL.split() if t not in text.STOP_WORDS]
    return table(spark, d, "memories").select("id", text.keyword_score(goal, F.col("what"), F.col("why")).cast("int").alias("score"))


def fn_rfc2119(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.rfc2119(F.col("text")), ",").alias("words"))


def fn_language(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "graph_nodes").select(
        "project_id", "id", code.language(p).alias("language"), code.language_group(p).alias("grp"), code.is_entry_point(p).alias("entry_point"),
        code.parent_prefix(p).alias("up"), code.is_symbol_name(F.col("label")).alias("symbol"),
    )


def fn_imports(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "graph_nodes").where("node_type = 'package'").select(F.col("label").alias("imported"))
    std = spark.createDataFrame([(x,) for v in code.STDLIB.values() for x in v] + [("net/http",), ("os.path",), ("fs/promises",), ("./a",), ("/b",), (" ",), ("a b",)], "imported string")
    exts = F.explode(F.array(*[F.lit(e) for e in (".go", ".py", ".ts", ".rb")]))
    return names.unionByName(std).distinct().select("imported", exts.alias("ext")).select("imported", "ext", code.is_stdlib(F.col("imported"), F.col("ext")).alias("stdlib"), code.is_external(F.col("imported")).alias("external"))


def fn_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", scalar.content_hash(*[F.col(c) for c in ("what", "why", "learned", "where_path")]).alias("hash"), scalar.new_id(F.col("project_id"), F.col("what")).alias("new_id"))


def fn_review(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    return m.select("id", scalar.review_after(F.col("category"), F.col("created_at")).alias("due"), scalar.age_days(NOW, F.col("created_at")).alias("age"), scalar.age_days(NOW, F.col("review_after")).alias("overdue"))


def fn_weights(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    return m.select("id", F.round(scalar.recency(NOW, F.col("created_at")), 9).alias("recency"), F.round(scalar.importance(F.col("pinned"), F.col("category"), F.col("revision_count")), 6).alias("importance"))


def fn_jaccard(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    s = scalar.jaccard(text.title_tokens(F.col("what")), text.title_tokens(F.col("why")))
    return m.select("id", F.round(s, 9).alias("similarity"), scalar.round2(s).alias("rounded"))


def fn_subwords(spark: SparkSession, d: str) -> DataFrame:
    v = scalar.subword_vectors(table(spark, d, "memories"), "id", "what")
    return v.select("id", "term", F.round("w", 9).alias("w"))


def fn_dense_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(scalar.dense_cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


def fn_json(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return table(spark, d, "graph_nodes").select("project_id", "id", scalar.json_long(m, "line").alias("line"), scalar.json_long(m, "community_id").alias("community"), scalar.json_double(m, "betweenness_centrality").alias("centrality"))


def fn_json_carve(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("Verdict: "), F.col("metadata"), F.lit(" as asked"))
    return table(spark, d, "graph_nodes").where("metadata IS NOT NULL").select("project_id", "id", scalar.json_carve(wrapped).alias("carved"))


def fn_parse_time(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    a = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    b = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return m.select("id", scalar.parse_time(a).alias("rfc"), scalar.parse_time(b).alias("plain"), scalar.parse_time(F.col("what")).alias("none"))


QUERIES = {
    "fn_01_redact": fn_redact, "fn_02_tokens": fn_tokens, "fn_03_topic_key": fn_topic_key, "fn_04_truncate": fn_truncate, "fn_06_path": fn_path,
    "fn_08_escapes": fn_escapes, "fn_09_keyword_score": fn_keyword_score, "fn_10_rfc2119": fn_rfc2119, "fn_11_imports": fn_imports, "fn_12_language": fn_language,
    "fn_16_redact_rows": fn_redact_rows, "fn_20_hash": fn_hash, "fn_22_parse_time": fn_parse_time, "fn_23_review": fn_review, "fn_25_weights": fn_weights,
    "fn_27_jaccard": fn_jaccard, "fn_28_subwords": fn_subwords, "fn_29_dense_cosine": fn_dense_cosine, "fn_32_json": fn_json, "fn_34_json_carve": fn_json_carve,
}

_ROWS = ["category", "what", "why", "where_path", "learned", "git_branch", "git_commit", "author", "impact", "errors_faced", "next_steps", "session_id", "topic_key"]
_ESC = {"\\": "\\\\", '"': '\\"', "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
_HTML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&#39;", '"': "&#34;", "|": "\\|"}


def _char(x: str) -> str:
    return f"chr({ord(x)})" if ord(x) < 32 else q.quote(x)


def _replaced(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, {_char(a)}, {q.quote(b)})"
    return c


_TOPIC = r"regexp_replace(regexp_replace(category || '/' || regexp_replace(regexp_replace(lower(what), '[ _-]', '-', 'g'), '[^\p{L}\p{Nd}-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g')"
_STD = {".go": "go", ".py": "python", ".ts": "node"}

SQL = {
    "fn_01_redact": f"SELECT doc_id, {q.redact('text')} AS clean FROM documents",
    "fn_02_tokens": f"SELECT id, array_to_string({q.title_tokens('what')}, ' ') AS tokens FROM memories",
    "fn_03_topic_key": rf"""WITH k AS (SELECT id, {_TOPIC} AS k FROM memories)
        SELECT id, regexp_replace(CASE WHEN strlen(k) <= 80 THEN k ELSE list_filter(list_transform(range(80, 19, -1), lambda n: substring(k, 1, n)), lambda s: strlen(s) <= 80)[1] END, '-+$', '') AS suggested FROM k""",
    "fn_04_truncate": f"""SELECT id, CASE WHEN length(learned) > 100 THEN substring(learned, 1, 100) || '... [truncated ' || (length(learned) - 100) || ' chars]' ELSE learned END AS short,
        CASE WHEN length({q.trim('what')}) > 64 THEN substring({q.trim('what')}, 1, 64) || '…' ELSE {q.trim('what')} END AS label FROM memories""",
    "fn_06_path": f"""SELECT p, {q.node_path('p')} AS clean FROM (SELECT where_path AS p FROM memories UNION SELECT concat_ws(':', source_id, source_location) FROM graph_edges) WHERE p IS NOT NULL""",
    "fn_08_escapes": f"""SELECT doc_id, {_replaced('title', _ESC)} AS cypher, upper(translate(title, '- /.', '____')) AS label, translate(title, '/\\:*?"<>|', '_________') AS file,
        '"' || replace(title, '\\', '/') || '"' AS mermaid, replace(replace(title, '|', '\\|'), chr(10), ' ') AS cell, {_replaced('title', _HTML)} AS wiki FROM documents""",
    "fn_09_keyword_score": "SELECT id, CAST(" + " + ".join(f"CAST(contains(lower(coalesce(what, '') || ' ' || coalesce(why, '')), {q.quote(t)}) AS INT)" for t in GOAL.split() if t not in text.STOP_WORDS) + " AS INT) AS score FROM memories",
    "fn_10_rfc2119": f"SELECT doc_id, array_to_string({q.rfc2119('text')}, ',') AS words FROM documents",
    "fn_11_imports": f"""WITH i AS (SELECT label AS imported FROM graph_nodes WHERE node_type = 'package' UNION SELECT unnest([{q.names([x for v in code.STDLIB.values() for x in v] + ['net/http', 'os.path', 'fs/promises', './a', '/b', ' ', 'a b'])}])),
        e AS (SELECT imported, unnest(['.go', '.py', '.ts', '.rb']) AS ext FROM i)
        SELECT imported, ext, CASE ext {' '.join(f"WHEN {q.quote(k)} THEN {'regexp_extract(imported, $$^([^.]+|[.])$$, 1)' if k == '.py' else 'regexp_extract(imported, $$^([^/]+|/)$$, 1)'} IN ({q.names(code.STDLIB[v])})" for k, v in _STD.items())} ELSE false END AS stdlib,
        NOT regexp_matches(imported, '^[./]') AND NOT regexp_matches(imported, '[ \\t\\n\\r]') AND trim(imported) <> '' AS external FROM e""",
    "fn_12_language": f"""SELECT project_id, id, {q.looked_up(code.LANGUAGES, q.extension('path'))} AS language, {q.language_group('path')} AS grp,
        string_split(path, '/')[-1] IN ({q.names(code.ENTRY_POINTS)}) AS entry_point, repeat('../', len(string_split(path, '/')) - 1) AS up,
        coalesce(NOT regexp_matches(label, '[{{}}()\\[\\] \\t\\n\\r=+*/%<>&|!^~]') AND regexp_matches(label, '[A-Za-z0-9_]'), false) AS symbol FROM graph_nodes""",
    "fn_16_redact_rows": "SELECT id, " + ", ".join(f"{q.redact(c)} AS {c}" for c in _ROWS) + " FROM memories",
    "fn_20_hash": "SELECT id, sha256(coalesce(what, '') || chr(0) || coalesce(why, '') || chr(0) || coalesce(learned, '') || chr(0) || coalesce(where_path, '')) AS hash, substring(sha256(concat_ws(chr(31), project_id, what)), 1, 16) AS new_id FROM memories",
    "fn_22_parse_time": "SELECT id, created_at AS rfc, date_trunc('second', created_at) AS plain, CAST(NULL AS TIMESTAMPTZ) AS none FROM memories",
    "fn_23_review": f"SELECT id, created_at + to_days({q.review_days('category')}) AS due, {q.age_days('created_at')} AS age, {q.age_days('review_after')} AS overdue FROM memories",
    "fn_25_weights": f"SELECT id, round({q.recency('created_at')}, 9) AS recency, round({q.importance('pinned', 'category', 'revision_count')}, 6) AS importance FROM memories",
    "fn_27_jaccard": f"SELECT id, round(s, 9) AS similarity, floor(s * 100 + 0.5) / 100 AS rounded FROM (SELECT id, {q.jaccard(q.title_tokens('what'), q.title_tokens('why'))}::DOUBLE AS s FROM memories)",
    "fn_28_subwords": f"""WITH w AS (SELECT id, unnest(list_filter({q.raw_tokens('what')}, lambda x: x NOT IN ({q.names(text.STOP_WORDS)}))) AS w FROM memories),
        t AS (SELECT id, 'w:' || w AS term, 2.0::DOUBLE AS v FROM w UNION ALL SELECT id, 'g:' || substring(w, i, 3), 0.5::DOUBLE FROM (SELECT id, w, CAST(unnest(range(1, length(w) - 1)) AS INT) AS i FROM w)),
        s AS (SELECT id, term, sum(v) AS v FROM t GROUP BY ALL)
        SELECT id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 9) AS w FROM s""",
    "fn_29_dense_cosine": "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(f AS DOUBLE[])), 6) AS cosine FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY label) USING (label)",
    "fn_32_json": """SELECT project_id, id, CAST(floor(TRY_CAST(json_extract_string(m, '$.line') AS DOUBLE)) AS BIGINT) AS line, CAST(floor(TRY_CAST(json_extract_string(m, '$.community_id') AS DOUBLE)) AS BIGINT) AS community,
        TRY_CAST(json_extract_string(m, '$.betweenness_centrality') AS DOUBLE) AS centrality FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM graph_nodes)""",
    "fn_34_json_carve": r"SELECT project_id, id, nullif(regexp_extract('Verdict: ' || metadata || ' as asked', '(?s)(\{.*\})', 1), '') AS carved FROM graph_nodes WHERE metadata IS NOT NULL",
}
