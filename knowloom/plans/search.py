"""Search, ranking and title similarity, for all projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions import scalar, text
from knowloom.operators import search as S
from knowloom.operators.conflicts import conflict_pairs, entered_links, title_classes
from knowloom.plans import sqltext as q
from knowloom.plans.functions import NOW
from knowloom.runtime import cut, exists
from knowloom.tables import table

STRICT = "retry ledger"
LOOSE = "ledger cache write-ahead retries"
TITLE = "Adopt meadow-sampler as the only partition exporter"


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories")


_INDEXES: dict[tuple[str, str], tuple[list[str], S.SearchIndex]] = {}


def _index(spark: SparkSession, d: str) -> S.SearchIndex:
    """The postings of the memories at hand, built by an application's first search of a folder and kept as long as its files stay the same."""
    m = _m(spark, d)
    key, files = (spark.sparkContext.applicationId, d), sorted(m.inputFiles())
    held = _INDEXES.get(key)
    if held is None or held[0] != files or not exists(spark, held[1].postings):
        held = _INDEXES[key] = (files, S.build_index(m))
    return held[1]


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def sea_all(spark: SparkSession, d: str) -> DataFrame:
    return _scored(S.search(_m(spark, d), STRICT, NOW, index=_index(spark, d)))


def sea_any(spark: SparkSession, d: str) -> DataFrame:
    return _scored(S.search(_m(spark, d), LOOSE, NOW, mode="any", category="decision", limit=5, offset=2, index=_index(spark, d)))


def sea_plain(spark: SparkSession, d: str) -> DataFrame:
    return _scored(S.search(_m(spark, d), STRICT, NOW, plain=True, index=_index(spark, d)))


def sea_browse(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_m(spark, d), "", NOW, path="PKG/", limit=4, offset=1).drop("score")


def sea_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _scored(S.hybrid(_m(spark, d), LOOSE, NOW, index=_index(spark, d)))


def sea_similar(spark: SparkSession, d: str) -> DataFrame:
    return S.similar_titles(_m(spark, d), TITLE, limit=5, threshold=0.2, index=_index(spark, d))


def sea_preflight(spark: SparkSession, d: str) -> DataFrame:
    return S.preflight(_m(spark, d), TITLE, "use one exporter for each partition", threshold=0.2, index=_index(spark, d))


def sea_similar_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = conflict_pairs(_m(spark, d), table(spark, d, "projects"), table(spark, d, "memory_relations"))
    return found.withColumn("similarity", F.round("similarity", 9))


def entered(spark: SparkSession, d: str) -> DataFrame:
    """What an applying scan enters for the pairs of classes."""
    m, r = _m(spark, d), table(spark, d, "memory_relations")
    return entered_links(cut(conflict_pairs(m, table(spark, d, "projects"), r), "conflicts"), m, r).withColumn("similarity", F.round("similarity", 9))


def sim_classes(spark: SparkSession, d: str) -> DataFrame:
    return title_classes(_m(spark, d)).select("project_id", "id", "class_id")


QUERIES = {
    "sea_01_bm25_all": sea_all, "sea_01_bm25_any": sea_any, "sea_02_plain": sea_plain, "sea_03_hybrid": sea_hybrid, "sea_04_similar": sea_similar,
    "sea_05_preflight": sea_preflight, "flt_06_path_browse": sea_browse, "join_10_conflict_pairs": sea_similar_conflicts, "join_10_classes": sim_classes,
    "join_10_entered": entered,
}

_COMPACT = "category, what, topic_key, revision_count, duplicate_count, created_at"


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(translate(lower(coalesce({c}, '')), '{S.MARKED}', '{S.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _hits(col: str, p: S.Phrase) -> str:
    last = len(p.tokens) - 1
    one = lambda x, k: f"starts_with({x}, {q.quote(p.tokens[k])})" if p.prefix and k == last else f"{x} = {q.quote(p.tokens[k])}"
    if last == 0:
        return f"len(list_filter({col}, lambda x: {one('x', 0)}))"
    all_ = " AND ".join(one(f"{col}[i + {k}]", k) for k in range(last + 1))
    return f"len(list_filter(range(1, len({col}) - {last - 1}), lambda i: {all_}))"


def _bm25(wanted: list[S.Phrase], weights: tuple[float, ...] = S.WEIGHTS) -> str:
    """CTEs that end in s: all columns of memories, matched and bm25."""
    f = ", ".join("(" + " + ".join(f"{_hits(f't{i}', p)} * {w}::DOUBLE" for i, w in enumerate(weights)) + f") AS f{k}" for k, p in enumerate(wanted))
    stats = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(wanted)))
    idf = lambda k: f"(CASE WHEN n{k} + 0.5 < n - n{k} + 0.5 THEN ln((n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) ELSE 1e-6 END)"
    total = " + ".join(f"{idf(k)} * f{k} * {S.K1 + 1}::DOUBLE / (f{k} + {S.K1}::DOUBLE * ({1 - S.B}::DOUBLE + {S.B}::DOUBLE * len_ / mean))" for k in range(len(wanted)))
    matched = " + ".join(f"CAST(f{k} > 0 AS INT)" for k in range(len(wanted)))
    return f"""WITH t AS (SELECT *, {_tokens('what')} AS t0, {_tokens('why')} AS t1, {_tokens('learned')} AS t2 FROM memories),
        f AS (SELECT * EXCLUDE (t0, t1, t2), len(t0) + len(t1) + len(t2) AS len_, {f} FROM t),
        g AS (SELECT count(*) AS n, sum(len_) / count(*)::DOUBLE AS mean, {stats} FROM f),
        s AS (SELECT f.*, {matched} AS matched, -({total}) AS bm25 FROM f, g WHERE {matched} > 0 AND deleted_at IS NULL)"""


_TRI = f"bm25 * {q.importance('pinned', 'category', 'revision_count')} * {q.recency('created_at')}"
_ALL, _ANY, _SIM = S.phrases(STRICT), S.phrases(LOOSE), S.title_phrases(TITLE)
_PRE = S.title_phrases(TITLE + " use one exporter for each partition")


def _list(words: list[str]) -> str:
    return f"[{q.names(words)}]"


_QV = scalar.query_terms(LOOSE)
_QROWS = ", ".join(f"({q.quote(k)}, {v!r}::DOUBLE)" for k, v in _QV.items())
_COS = f"""w AS (SELECT id, unnest(list_filter({q.raw_tokens('what')}, lambda x: x NOT IN ({q.names(text.STOP_WORDS)}))) AS w FROM memories),
    vt AS (SELECT id, 'w:' || w AS term, 2.0::DOUBLE AS v FROM w UNION ALL SELECT id, 'g:' || substring(w, i, 3), 0.5::DOUBLE FROM (SELECT id, w, CAST(unnest(range(1, length(w) - 1)) AS INT) AS i FROM w)),
    v AS (SELECT id, term, sum(v) AS v FROM vt GROUP BY ALL), qv(term, qw) AS (VALUES {_QROWS}),
    c AS (SELECT id, least(1.0::DOUBLE, coalesce(sum(v * qw), 0::DOUBLE) / sqrt(sum(v * v))) AS cos FROM v LEFT JOIN qv USING (term) GROUP BY id)"""

_CONFLICTS = f"""WITH m AS (SELECT project_id, id, created_at, list_sort(list_distinct({q.title_tokens('what')})) AS tokens FROM memories WHERE deleted_at IS NULL),
        c AS (SELECT m.*, min(id) OVER (PARTITION BY project_id, tokens) AS class_id, (p.last_conflict_scan_at IS NULL OR m.created_at > p.last_conflict_scan_at) AS is_new
              FROM m LEFT JOIN (SELECT id AS pid, last_conflict_scan_at FROM projects) p ON p.pid = m.project_id),
        k AS (SELECT project_id, class_id, any_value(tokens) AS tokens, count(*) AS n, bool_or(is_new) AS has_new FROM c GROUP BY ALL),
        a AS (SELECT x.project_id, x.class_id AS a, y.class_id AS b, {q.jaccard('x.tokens', 'y.tokens')}::DOUBLE AS similarity, x.n * y.n AS all_pairs
              FROM k x JOIN k y ON x.project_id = y.project_id AND x.class_id < y.class_id AND (x.has_new OR y.has_new) AND list_has_any(x.tokens, y.tokens)),
        p AS (SELECT * FROM a WHERE similarity >= 0.45 UNION ALL SELECT project_id, class_id, class_id, 1.0, n * (n - 1) // 2 FROM k WHERE n > 1 AND has_new),
        l AS (SELECT DISTINCT project_id, least(source_id, target_id) AS x, greatest(source_id, target_id) AS y FROM memory_relations WHERE source_id <> target_id),
        n AS (SELECT l.project_id, least(u.class_id, v.class_id) AS a, greatest(u.class_id, v.class_id) AS b, count(*) AS n_linked FROM l JOIN c u ON u.project_id = l.project_id AND u.id = x JOIN c v ON v.project_id = l.project_id AND v.id = y GROUP BY ALL),
        cp AS (SELECT p.project_id, p.a, p.b, round(similarity, 9) AS similarity, CAST(all_pairs - coalesce(n_linked, 0) AS BIGINT) AS n_pairs FROM p LEFT JOIN n ON n.project_id = p.project_id AND n.a = p.a AND n.b = p.b WHERE all_pairs > coalesce(n_linked, 0)) """

SQL = {
    "sea_01_bm25_all": f"{_bm25(_ALL)} SELECT project_id, id, {_COMPACT.replace('what', q.redact('what') + ' AS what', 1)}, round({_TRI}, 6) AS score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {_TRI}, id) AS INT) AS rank FROM s WHERE matched = {len(_ALL)} QUALIFY rank <= 10",
    "sea_01_bm25_any": f"{_bm25(_ANY)} SELECT project_id, id, {_COMPACT.replace('what', q.redact('what') + ' AS what', 1)}, round({_TRI}, 6) AS score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {_TRI}, id) AS INT) AS rank FROM s WHERE category = 'decision' QUALIFY rank BETWEEN 3 AND 7",
    "sea_02_plain": f"{_bm25(_ALL)} SELECT project_id, id, {_COMPACT.replace('what', q.redact('what') + ' AS what', 1)}, round(bm25, 6) AS score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY bm25, id) AS INT) AS rank FROM s WHERE matched = {len(_ALL)} QUALIFY rank <= 10",
    "flt_06_path_browse": f"SELECT project_id, id, {_COMPACT.replace('what', q.redact('what') + ' AS what', 1)}, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank FROM memories WHERE deleted_at IS NULL AND contains(lower(where_path), 'pkg/') QUALIFY rank BETWEEN 2 AND 5",
    "sea_03_hybrid": f"""{_bm25(_ANY)}, {_COS},
        h AS (SELECT s.*, {_TRI} AS sc, matched = {len(_ANY)} AS strict, row_number() OVER (PARTITION BY project_id ORDER BY {_TRI}, id) AS rb FROM s),
        h2 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY strict DESC, sc, id) AS rs FROM h),
        p AS (SELECT h2.*, coalesce(cos, 0) AS cos FROM h2 LEFT JOIN c USING (id) WHERE (strict AND rs <= 10) OR (NOT strict AND rb <= 20 AND coalesce(cos, 0) >= 0.15)),
        r AS (SELECT *, CASE WHEN strict THEN sc WHEN sc = 0 THEN -cos ELSE sc * (1 + 0.5 * cos) END AS fs FROM p)
        SELECT project_id, id, {_COMPACT.replace('what', q.redact('what') + ' AS what', 1)}, round(fs, 6) AS score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY strict DESC, fs, id) AS INT) AS rank, strict FROM r QUALIFY rank <= 10""",
    "sea_04_similar": f"""{_bm25(_SIM, (1.0, 1.0, 1.0))},
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY bm25, id) AS rk FROM s QUALIFY rk <= 15),
        j AS (SELECT *, {q.jaccard(q.title_tokens(q.quote(TITLE)), q.title_tokens('what'))} AS sim FROM r)
        SELECT project_id, id, category, what, floor(sim * 100 + 0.5) / 100 AS similarity, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rk) AS INT) AS rank FROM j WHERE sim >= 0.2 QUALIFY rank <= 5""",
    "sea_05_preflight": f"""{_bm25(_PRE, (1.0, 1.0, 1.0))},
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pinned DESC NULLS LAST, bm25, id) AS rk FROM s WHERE category IN ('standard', 'decision', 'architecture') QUALIFY rk <= 30),
        j AS (SELECT *, {q.jaccard(q.title_tokens(q.quote(TITLE + ' use one exporter for each partition')), q.title_tokens('what'))} AS sim FROM r),
        i AS (SELECT project_id, id AS memory_id, category, what, coalesce(pinned, false) AS pinned, floor(sim * 100 + 0.5) / 100 AS similarity, CASE WHEN pinned THEN 'BLOCK' ELSE 'WARN' END AS severity FROM j WHERE sim >= 0.2)
        SELECT *, min(severity) OVER (PARTITION BY project_id) AS verdict FROM i""",
    "join_10_conflict_pairs": _CONFLICTS + "SELECT * FROM cp",
    "join_10_entered": _CONFLICTS + """, lk AS (SELECT project_id, a AS source_id, b AS target_id, similarity FROM cp WHERE a <> b
        UNION ALL SELECT project_id, class_id, id, 1.0 FROM c WHERE id <> class_id AND EXISTS (SELECT 1 FROM cp WHERE cp.project_id = c.project_id AND c.class_id IN (cp.a, cp.b)))
        SELECT * FROM lk WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.project_id = lk.project_id AND l.x = least(source_id, target_id) AND l.y = greatest(source_id, target_id))""",
    "join_10_classes": f"SELECT project_id, id, min(id) OVER (PARTITION BY project_id, list_sort(list_distinct({q.title_tokens('what')}))) AS class_id FROM memories WHERE deleted_at IS NULL",
}
