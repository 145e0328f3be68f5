"""Reading level of each document.

Smoothed unigram language models, one for each level and language, trained on the readers' labels; a document gets the
level of the highest posterior. Besides words the models count two kinds of shape tokens, the length
class of each sentence and of each word, which carry over to words the labels never showed. Words are hashed to a fixed
number of buckets, so that no word is left out and the model has a bound. Languages are learned as well, from what the labelled
documents declare; a wrong declaration is outvoted by the words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.runtime import cut, release

LEVELS = (1, 2, 3, 4, 5)
#: Bound of the training: labelled documents used (by hash order of doc_id beyond it).
MOST_LABELLED = 20_000
#: Buckets that words are hashed to, a power of two: the bound of a model's entries for a language.
WORD_BUCKETS = 1 << 18
#: Texts below this many characters get no level.
LEAST_CHARS = 400
#: Pseudo-counts of the smoothing: words towards their language, shapes towards their level in all languages, words towards all languages.
WORD_PRIOR, SHAPE_PRIOR, LANGUAGE_PRIOR = 2000.0, 200.0, 500.0
#: A language needs this share of the labelled documents to have a model of its own; others, and none, are the rest.
LEAST_SHARE, REST = 0.005, "other"

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?]+\s|\n")
#: Token ids: word buckets, then word lengths up to 20, then sentence-length classes up to 12.
_LENGTHS, _CLASSES = WORD_BUCKETS, WORD_BUCKETS + 21
TOKENS = _CLASSES + 13


class _Buckets(dict):
    """The buckets of the words a worker met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) % WORD_BUCKETS
        return found


bucket = _Buckets().__getitem__


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, their counts) of a text: its words in lower case, the lengths of its words, and the length classes of its sentences. An id may come twice."""
    words = Counter(_WORD.findall(text.lower()))
    ids, n = np.fromiter(map(bucket, words), np.int64, len(words)), np.fromiter(words.values(), np.float64, len(words))
    lengths = np.bincount(np.minimum(20, np.fromiter(map(len, words), np.int64, len(words))), n, 21)
    sizes = np.fromiter((len(s.split()) for s in _SENTENCE.split(text)), np.float64)
    classes = np.bincount(np.minimum(12, (2 * np.log2(1 + sizes)).astype(np.int64)), minlength=13).astype(np.float64)
    classes[0] = 0
    some, kinds = np.flatnonzero(lengths), np.flatnonzero(classes)
    return np.concatenate([ids, some + _LENGTHS, kinds + _CLASSES]), np.concatenate([n, lengths[some], classes[kinds]])


class LanguageModel:
    """Which of the declared languages the words of a text speak for. A matrix of log-rates, token by language."""

    def __init__(self, counts: list[tuple[str, int, float]]) -> None:
        self.names = sorted({g for g, _, _ in counts})
        seen = np.zeros((TOKENS, len(self.names)))
        np.add.at(seen, ([t for _, t, _ in counts], [self.names.index(g) for g, _, _ in counts]), [n for _, _, n in counts])
        pooled = seen.sum(1, keepdims=True)
        rates = (seen + LANGUAGE_PRIOR * pooled / (pooled.sum() or 1.0)) / (seen.sum(0) + LANGUAGE_PRIOR)
        self.logs = np.log(np.where(pooled > 0, rates, 1.0)).astype(np.float32)

    def guess(self, ids: np.ndarray, n: np.ndarray) -> str:
        if not self.names:
            return REST
        rows = self.logs[ids]
        return self.names[int(np.argmax(np.log1p(n) @ rows))] if rows.any() else REST


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, level, weight): one vote for each rater of a document, together worth 1. Nulls, repeats and levels outside 1 to 5 are left out."""
    votes = labels.where(F.col("level").isin(*LEVELS)).dropna(subset=["doc_id"]).select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), "level").distinct()
    by_level = votes.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    bounded = by_level.groupBy("doc_id").agg(F.sum("n").alias("all")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    return by_level.join(F.broadcast(bounded), "doc_id").select("doc_id", "level", (F.col("n") / F.col("all")).alias("weight"))


def declared_language(documents: DataFrame) -> Column:
    """The first two letters of what a document declares as its language, null where there is nothing."""
    if "lang" not in documents.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit(""))


def language_model(texts: DataFrame) -> LanguageModel:
    """The model of the languages that ``texts`` (text, lang) declare. At most WORD_BUCKETS rows for each of at most 1 / LEAST_SHARE languages come to the driver."""
    share = F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    common = [r["lang"] for r in texts.groupBy("lang").agg(share.alias("share")).where((F.col("share") >= LEAST_SHARE) & F.col("lang").isNotNull()).collect()]
    if not common:
        return LanguageModel([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(WORD_BUCKETS))
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                ids, n = features(text)
                word = ids < WORD_BUCKETS
                np.add.at(sums[lang], ids[word], np.log1p(n[word]))
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "token", "n"])

    rows = texts.where(F.col("lang").isin(common)).select("text", "lang").mapInArrow(run, "lang string, token int, n double").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    return LanguageModel(sorted((r["lang"], r["token"], r["n"]) for r in rows.collect()))


def training_counts(texts: DataFrame, languages: LanguageModel) -> DataFrame:
    """(lang, level, token, n): weighted token counts of the labelled ``texts`` (text, level, weight), and under token -1 their number."""
    told = texts.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = defaultdict(lambda: np.zeros(TOKENS + 1))
        for b in batches:
            for text, level, weight in zip(b.column("text").to_pylist(), b.column("level").to_pylist(), b.column("weight").to_pylist()):
                ids, n = features(text)
                into = sums[told.value.guess(ids, n), level]
                np.add.at(into, ids, n * weight)
                into[TOKENS] += weight
        for (lang, level), counts in sums.items():
            some = np.flatnonzero(counts)
            tokens = np.where(some == TOKENS, -1, some).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([level] * len(some), pa.int32()), pa.array(tokens), pa.array(counts[some])], ["lang", "level", "token", "n"])

    return texts.select("text", "level", "weight").mapInArrow(run, "lang string, level int, token int, n double").groupBy("lang", "level", "token").agg(F.sum("n").alias("n"))


class LevelModel:
    """Log-likelihoods of tokens by language and level: a matrix for each language, zero where a word was never seen."""

    def __init__(self, counts: list[tuple[str, int, int, float]], languages: LanguageModel | None = None) -> None:
        self.languages = languages or LanguageModel([])
        by: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((TOKENS, 5)))
        prior: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(5))
        for lang, level, token, n in counts:
            (prior[lang] if token < 0 else by[lang][token])[level - 1] += n
        shapes = [slice(_LENGTHS, _CLASSES), slice(_CLASSES, TOKENS)]
        pooled = sum(by.values(), np.zeros((TOKENS, 5)))
        self.shapes = np.zeros((TOKENS, 5), np.float32)
        base = {kind.start: self._level_rates(pooled[kind]) for kind in shapes}
        for kind in shapes:
            self.shapes[kind] = np.log(base[kind.start])
        self.prior = {g: np.log(p + 1.0) for g, p in prior.items()}
        self.any_prior = np.log(sum(prior.values(), np.zeros(5)) + 1.0)
        self.tokens: dict[str, np.ndarray] = {}
        for g, seen in by.items():
            out = np.zeros((TOKENS, 5), np.float32)
            words = seen[:WORD_BUCKETS]
            some, total = words.sum(1) > 0, words.sum(0)
            share = (total.sum() + 0.5 * some.sum()) or 1.0
            out[:WORD_BUCKETS][some] = np.log((words[some] + WORD_PRIOR * (words[some].sum(1, keepdims=True) + 0.5) / share) / (total + WORD_PRIOR))
            for kind in shapes:
                out[kind] = np.log((seen[kind] + SHAPE_PRIOR * base[kind.start]) / (seen[kind].sum(0) + SHAPE_PRIOR))
            self.tokens[g] = out

    @staticmethod
    def _level_rates(shapes: np.ndarray) -> np.ndarray:
        mean = (shapes.sum(1, keepdims=True) + 0.5) / (shapes.sum() + 0.5 * len(shapes))
        return (shapes + 50.0 * mean) / (shapes.sum(0) + 50.0)

    def level(self, text: str) -> int:
        """The level of the highest posterior; of equal ones the easiest. A language without labels is judged by shapes alone."""
        ids, n = features(text)
        lang = self.languages.guess(ids, n)
        score = self.prior.get(lang, self.any_prior) + n @ self.tokens.get(lang, self.shapes)[ids]
        return int(np.argmax(score)) + 1


def train(documents: DataFrame, labels: DataFrame) -> LevelModel:
    """The model of the labelled documents; without labels every text gets level 1, the first of equal posteriors."""
    votes = F.broadcast(labelled(labels))  # at most a row for each level of MOST_LABELLED documents
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", declared_language(documents).alias("lang")).join(votes, "doc_id")
    texts = cut(texts.select("doc_id", "text", "lang", F.col("level").cast("int").alias("level"), "weight"), "labelled")
    languages = language_model(texts.dropDuplicates(["doc_id"]))
    counts = training_counts(texts, languages)
    rows = [(r["lang"], r["level"], r["token"], r["n"]) for r in counts.collect()]  # buckets and shapes by level and language
    release(texts)
    return LevelModel(sorted(rows), languages)


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level) for every document of at least LEAST_CHARS characters, counted in the text, read whole.

    Labels: (doc_id, rater, level). Null and shorter texts and null doc_ids have no row; labels of unknown documents
    are ignored; repeated documents give repeated rows. What is broadcast is the model, bounded by WORD_BUCKETS.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels = [model.value.level(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(levels, pa.int32())], ["doc_id", "level"])

    long = documents.where((F.length("text") >= LEAST_CHARS) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return long.mapInArrow(run, "doc_id bigint, level int")


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, level, n_docs, n_chars): how demanding each source is."""
    return levels.join(documents.select("doc_id", "source", F.length("text").alias("n")), "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))
