import random

import numpy as np

from knowloom.llm.reading import WORD_BUCKETS, LanguageModel, LevelModel, bucket, features, labelled, level_profile, reading_levels, train

DOCS = "doc_id bigint, text string, source string"
LABELS = "doc_id bigint, rater string, level int"


def _text(level, rnd, lang="en"):
    easy = {"en": "the cat sat on a mat and ran to the red box".split(), "de": "die katze und der hund sind im haus mit dem ball".split()}[lang]
    hard = [f"{p}{s}" for p in ("inter", "extra", "hyper", "proto") for s in ("operability", "polation", "normalization", "configuration")]
    words = [rnd.choice(hard if rnd.random() < level / 8 else easy) for _ in range(120)]
    step = 4 + 3 * level
    return ". ".join(" ".join(words[i : i + step]).capitalize() for i in range(0, 120, step)) + "."


def _corpus(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, _text(lv := rnd.randint(1, 5), rnd, rnd.choice(["en", "en", "de"])), f"s{i % 3}", lv) for i in range(n)]


def test_held_out_accuracy(spark):
    docs = _corpus()
    rnd = random.Random(9)
    labels = [(i, "a", min(5, max(1, lv + rnd.choice([0] * 9 + [1])))) for i, _, _, lv in docs[:200]] + [(i, "b", lv) for i, _, _, lv in docs[:60]]
    df = spark.createDataFrame([d[:3] for d in docs], DOCS)
    got = {r.doc_id: r.level for r in reading_levels(df, spark.createDataFrame(labels + labels[:20], LABELS)).collect()}
    assert set(got) == {i for i, t, _, _ in docs if len(t) >= 400}
    held = [(got[i], lv) for i, _, _, lv in docs[200:] if i in got]
    assert sum(a == b for a, b in held) / len(held) >= 0.75 and all(abs(a - b) <= 1 for a, b in held)
    profile = level_profile(spark.createDataFrame(list(got.items()), "doc_id bigint, level int"), df)
    assert sum(r.n_docs for r in profile.collect()) == len(got)


def test_short_null_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "x" * 399, "s"), (2, "word " * 80, "s"), (3, None, "s"), (None, "word " * 100, "s"), (4, "é" * 400, None), (5, " " * 500, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, reading_levels(df, none).collect())) == [(2, 1), (4, 1), (5, 1)]
    assert reading_levels(df.where("false"), none).count() == 0


def test_votes_share_one_weight_and_bad_labels_are_dropped(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "b", 3), (2, None, 4), (3, "a", 9), (None, "a", 1), (4, "a", None)]
    got = {(r.doc_id, r.level): r.weight for r in labelled(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.5, (2, 4): 1.0}


def _words(text):
    ids, n = features(text)
    return [(int(i), float(x)) for i, x in zip(ids, n) if i < WORD_BUCKETS]


def test_features_and_languages():
    ids, n = features("Die Katze und der Hund. Der Hund ist da!\nJa")
    c = dict(zip(ids.tolist(), n.tolist()))
    assert c[bucket("hund")] == 2 and c[WORD_BUCKETS + 3] == 5 and sum(x for t, x in c.items() if t >= WORD_BUCKETS + 21) == 3
    told = [("de", "die katze und der hund"), ("de", "der tag und die nacht"), ("en", "the cat and the dog"), ("en", "a day and the night"), ("en", "der hund und die katze")] * 3
    m = LanguageModel([(g, t, x) for g, text in told for t, x in _words(text)])
    assert m.guess(*features("die nacht und der tag")) == "de" and m.guess(*features("the night and a cat")) == "en"
    assert m.guess(*features("xyz qqq")) == "other" and LanguageModel([]).guess(*features("der tag")) == "other" and len(features("")[0]) == 0


def test_languages_are_learned_from_what_documents_declare(spark):
    docs = _corpus(200, seed=4)
    lang = lambda i, t: None if i % 7 == 0 else ("DE-de" if "katze" in t.lower() or "hund" in t.lower() else " en") if i % 11 else "en"
    df = spark.createDataFrame([(i, t, s, lang(i, t)) for i, t, s, _ in docs], DOCS + ", lang string")
    m = train(df, spark.createDataFrame([(i, "a", lv) for i, _, _, lv in docs], LABELS))
    assert m.languages.names == ["de", "en"] and set(m.tokens) <= {"de", "en", "other"}
    german = [t for _, t, _, _ in docs if "katze" in t.lower() and "hund" in t.lower()]
    assert sum(m.languages.guess(*features(t)) == "de" for t in german) >= 0.95 * len(german)


def test_rates_are_distributions():
    a, b, short, long = 5, 9, WORD_BUCKETS + 1, WORD_BUCKETS + 3
    counts = [("en", lv, t, float(n)) for lv in (1, 2, 3) for t, n in ((a, 5 * lv), (b, 3), (short, 8), (long, lv))] + [("en", 1, -1, 2.0)]
    m = LevelModel(counts)
    assert np.allclose(np.exp(m.tokens["en"][[a, b]]).sum(0), 1, atol=1e-3) and np.allclose(np.exp(m.tokens["en"][WORD_BUCKETS : WORD_BUCKETS + 21]).sum(0), 1, atol=1e-3)
    assert not m.tokens["en"][7].any()  # a word that was never seen says nothing


def test_training_covers_whole_texts(spark):
    docs = spark.createDataFrame([(1, "easy " * 20_000 + "rare", "s"), (2, "hard " * 20_000 + "last", "s")], DOCS)
    model = train(docs, spark.createDataFrame([(1, "a", 1), (2, "a", 5)], LABELS))
    assert model.tokens["other"][bucket("rare")].any() and model.tokens["other"][bucket("last")].any()
