import os

import pytest

from knowloom.llm.tokens import VOCABULARY, encoding, sized


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_counts_whole_texts(spark):
    texts = ["", None, "Hello  world", "<|endoftext|>", "é ß\n\n\n x", "ab " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in sized(df).collect()}
    enc = encoding(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[4])) == texts[4]
