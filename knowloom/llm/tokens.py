"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary in rank form; every executor reads it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file with their ranks, read once in a worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, loaded once in a worker; special tokens in a text are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("knowloom", pat_str=SPLIT, mergeable_ranks=vocabulary_ranks(path), special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sized(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, n_tokens) of documents with a doc_id."""
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", *keep, token_count(F.col("text"), path).alias("n_tokens"))
