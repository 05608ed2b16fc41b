"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    """The byte-level BPE of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text as bigint; 0 for a null or empty one. Whole texts are encoded, in Arrow batches."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def sized(documents: DataFrame, doc_id: str, text: str, path: str = VOCABULARY, **more: Column) -> DataFrame:
    """(doc_id, tokens, more...): one pass over the texts, in the tasks that read them; ``path`` must exist on every worker."""
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *(c.alias(n) for n, c in more.items())).select("doc_id", *more, token_count("__text", path).alias("tokens"))
