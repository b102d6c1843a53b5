"""Sizes in tokens of a public tokenizer, as an Arrow-batched UDF."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def default_tokenizer() -> str:
    """The path of the public byte-level BPE ranks; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens in the whole text; null and empty texts have 0."""
    at = path or default_tokenizer()

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        enc = _encoding(at)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0).astype("int64")

    return size(text)
