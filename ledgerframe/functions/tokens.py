"""Token counters by name: each gives a column of counts for a column of texts."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lexical_tokens

#: How byte-pair vocabularies of the common kind split text first; fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def _encoding(ranks: bytes, split: str):
    import tiktoken

    entries = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in entries}, special_tokens={})


def byte_pairs(vocabulary: str, split: str = SPLIT) -> Callable[[Column], Column]:
    """Counts by a file of ``token rank`` lines (tokens in base64).

    The driver reads the file, a few megabytes at most; workers get its bytes with the
    plan, so they need no copy.  No text is a special token.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, split)
        return pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="Int64")

    return lambda text: F.pandas_udf(count, "long")(text)


def token_counter(name: str, split: str = SPLIT) -> Callable[[Column], Column]:
    """``lexical``, or ``byte_pair:<file>``; a null text has no count."""
    if name == "lexical":
        return lambda text: lexical_tokens(text).cast("long")
    kind, _, vocabulary = name.partition(":")
    if kind != "byte_pair" or not vocabulary:
        raise ValueError("token_counter_invalid")
    return byte_pairs(vocabulary, split)
