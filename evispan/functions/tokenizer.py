"""Token costs by a published tokenizer file, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_cost(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer.json at path, which every executor must see; null costs 0. A worker loads it once."""

    @F.pandas_udf("long")
    def cost(texts: pd.Series) -> pd.Series:
        encoded = _load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in encoded])

    return cost(text)


def surrogate_cost(text: Column) -> Column:
    """A quarter of the characters, at least 1: exact in every engine, and no tokenizer."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
