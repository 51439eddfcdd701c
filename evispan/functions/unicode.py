"""Unicode normal forms, which have no built-in expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("string")
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def normal_source(text: Column) -> Column:
    """NFKC, case folded, spaces collapsed; ASCII text takes the built-in way."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))).otherwise(_nfkc(text))
