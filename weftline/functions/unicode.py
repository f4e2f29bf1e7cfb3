"""Full Unicode folding, which needs Python; Arrow batches keep it off the row-at-a-time path."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: str | None) -> str | None:
    """Compatibility forms and combining marks off, other signs to blanks, squeezed, lower case."""
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in plain).lower().split())


def fold_unicode(text: Column) -> Column:
    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(fold)

    return folded(text)
