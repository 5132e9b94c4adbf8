"""Text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, no marks, single spaces. ASCII texts stay in the JVM."""
    low = F.lower(text)
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), _strip_accents(low)).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
