"""Repair of UTF-8 text that was decoded as Windows-1252: needs Python's codecs, so flagged rows only go through Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.text import has_mojibake


def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.encode("cp1252", errors="ignore").decode("utf-8", errors="ignore"))


def fix_mojibake(df: DataFrame, *columns: str) -> DataFrame:
    """Repairs flagged texts and strips byte order marks from all, in one scan; only flagged texts are sent to Python."""
    repaired = F.pandas_udf(_repair, "string")
    flagged = {c: has_mojibake(F.col(c)) for c in columns}
    fixed = {c: F.when(f, repaired(F.when(f, F.col(c)))).otherwise(F.col(c)) for c, f in flagged.items()}
    return df.withColumns({c: F.replace(x, F.lit("\ufeff"), F.lit("")) for c, x in fixed.items()})
