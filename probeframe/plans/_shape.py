"""What all plans share: rounding, so that sums in any order compare equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles at ``places`` decimals, never a negative zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(expression: str, name: str = "", places: int = PLACES) -> str:
    """The same in SQL."""
    return f"round({expression}, {places}) + CAST(0 AS DOUBLE) AS {name or expression}"
