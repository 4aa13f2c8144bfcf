"""What query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, for comparison with another engine.

    The nudge takes sums that end in a 5 at the next digit (means of prices do) off the edge, where the order of
    additions would decide.
    """
    return df.select(*[(F.round(F.col(c) + F.lit(float(f"3e-{digits + 4}")), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(cols: str, digits: int = 6) -> str:
    """The DuckDB side of rounded() for a space-separated list of columns."""
    return ", ".join(f"round({c} + 3e-{digits + 4}, {digits}) + 0.0 AS {c}" for c in cols.split())
