"""Bounded samples of rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows, twice as many at most, drawn by a hash of the columns ``by``; all of a smaller table.

    The hash draws before anything is moved. The limit only binds where many rows hash alike, as copies do.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(_RANGE)) < int(_RANGE * rows / total)).limit(2 * rows)
