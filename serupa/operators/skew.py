"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-4
HOT_BYTES = 64 << 20  # of all hot rows together


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], uses: str, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key and counts the key's rows in ``left``.

    A key used by more than ``HOT_SHARE`` of all rows is hot. At most 1 / HOT_SHARE keys can be; if their
    rows of ``right`` fit ``HOT_BYTES``, they are broadcast, and all other keys, small by definition, are
    shuffled. Else all keys are, and the adaptive skew join splits the large partitions.
    """
    total = right.agg(F.coalesce(F.sum(uses), F.lit(0))).first()[0]
    limit = max(total * HOT_SHARE, 1000.0)
    if total <= limit:  # too few rows for any key to be hot
        return left.join(right.drop(uses), key, how)
    hot = right.where(F.col(uses) > limit)
    if hot.select(uses).isEmpty():
        return left.join(right.drop(uses), key, how)
    size = F.length(F.to_json(F.struct(*hot.columns))).cast("long")  # as text: no less than in memory
    if (hot.agg(F.sum(size)).first()[0] or 0) > HOT_BYTES:
        return left.join(right.drop(uses), key, how)
    cold = right.where(F.col(uses) <= limit).drop(uses)
    on_hot = left.join(F.broadcast(hot.drop(uses)), key, "inner")
    keys = [key] if isinstance(key, str) else key
    others = left.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(cold, key, how)
    return on_hot.unionByName(others)
