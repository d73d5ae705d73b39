"""Vector aggregation over groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(vectors: DataFrame, group: str, vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """``group, pos, value``: mean per dimension over the rows whose mask is set.

    Aggregated per (group, dimension) with map-side partial sums, so a huge group is no single task.
    A group whose mask is nowhere set has the zero vector.
    """
    on = F.col(mask).cast("double") if mask else F.lit(1.0)
    cells = vectors.select(group, on.alias("_on"), F.posexplode(F.col(vector)).alias("pos", "x"))
    total = F.sum(F.col("x").cast("double") * F.col("_on")) / F.greatest(F.sum("_on"), F.lit(1e-9))
    return cells.groupBy(group, "pos").agg(total.alias("value"))


def to_vectors(cells: DataFrame, group: str) -> DataFrame:
    """Rows ``group, pos, value`` back to one array per group (as long as the vectors are wide)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    values = F.transform(ordered, lambda cell: cell["value"]).cast("array<float>")
    return cells.groupBy(group).agg(values.alias("embedding"))
