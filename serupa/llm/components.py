"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serupa.operators.skew import join_unique
from serupa.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Join neighbours to the smallest node around: larger neighbours, or the node itself and the smaller ones."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    least = stage(least, "least")
    moved = join_unique(around, least, "a", "n")  # the node in the middle of a large component is hot
    if large:
        made = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of ``links`` (a long, b long) but the roots.

    Large and small stars in turn, until nothing changes: about log(nodes) rounds. Each star is written to the
    shared folder. A node with a large share of all links is broadcast instead of gathering them in one task.
    Links of a node to itself, repeated and reversed links are allowed; an empty table gives none.
    """
    now = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(now)
    while True:
        now = stage(_star(stage(_star(now, True), "stars"), False), "links")
        before, seen = seen, state(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
