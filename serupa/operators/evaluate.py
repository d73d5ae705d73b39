"""Prediction quality of scored, labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serupa import schemas
from serupa.config import DEFAULTS, Settings
from serupa.functions.rounding import round4

SWEEP = tuple(round(t / 100, 2) for t in range(40, 96, 5))


def predictions(scored: DataFrame, settings: Settings = DEFAULTS, target: float | None = None) -> DataFrame:
    """Scored pairs with defaults for failed scoring, the predicted label and its status."""
    target = settings.eval_target if target is None else target
    filled = scored.select(
        "no",
        "judul_a",
        "judul_b",
        "label",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("score", "semantic_score", "lexical_score")],
        F.coalesce("level", F.lit("ERROR")).alias("level"),
    )
    predicted = (F.col("score") >= target).cast("int")
    status = F.when(predicted == F.col("label"), "OK").otherwise("SALAH")
    return filled.withColumns({"predicted": predicted, "status": status})


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def metrics(scored: DataFrame, thresholds=SWEEP) -> DataFrame:
    """Confusion counts and quality measures per threshold.

    Rows shrink to one count per (thresholds reached, label) before they meet the thresholds, so the
    pass over the pairs has one small aggregate however many thresholds are asked for.
    """
    points = sorted(thresholds)
    reached = sum(((F.col("score") >= t).cast("int") for t in points), F.lit(0))
    counts = scored.groupBy(reached.alias("reached"), "label").agg(F.count("*").alias("n"))
    nothing = scored.sparkSession.range(1).select(
        F.lit(0).alias("reached"), F.lit(0).alias("label"), F.lit(0).cast("bigint").alias("n")
    )
    counts = counts.unionByName(nothing)  # every threshold has a row, even without pairs
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(points)])
    cells = counts.select("*", F.inline(table))
    hit, true = F.col("reached") > F.col("i"), F.col("label") == 1
    tally = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    confusion = cells.groupBy("threshold").agg(
        tally(hit & true).alias("tp"),
        tally(hit & ~true).alias("fp"),
        tally(~hit & true).alias("fn"),
        tally(~hit & ~true).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    raw = confusion.withColumns({"_p": _share(tp, tp + fp), "_r": _share(tp, tp + fn)})
    p, r = F.col("_p"), F.col("_r")
    return raw.select(
        "threshold", "tp", "fp", "fn", "tn",
        round4(p).alias("precision"),
        round4(r).alias("recall"),
        round4(F.coalesce(p * 2.0 * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))).alias("f1"),
        round4(_share(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
    )


def target_metrics(scored: DataFrame, settings: Settings = DEFAULTS, target: float | None = None) -> DataFrame:
    return metrics(scored, [settings.eval_target if target is None else target])


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row with the highest F1; the lowest threshold among equals."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1).select(*schemas.METRIC_COLUMNS)
