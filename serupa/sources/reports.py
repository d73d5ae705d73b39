"""Labelled pairs in, evaluation reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa import schemas
from serupa.sources.builtin_pairs import PAIRS


def builtin_pairs(spark: SparkSession) -> DataFrame:
    rows = [(no, a, b, label) for no, (a, b, label) in enumerate(PAIRS, 1)]
    return spark.createDataFrame(rows, schemas.PAIR)


def read_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled pairs of one JSON array, numbered by their place in it.

    With ``lines`` any number of JSON Lines files, whose pairs must carry their number ``no``: lines have no order in Spark.
    """
    if lines:
        return spark.read.schema(schemas.PAIR).json(path)
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.from_json("value", T.ArrayType(schemas.PAIR))).alias("place", "pair"))
    return pairs.select((F.col("place") + 1).cast("bigint").alias("no"), "pair.judul_a", "pair.judul_b", "pair.label")


def write_metrics(path: str, pairs: int, target: DataFrame, best: DataFrame, swept: DataFrame,
                  predictions: DataFrame, model: str, target_threshold: float) -> None:
    """Report folders: ``summary`` (one JSON document), ``threshold_sweep`` and ``predictions`` (CSV with header)."""
    spark = swept.sparkSession
    row = lambda df: F.struct(*[df[c] for c in schemas.METRIC_COLUMNS])
    one = lambda df: df.select(row(df).alias("m")).scalar()
    sweep = swept.select(F.array_sort(F.collect_list(F.struct(*schemas.METRIC_COLUMNS)))).scalar()
    meta = F.struct(
        F.current_timestamp().alias("timestamp"), F.lit(pairs).alias("total_pairs"),
        F.lit(target_threshold).alias("target_threshold"),
        best.select("threshold").scalar().alias("best_threshold"), F.lit(model).alias("model_name"),
    )
    summary = spark.range(1).select(
        meta.alias("meta"), one(target).alias("target_threshold_metrics"),
        one(best).alias("best_threshold_metrics"), sweep.alias("metrics_by_threshold"),
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    ordered = swept.select(*schemas.METRIC_COLUMNS).coalesce(1).sortWithinPartitions("threshold")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/threshold_sweep")
    # Sorted by number across files; the detail rows stay out of the single JSON document.
    detail = predictions.select(*schemas.PREDICTION_COLUMNS).repartitionByRange("no").sortWithinPartitions("no")
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    detail.write.mode("overwrite").options(**exact).csv(f"{path}/predictions")
