"""Document exports and ingest payloads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa import schemas
from serupa.functions.text import strip
from serupa.sources.json_array import NOT_AN_ARRAY, read_json_array

_PAYLOAD = T.StructType(
    [T.StructField("data", T.ArrayType(schemas.DOC)), T.StructField("reset_index", T.BooleanType())]
)


def read_export(spark: SparkSession, path: str, lines: bool = False, whole_files: bool = False) -> DataFrame:
    """Records of a document export.

    ``lines=False`` reads files that hold one JSON array each, by byte ranges; JSON Lines (``lines=True``) are
    read in one pass and need nothing staged. ``whole_files=True`` reads each array in one task: much less work,
    for files that a task can hold.
    """
    if lines:
        return spark.read.schema(schemas.EXPORT_RECORD).json(path)
    if not whole_files:
        return read_json_array(spark, path, schemas.EXPORT_RECORD)
    first = spark.read.text(path).select(strip(F.col("value")).alias("v")).where("v <> ''").first()
    if first is None or not first.v.startswith("["):
        raise ValueError(NOT_AN_ARRAY)
    return spark.read.schema(schemas.EXPORT_RECORD).option("multiLine", True).json(path)


def to_payloads(docs: DataFrame, group: Column, reset_index: bool = False, order: Column | None = None) -> DataFrame:
    """``batch, payload``: documents of a bounded group as one ingest payload, in ``order`` (default: their ids)."""
    item = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DOC.fields])
    place = (F.col("document_id") if order is None else order).alias("place")
    rows = docs.select(group.alias("batch"), F.struct(place, item.alias("item")).alias("placed"))
    body = F.struct(F.col("data"), F.lit(reset_index).alias("reset_index"))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list("placed")), lambda p: p["item"]).alias("data")).select(
        "batch", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")
    )


def from_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Documents, their ``position`` in the payload and ``reset_index``; a bare list is the old form and never resets."""
    text = F.col(column)
    whole = F.when(text.rlike(r"^\s*\["), F.concat(F.lit('{"data":'), text, F.lit("}"))).otherwise(text)
    others = [c for c in payloads.columns if c != column]
    # One generated row per payload keeps the parsed body from being parsed again per field.
    bodies = payloads.select(*others, F.inline(F.array(F.from_json(whole, _PAYLOAD))))
    rows = bodies.select(*others, F.coalesce("reset_index", F.lit(False)).alias("reset_index"), F.posexplode("data").alias("position", "item"))
    return rows.select(*others, "reset_index", "position", "item.*")
