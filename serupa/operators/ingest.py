"""Document and query intake: id resolution, validation with quarantine, metadata, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serupa import schemas
from serupa.config import DEFAULTS, Settings


def _text(name: str) -> Column:
    """A text field; empty counts as missing."""
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def _source_id(name: str) -> Column:
    """A source id as text; empty and zero count as missing."""
    return F.nullif(_text(name), F.lit("0"))


def with_columns(df: DataFrame, schema) -> DataFrame:
    """Add the schema's missing columns as null and bring the others to its types."""
    have = set(df.columns)
    extra = [c for c in df.columns if c not in schema.names]
    typed = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return df.select(*typed, *extra)


def normalize_ids(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Resolve ``document_type``, ``skripsi_id`` and ``document_id`` of raw documents.

    ``id_error`` is null for a good row. Extra columns pass through.
    """
    raw = with_columns(raw, schemas.RAW_DOC)
    kind = F.coalesce(_text("document_type"), _text("type"), F.lit(settings.default_type))
    source = F.coalesce(_source_id("skripsi_id"), _source_id("laravel_id"))
    given = _text("document_id")
    tail = F.element_at(F.split(given, "_"), -1)
    derived = F.when(given.contains("_") & tail.rlike("^[0-9]+$"), tail.try_cast("bigint"))
    step = raw.withColumns({"_type": kind, "_source": source})
    number = F.col("_source").try_cast("bigint")
    return step.withColumns(
        {
            "id_error": F.when(F.col("_source").isNotNull() & number.isNull(), "source_id_not_integer").when(
                F.col("_source").isNull() & given.isNull(), "id_missing"
            ),
            "skripsi_id": F.when(F.col("_source").isNotNull(), number).otherwise(derived),
            "document_id": F.coalesce(given, F.concat("_type", F.lit("_"), "_source")),
            "document_type": F.col("_type"),
        }
    ).drop("_type", "_source", "type", "laravel_id")


def _errors(checks: dict[str, Column]) -> Column:
    codes = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()])
    return F.filter(codes, lambda code: code.isNotNull())


def check_documents(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``errors``, the codes of all broken bounds of a document; empty for a valid one."""
    title, year = F.col("judul"), F.col("tahun")
    checks = {
        "judul_missing": title.isNull(),
        "judul_too_short": F.length(title) < settings.title_min_chars,
        "judul_too_long": F.length(title) > settings.title_max_chars,
        "tahun_too_small": year < settings.year_min,
        "tahun_too_large": year > settings.year_max,
        "bobot_judul_negative": F.col("bobot_judul") < 0,
        "bobot_abstrak_negative": F.col("bobot_abstrak") < 0,
        "bobot_kata_kunci_negative": F.col("bobot_kata_kunci") < 0,
    }
    errors = _errors(checks)
    if "id_error" in docs.columns:
        errors = F.concat(F.array_compact(F.array("id_error")), errors)
    return docs.withColumn("errors", errors)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows (with their ``errors``) of a checked table."""
    good = F.size("errors") == 0
    return checked.where(good).drop("errors", "id_error"), checked.where(~good)


def ingest(raw: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    return split_valid(check_documents(normalize_ids(raw, settings), settings))


def check_queries(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fill defaults of similarity queries and add ``errors``."""
    queries = with_columns(queries, schemas.QUERY)
    filled = queries.withColumns(
        {
            "top_k": F.coalesce("top_k", F.lit(settings.top_k_default)),
            "threshold": F.coalesce("threshold", F.lit(settings.threshold_default)),
        }
    )
    checks = {
        "judul_missing": F.col("judul").isNull(),
        "judul_too_short": F.length("judul") < settings.title_min_chars,
        "top_k_out_of_range": ~F.col("top_k").between(1, settings.top_k_max),
        "threshold_out_of_range": ~F.col("threshold").between(0.0, 1.0),
    }
    return filled.withColumn("errors", _errors(checks))


def metadata(docs: DataFrame, settings: Settings = DEFAULTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The six metadata columns kept in the index; a missing year is 0, a missing programme is named so.

    ``carry`` names further columns to keep.
    """
    return docs.select(
        "document_id",
        "document_type",
        "skripsi_id",
        F.coalesce("tahun", F.lit(0)).alias("tahun"),
        F.coalesce(_text("program_studi"), F.lit(settings.unknown_program)).alias("program_studi"),
        "judul",
        *carry,
    )


def export_documents(records: DataFrame) -> DataFrame:
    """Records of a document export that carry a source id, with the fields that are sent on."""
    kept = records.where(_source_id("skripsi_id").isNotNull())
    return kept.select(*[F.col(name) for name in schemas.EXPORT_RECORD.names])


def export_counters(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``received``, ``skipped`` (no source id), ``sent`` and ``failed`` (quarantined) record counts."""
    checked = check_documents(normalize_ids(records, settings), settings)
    skipped = F.col("id_error") == "id_missing"
    state = F.when(skipped, "skipped").when(F.size("errors") > 0, "failed").otherwise("sent")
    labels = F.explode(F.array(F.lit("received"), state)).alias("counter")
    return checked.select(labels).groupBy("counter").agg(F.count("*").alias("n"))


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key; the partial limit before the shuffle keeps a hot key small."""
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


def delete_key(key: Column, settings: Settings = DEFAULTS) -> Column:
    """An all-digit key means a document of the default type."""
    return F.when(key.rlike("^[0-9]+$"), F.concat(F.lit(f"{settings.default_type}_"), key)).otherwise(key)
