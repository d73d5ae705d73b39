"""Shapes the engine works on, derived from whole tables; ``oracle.py`` states the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.operators.encode import HashEncoder
from serupa.session import read_table

ENCODER = HashEncoder(256)


def doc_type(number: str):
    return F.when(F.col(number) % 3 == 0, "internship_report").otherwise("skripsi")


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as titles-only documents: the whole text is the title."""
    none = F.lit(None)
    return read_table(spark, folder, "documents").select(
        F.concat_ws("_", doc_type("doc_id"), "doc_id").alias("document_id"),
        doc_type("doc_id").alias("document_type"),
        F.col("doc_id").alias("skripsi_id"),
        F.col("text").alias("judul"),
        none.cast("string").alias("abstrak"),
        none.cast("string").alias("kata_kunci"),
        F.when(F.col("doc_id") % 7 != 0, 1990 + F.col("doc_id") % 35).cast("int").alias("tahun"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("program_studi"),
        *[none.cast("double").alias(b) for b in ("bobot_judul", "bobot_abstrak", "bobot_kata_kunci")],
    )


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("item_id")
    return read_table(spark, folder, "benchmark").select(
        n.alias("query_id"),
        F.col("text").alias("judul"),
        (1 + n % 20).cast("int").alias("top_k"),
        (F.lit(0.35) + (n % 4) * 0.05).alias("threshold"),
        F.when(n % 3 == 1, "skripsi").when(n % 3 == 2, "internship_report").alias("document_type"),
    )


def page_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` as documents with title, article text as abstract and link names as keywords."""
    html, n = F.col("html"), F.col("page_id")
    article = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    weight = lambda m, s: F.when(n % m == s, (n % 5 - 1).cast("double"))
    return read_table(spark, folder, "pages").select(
        F.concat_ws("_", doc_type("page_id"), "page_id").alias("document_id"),
        doc_type("page_id").alias("document_type"),
        F.when(n % 3 != 0, n).alias("skripsi_id"),
        F.regexp_extract(html, "<title>(.*?)</title>", 1).alias("judul"),
        F.regexp_replace(article, "<[^>]*>", " ").alias("abstrak"),
        F.array_join(F.regexp_extract_all(html, F.lit('<a href="/([^"]*)">'), F.lit(1)), ", ").alias("kata_kunci"),
        F.when(n % 7 != 0, 1990 + n % 35).cast("int").alias("tahun"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("program_studi"),
        weight(4, 1).alias("bobot_judul"),
        weight(4, 2).alias("bobot_abstrak"),
        weight(4, 3).alias("bobot_kata_kunci"),
    )


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation turn with the next one of its conversation; an equi-join on unique keys."""
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("judul_b"))
    return turns.withColumnRenamed("text", "judul_a").join(after, ["conv_id", "turn"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        "vec_id",
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        "embedding",
        F.col("label").cast("string").alias("document_type"),
    )


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as document changes: an error deletes the user's document, anything else saves it."""
    return read_table(spark, folder, "events").select(*_change_columns())


def _change_columns() -> list:
    return [
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("user_id").cast("string").alias("skripsi_id"),
        F.concat(F.lit("skripsi_"), F.col("user_id").cast("string")).alias("document_id"),
        F.concat_ws(" ", "event_type", "props").alias("judul"),
        (2000 + F.col("event_id") % 25).cast("int").alias("tahun"),
        F.col("event_type").alias("program_studi"),
        F.col("ts").cast("timestamp").alias("event_time"),
    ]


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return feed.select(*_change_columns())


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/benchmark.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(folder)
    n = F.col("item_id")
    return feed.select(
        n.alias("query_id"), F.col("text").alias("judul"), (1 + n % 20).cast("int").alias("top_k"),
        (F.lit(0.35) + (n % 4) * 0.05).alias("threshold"),
        F.when(n % 3 == 1, "skripsi").when(n % 3 == 2, "internship_report").alias("document_type"),
    )
