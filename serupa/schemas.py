"""Declared table schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def schema_of(columns: str) -> T.StructType:
    """Schema from ``name TYPE`` items; unlike a DDL string it needs no session."""
    pairs = [item.split() for item in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Raw ingest: ids arrive as number or text, so they are read as text.
RAW_DOC = schema_of(
    "document_id STRING, document_type STRING, type STRING, skripsi_id STRING, laravel_id STRING, "
    "judul STRING, abstrak STRING, kata_kunci STRING, tahun INT, program_studi STRING, nim STRING, "
    "nama_mahasiswa STRING, bobot_judul DOUBLE, bobot_abstrak DOUBLE, bobot_kata_kunci DOUBLE"
)
EXPORT_RECORD = schema_of(
    "skripsi_id STRING, judul STRING, abstrak STRING, kata_kunci STRING, tahun INT, "
    "program_studi STRING, nim STRING, nama_mahasiswa STRING"
)
DOC = schema_of(
    "document_id STRING, document_type STRING, skripsi_id BIGINT, judul STRING, abstrak STRING, "
    "kata_kunci STRING, tahun INT, program_studi STRING, nim STRING, nama_mahasiswa STRING, "
    "bobot_judul DOUBLE, bobot_abstrak DOUBLE, bobot_kata_kunci DOUBLE"
)
METADATA = ["document_id", "document_type", "skripsi_id", "tahun", "program_studi", "judul"]
INDEX = schema_of(
    "id STRING, embedding ARRAY<FLOAT>, document STRING, document_id STRING, document_type STRING, "
    "skripsi_id BIGINT, tahun INT, program_studi STRING, judul STRING"
)
QUERY = schema_of("query_id BIGINT, judul STRING, top_k INT, threshold DOUBLE, document_type STRING")
HIT_COLUMNS = [
    "query_id", "id", "document_id", "document_type", "skripsi_id",
    "similarity_score", "similarity_persen", "level",
]
PAIR = schema_of("no BIGINT, judul_a STRING, judul_b STRING, label INT")
PREDICTION_COLUMNS = ["no", "judul_a", "judul_b", "label", "score", "semantic_score", "lexical_score", "level"]
METRIC_COLUMNS = ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]
JOB = schema_of(
    "job_id STRING, status STRING, total_received BIGINT, total_processed BIGINT, rejected BIGINT, error_message STRING, "
    "created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"
)
