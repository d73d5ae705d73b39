"""A training-data pipeline over ``documents``: stages that each apply one operator to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serupa.llm.stages import drop_contaminated, keep_one_of_near_copies, keep_recognised_languages, mask_personal_data, mix_sources
from serupa.session import ship_package, stage

STAGES = [
    ("language ID", keep_recognised_languages),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
]

#: The language model and the field are trained, and SimHash needs XXH64: no SQL for it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stage(docs, f"pipeline{n}")
    return docs
