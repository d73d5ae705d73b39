"""``QUERIES``: name to callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa import schemas
from serupa.catalog import inputs as src
from serupa.catalog.inputs import ENCODER
from serupa.config import DEFAULTS
from serupa.functions import scoring, vectors
from serupa.functions import text as tx
from serupa.functions.rounding import round4, snap
from serupa.functions.weights import resolve_weights
from serupa.operators import corpus, evaluate, ledger
from serupa.operators import index as ix
from serupa.operators import ingest as ing
from serupa.operators.cells import topk_cosine_cells
from serupa.operators.encode import PandasEncoder, encode_documents, encode_texts
from serupa.operators.index import IndexTable, index_rows, last_documents
from serupa.operators.pooling import mean_pool
from serupa.operators.topk import topk_cosine
from serupa.plans.check import by_size, in_report_order, parse_hit_id, similarity_hits, similarity_summary, text_of_words, with_lexical
from serupa.plans.compare import compare_pairs, score_pairs
from serupa.plans.load import bulk_load
from serupa.plans.near_duplicates import near_duplicates
from serupa.session import read_table, scratch_path, stage
from serupa.sources.exports import from_payloads, read_export, to_payloads
from serupa.sources.json_array import write_json_array
from serupa.sources.reports import read_pairs, write_metrics
from serupa.streaming.check import start_checks
from serupa.streaming.sync import SyncStream, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# --- search -----------------------------------------------------------------------------------


def _text_index(spark: SparkSession, folder: str) -> DataFrame:
    return index_rows(src.text_documents(spark, folder), ENCODER)


def _check(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    queries, _ = ing.split_valid(ing.check_queries(src.benchmark_queries(spark, folder)))
    return queries, similarity_hits(queries, _text_index(spark, folder), ENCODER)


@query("similarity_check")
def similarity_check(spark: SparkSession, folder: str) -> DataFrame:
    _, hits = _check(spark, folder)
    return in_report_order(hits).select(*schemas.HIT_COLUMNS)


@query("similarity_summary")
def similarity_summary_report(spark: SparkSession, folder: str) -> DataFrame:
    queries, hits = _check(spark, folder)
    shown = F.transform("results", lambda h: F.concat(h["id"], F.lit("="), h["similarity_persen"]))
    return similarity_summary(queries, hits).select(
        "query_id",
        F.col("query")["judul"].alias("judul"),
        "total_found",
        F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("results"),
        "peringatan",
    )


@query("similarity_check_dynamic")
def similarity_check_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    """Queries against a stored index, cleaned with the stopwords of its titles."""
    table = _table(spark)
    table.replace(_text_index(spark, folder))
    words = _words(table)
    queries, _ = ing.split_valid(ing.check_queries(src.benchmark_queries(spark, folder)))
    return in_report_order(similarity_hits(queries, table.read(), ENCODER, words)).select(*schemas.HIT_COLUMNS)


@query("compare_pairs_dynamic")
def compare_pairs_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation compared with the stopwords of a stored index."""
    table = _table(spark)
    table.replace(_text_index(spark, folder))
    return compare_pairs(src.turn_pairs(spark, folder), ENCODER, _words(table)).drop("judul_a", "judul_b")


def _words(table: IndexTable) -> list[str]:
    return corpus.inline_words(corpus.dynamic_stopwords(corpus.titles(table.read())))


@query("similarity_check_weighted")
def similarity_check_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Page titles against the page index, whose vectors also hold abstract and keywords."""
    docs = src.page_documents(spark, folder)
    index = index_rows(docs, ENCODER)
    queries = docs.select(
        F.col("document_id").alias("query_id"), "judul", F.lit(5).alias("top_k"), F.lit(0.5).alias("threshold"),
        F.lit(None).cast("string").alias("document_type"), F.col("document_id").alias("exclude_id"),
    )
    hits = in_report_order(similarity_hits(queries, index, ENCODER))
    return hits.select("query_id", "id", "similarity_score", "similarity_persen", "level", "semantic_rank")


def _near(spark: SparkSession, folder: str, **how: bool) -> DataFrame:
    read = ["id", "embedding", "document", "document_id", "document_type"]  # by the report; whole texts are stored once
    index = stage(_text_index(spark, folder).select(*read), "index")
    hits = near_duplicates(index, ENCODER, **how)
    return hits.select("source_id", "id", "similarity_score", "similarity_persen", "level", "semantic_rank")


@query("near_duplicates")
def near_duplicate_report(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder)


@query("near_duplicates_cells")
def near_duplicate_report_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The exact form by angle bounds between cells."""
    return _near(spark, folder, cells=True)


@query("near_duplicates_lsh")
def near_duplicate_report_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The approximate form: rows found by probing cells."""
    return _near(spark, folder, approximate=True)


@query("vector_topk")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_topk(spark, folder, typed=False, exclude=False)


@query("vector_topk_filtered")
def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_topk(spark, folder, typed=True, exclude=False)


@query("vector_topk_exclude_self")
def vector_topk_exclude_self(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_topk(spark, folder, typed=False, exclude=True)


def _vector_queries(vecs: DataFrame, typed: bool, exclude: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    return vecs.select(
        F.col("vec_id").alias("query_id"), "embedding",
        (F.when(F.col("vec_id") % 4 != 0, F.col("document_type")) if typed else none).alias("document_type"),
        (F.col("id") if exclude else none).alias("exclude_id"),
    )


def _shape(found: DataFrame) -> DataFrame:
    rank = F.col("semantic_rank").cast("int").alias("rank")
    return found.select("query_id", "id", round4(F.col("cosine")).alias("similarity_score"), rank)


def _vector_topk(spark: SparkSession, folder: str, typed: bool, exclude: bool) -> DataFrame:
    vecs = src.vectors(spark, folder)
    return _shape(topk_cosine(_vector_queries(vecs, typed, exclude), vecs, dim=64, k=5))


@query("vector_topk_large_k")
def vector_topk_large_k(spark: SparkSession, folder: str) -> DataFrame:
    """More neighbours than a checked query may ask for, given per query."""
    vecs = src.vectors(spark, folder)
    queries = _vector_queries(vecs, False, False).withColumn("top_k", (F.col("query_id") % 3 * 10 + 30).cast("int"))
    return _shape(topk_cosine(queries, vecs, dim=64))


@query("vector_topk_tiled")
def vector_topk_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """The form for large query tables: nothing is broadcast."""
    vecs = src.vectors(spark, folder)
    forced = type(DEFAULTS)(broadcast_bytes=0)
    return _shape(topk_cosine(_vector_queries(vecs, False, True), vecs, dim=64, k=5, settings=forced))


@query("vector_topk_cells")
def vector_topk_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The exact form by angle bounds between cells."""
    vecs = src.vectors(spark, folder)
    return _shape(topk_cosine_cells(_vector_queries(vecs, False, True), vecs, dim=64, k=5, exact=True))


@query("vector_topk_lsh")
def vector_topk_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The approximate form: rows found by probing cells."""
    vecs = src.vectors(spark, folder)
    return _shape(topk_cosine_cells(_vector_queries(vecs, False, True), vecs, dim=64, k=5))


# --- pairs ------------------------------------------------------------------------------------


@query("compare_pairs")
def pair_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return compare_pairs(src.turn_pairs(spark, folder), ENCODER).drop("judul_a", "judul_b")


@query("jaccard_pairs")
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = src.turn_pairs(spark, folder)
    return pairs.select(
        "conv_id",
        "turn",
        scoring.jaccard(F.col("judul_a"), F.col("judul_b")).alias("jaccard"),
        scoring.jaccard(tx.clean_title(F.col("judul_a")), tx.clean_title(F.col("judul_b"))).alias("jaccard_clean"),
    )


@query("similarity_levels")
def similarity_levels(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("value") / (F.lit(100.0) + F.col("value"))
    return read_table(spark, folder, "events").select(
        "event_id", round4(score).alias("score"), scoring.persen(score).alias("persen"), scoring.level(score).alias("level")
    )


@query("parse_hit_ids")
def parse_hit_ids(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    shape = (
        F.when(n % 5 == 0, F.concat(F.lit("skripsi_"), n))
        .when(n % 5 == 1, F.concat(F.lit("internship_report_"), n))
        .when(n % 5 == 2, n.cast("string"))
        .when(n % 5 == 3, F.concat(F.lit("draft_"), "source"))
        .otherwise(F.col("source"))
    )
    rows = read_table(spark, folder, "documents").select("doc_id", shape.alias("id"), F.col("lang").alias("stored_type"))
    number, kind = parse_hit_id(F.col("id"), F.col("stored_type"))
    return rows.select(
        "doc_id", "id", number.alias("document_id"), kind.alias("document_type"),
        F.when(kind == "skripsi", number).alias("skripsi_id"),
    )


# --- vectors ----------------------------------------------------------------------------------


def _cells(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    cells = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return cells.select(key, "pos", snap(F.col("x").cast("double"), 6).alias("value"))


@query("l2_normalize")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    vecs = read_table(spark, folder, "embeddings")
    scaled = F.transform("embedding", lambda x: x * (F.col("label") + 2))
    return _cells(vecs.select("vec_id", vectors.l2_normalize(scaled).alias("embedding")), "vec_id")


@query("weighted_embedding")
def weighted_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors i, i+1 and i+2 as the three parts of one document."""
    vecs = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    shifted = [vecs.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(f"v{i}")) for i in (1, 2)]
    parts = vecs.join(shifted[0], "vec_id", "left").join(shifted[1], "vec_id", "left")
    weights = [F.lit(0.7), F.lit(0.2), F.lit(0.1)]
    combined = vectors.weighted_embedding([F.col("embedding"), F.col("v1"), F.col("v2")], weights)
    return _cells(parts.select("vec_id", combined.alias("embedding")), "vec_id")


@query("mean_pool")
def mean_pooling(spark: SparkSession, folder: str) -> DataFrame:
    vecs = read_table(spark, folder, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = mean_pool(vecs, "label", mask="mask")
    return pooled.select("label", "pos", snap(F.col("value"), 6).alias("value"))


# --- text -------------------------------------------------------------------------------------


@query("clean_titles")
def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.text_documents(spark, folder).select("document_id", "judul")
    pages = src.page_documents(spark, folder).select(F.concat(F.lit("page_"), "document_id").alias("document_id"), "judul")
    return docs.unionByName(pages).select("document_id", tx.clean_title(F.col("judul")).alias("clean"))


@query("clean_titles_dynamic")
def clean_titles_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.text_documents(spark, folder).select("document_id", "judul")
    words = corpus.dynamic_stopwords(docs.where("judul <> ''"), "judul")
    return corpus.clean_titles(docs, "judul", words, key="document_id").select("document_id", "clean")


@query("dynamic_stopwords")
def dynamic_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.text_documents(spark, folder)
    return corpus.dynamic_stopwords(docs.where("judul <> ''"), "judul")


@query("index_text")
def index_text(spark: SparkSession, folder: str) -> DataFrame:
    return src.page_documents(spark, folder).select(
        "document_id",
        tx.index_text(F.col("judul"), F.col("abstrak"), F.col("kata_kunci")).alias("index_text"),
        tx.query_text(F.col("judul")).alias("query_text"),
    )


@query("resolve_weights")
def field_weights(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    given = [F.when(n % m != 0, (n % d - 1).cast("double")) for m, d in ((4, 5), (3, 4), (5, 3))]
    w = resolve_weights(*given)
    rows = read_table(spark, folder, "documents").select("doc_id", w.alias("w"))
    return rows.select("doc_id", *[round4(F.col("w")[c]).alias(c) for c in ("judul", "abstrak", "kata_kunci")])


def _encoded_cells(encoded: DataFrame) -> DataFrame:
    cells = _cells(encoded, "document_id")
    return cells.where("value <> 0").withColumnRenamed("pos", "bucket")


@query("encode_documents")
def encoded_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded_cells(encode_documents(src.page_documents(spark, folder), ENCODER))


def _model():
    """A stand-in for a user model: the same hashing, text by text in Python."""
    import hashlib
    import re

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 256))
        for i, text in enumerate(texts):
            for token in re.findall(r"[^\W_]+", text.lower()):
                code = int(hashlib.md5(token.encode()).hexdigest()[:9], 16)
                out[i, (code >> 4) % 256] += 1 - 2 * (code & 1)
        return out

    return encode


@query("encode_documents_model")
def encoded_documents_model(spark: SparkSession, folder: str) -> DataFrame:
    """A pluggable model, called once per distinct text."""
    encoder = PandasEncoder(_model, 256, "python-hash")
    return _encoded_cells(encode_documents(src.page_documents(spark, folder), encoder))


# --- intake -----------------------------------------------------------------------------------


def _raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All id forms and broken bounds, by document number."""
    n = F.col("doc_id")
    text = n.cast("string")
    return read_table(spark, folder, "documents").select(
        n.alias("row"),
        F.when(n % 6 == 1, F.concat(F.lit("skripsi_"), text)).when(n % 6 == 2, F.concat(F.lit("x_y"), text))
        .when(n % 6 == 3, text).alias("document_id"),
        F.when(n % 4 == 1, "internship_report").when(n % 4 == 2, "").alias("document_type"),
        F.when(n % 8 == 3, "laporan").alias("type"),
        F.when(n % 6 == 4, text).when(n % 12 == 5, "0").when(n % 24 == 0, "abc").alias("skripsi_id"),
        F.when(n % 12 == 6, text).when(n % 12 == 5, text).alias("laravel_id"),
        F.col("text").alias("judul"),
        (1980 + n % 130).cast("int").alias("tahun"),
        (n % 5 - 1).cast("double").alias("bobot_judul"),
        F.when(n % 2 == 0, (n % 7 - 1).cast("double")).alias("bobot_abstrak"),
    )


@query("normalize_ids")
def normalize_ids(spark: SparkSession, folder: str) -> DataFrame:
    return ing.normalize_ids(_raw_documents(spark, folder)).select(
        "row", "document_id", "document_type", "skripsi_id", "id_error"
    )


@query("validate_docs")
def validate_docs(spark: SparkSession, folder: str) -> DataFrame:
    checked = ing.check_documents(ing.normalize_ids(_raw_documents(spark, folder)))
    return checked.select("row", F.array_join("errors", ",").alias("errors"))


@query("validate_queries")
def validate_queries(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    raw = read_table(spark, folder, "documents").select(
        n.alias("query_id"),
        F.when(n % 50 != 0, F.col("text")).alias("judul"),
        F.when(n % 3 != 0, n % 24).cast("int").alias("top_k"),
        F.when(n % 4 != 0, (n % 13) / 10.0 - 0.1).alias("threshold"),
        F.lit(None).cast("string").alias("document_type"),
    )
    return ing.check_queries(raw).select(
        "query_id", "top_k", round4(F.col("threshold")).alias("threshold"), F.array_join("errors", ",").alias("errors")
    )


@query("build_metadata")
def build_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return ing.metadata(src.text_documents(spark, folder))


def _export(spark: SparkSession, folder: str, lines: bool = True) -> DataFrame:
    """Page documents written as an export (JSON Lines or arrays) and read back as such."""
    n = F.regexp_extract("document_id", "([0-9]+)$", 1)
    source = F.when(n % 7 == 0, None).when(n % 11 == 0, "0").when(n % 13 == 0, "").otherwise(n)
    path = scratch_path(spark, "export")
    docs = src.page_documents(spark, folder).select(source.alias("skripsi_id"), *schemas.EXPORT_RECORD.names[1:6])
    if lines:
        docs.write.json(path)
    else:
        write_json_array(docs, path)
    return read_export(spark, path, lines)


@query("reindex_ingest")
def reindex_ingest(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = ing.ingest(ing.export_documents(_export(spark, folder)))
    return valid.select("document_id", "document_type", "skripsi_id", "judul", "tahun", "program_studi", "nim")


@query("reindex_ingest_array")
def reindex_ingest_array(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = ing.ingest(ing.export_documents(_export(spark, folder, lines=False)))
    return valid.select("document_id", "document_type", "skripsi_id", "judul", "tahun", "program_studi", "nim")


@query("reindex_counters")
def reindex_counters(spark: SparkSession, folder: str) -> DataFrame:
    return ing.export_counters(_export(spark, folder))


@query("payload_roundtrip")
def payload_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 100 documents to JSON and back; every other batch in the old form, a bare list."""
    docs = src.page_documents(spark, folder)
    number = F.regexp_extract("document_id", "([0-9]+)$", 1).cast("bigint")
    payloads = to_payloads(docs.withColumns({"nim": F.lit(None), "nama_mahasiswa": F.lit(None)}),
                           F.floor(number / 100), reset_index=True)
    bare = F.regexp_extract("payload", r'(?s)^\{"data":(.*),"reset_index":true\}$', 1)
    mixed = payloads.withColumn("payload", F.when(F.col("batch") % 2 == 1, bare).otherwise(F.col("payload")))
    return from_payloads(mixed).select(
        "batch", "reset_index", "document_id", "document_type", "skripsi_id", "judul", "abstrak", "tahun", "bobot_judul"
    )


# --- index ------------------------------------------------------------------------------------


def _page_rows(spark: SparkSession, folder: str) -> DataFrame:
    return index_rows(src.page_documents(spark, folder), ENCODER)


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    saves, _ = ing.ingest(src.event_changes(spark, folder).where("op = 'upsert'"))
    saves = saves.withColumn("position", F.col("event_time"))
    return index_rows(last_documents(saves), ENCODER, carry=("position",))


def _table(spark: SparkSession) -> IndexTable:
    return IndexTable(spark, scratch_path(spark, "index"))


def _contents(index: DataFrame) -> DataFrame:
    """Rows of an index; the digest, a weighted sum of the vector's elements, stands for the vector."""
    weighed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    digest = snap(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6).alias("digest")
    return index.select("id", "document", "document_type", "skripsi_id", "tahun", "program_studi", digest)


@query("index_build")
def index_build(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark)
    table.replace(_page_rows(spark, folder))
    return _contents(table.read())


@query("index_upsert")
def index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark)
    table.replace(_page_rows(spark, folder))
    table.upsert(_event_rows(spark, folder))
    return _contents(table.read())


@query("index_delete")
def index_delete(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark)
    table.replace(_page_rows(spark, folder))
    keys = src.event_changes(spark, folder).where("op = 'delete'").select(F.col("skripsi_id").alias("key"))
    table.delete(keys)
    return _contents(table.read())


@query("index_replace")
def index_replace(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark)
    table.replace(_page_rows(spark, folder))
    table.replace(_event_rows(spark, folder))
    return _contents(table.read())


@query("index_upsert_payload")
def index_upsert_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that repeat ids, merged into an index: the last item of an id wins."""
    pages = src.page_documents(spark, folder)
    table = _table(spark)
    table.replace(index_rows(pages, ENCODER))
    n = F.regexp_extract("document_id", "([0-9]+)$", 1).cast("bigint")
    editions = pages.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n % 3)))
    items = editions.withColumns({"judul": F.concat("judul", F.lit(" edisi "), "k"), "nim": F.lit(None), "nama_mahasiswa": F.lit(None)})
    payloads = stage(to_payloads(items, F.floor(n / 100), order=n * 10 + F.col("k")), "payloads")
    docs, _ = ing.ingest(from_payloads(payloads).where("judul NOT LIKE '% edisi 0'"))
    table.upsert(index_rows(last_documents(docs), ENCODER, carry=("position",)))
    return table.read().select("id", "document", "document_type", "skripsi_id", "tahun")


@query("bulk_load_report")
def bulk_load_report(spark: SparkSession, folder: str) -> DataFrame:
    """A reset, a merge and a load of which nothing is valid, as the ledger and the index show them."""
    table, jobs = _table(spark), ledger.JobLedger(spark, scratch_path(spark, "ledger"))
    raw = stage(_raw_documents(spark, folder).withColumn("position", F.col("row")), "raw")
    _, bad = ing.ingest(raw)
    events = src.event_changes(spark, folder).where("op = 'upsert'").withColumn("position", F.col("event_time"))
    bulk_load("reset", raw, table, jobs, ENCODER, reset_index=True)
    bulk_load("merge", stage(events, "events"), table, jobs, ENCODER)
    try:
        bulk_load("invalid", raw.join(bad.select("row"), "row", "left_semi"), table, jobs, ENCODER)
    except ix.EmptyInput:
        pass  # the ledger shows it
    rejected = spark.read.parquet(f"{table.path}/quarantine/*").select(F.count("*")).scalar()
    return jobs.states().select(
        "job_id", "status", "total_received", "rejected", "total_processed", "error_message",
        F.lit(table.count()).cast("bigint").alias("total_indexed"), F.lit(rejected).cast("bigint").alias("quarantined"),
    )


def _text_table(spark: SparkSession, folder: str) -> DataFrame:
    """A stored index of the text documents; every ninth has no stored text."""
    table = _table(spark)
    stored = F.when(F.col("skripsi_id") % 9 != 0, F.col("document")).otherwise("")
    table.replace(_text_index(spark, folder).withColumn("document", stored))
    return table.read()


@query("index_count")
def index_count(spark: SparkSession, folder: str) -> DataFrame:
    return _text_table(spark, folder).agg(F.count("*").alias("total_indexed"))


@query("ingest_verify")
def ingest_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Both modes: a consistent replace, a short replace, a merge that grew and one that lost rows."""
    docs = src.text_documents(spark, folder)
    pages = src.page_documents(spark, folder)
    cases = [("replace", docs, docs, True), ("replace_short", docs, pages, True),
             ("merge", pages, docs, False), ("merge_short", docs, pages, False)]
    rows = [
        ix.reconcile(received, index, replace).withColumn("load", F.lit(name)) for name, received, index, replace in cases
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("indexed_ids_page")
def indexed_ids_page(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 ids behind a known one."""
    return ix.page_of_ids(_text_table(spark, folder), 500, after="internship_report_3")


@query("corpus_titles")
def corpus_titles(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.titles(_text_table(spark, folder))


@query("stats_program")
def stats_program(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.program_distribution(_text_table(spark, folder))


@query("stats_year")
def stats_year(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.year_distribution(_text_table(spark, folder))


# --- evaluation -------------------------------------------------------------------------------


def _labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every page title with its three nearest other titles; similar means that the articles share half their words."""
    words = F.coalesce(scoring.word_set(F.col("abstrak")), F.array().cast("array<string>"))
    pages = src.page_documents(spark, folder).select(
        "document_id", F.regexp_extract("document_id", "([0-9]+)$", 1).cast("bigint").alias("n"), "judul", *text_of_words(words)
    )
    titles = stage(encode_texts(pages.withColumn("_c", tx.clean_title(F.col("judul"))), "_c", ENCODER), "titles")
    queries = titles.select(F.col("n").alias("query_id"), "embedding", F.col("document_id").alias("exclude_id"))
    near = topk_cosine(queries, titles.select(F.col("document_id").alias("id"), "embedding"), ENCODER.dim, k=3)
    a = titles.select(F.col("n").alias("query_id"), F.col("judul").alias("judul_a"), "_n", "_digest")
    b = titles.select(F.col("document_id").alias("id"), F.col("judul").alias("judul_b"), F.col("_n").alias("_hit_n"), F.col("_digest").alias("_hit_digest"))
    pairs = stage(by_size(near.join(a, "query_id").join(b, "id")), "pairs")
    close = F.col("_n_small") >= F.col("_n_large") * 0.5  # others cannot share half their words
    labelled = with_lexical(pairs, titles.select("_digest", "_text"), close).select(
        (F.col("query_id") * 3 + F.col("semantic_rank")).alias("no"), "judul_a", "judul_b",
        (F.col("_lexical") >= 0.5).cast("int").alias("label"),
    )
    return labelled.repartition(4 * spark.sparkContext.defaultParallelism, "no")  # scoring is much work for few bytes


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.predictions(score_pairs(_labelled_pairs(spark, folder), ENCODER))


@query("eval_predictions")
def eval_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder)


@query("eval_confusion")
def eval_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.metrics(_predictions(spark, folder), [0.5])


@query("eval_target_metrics")
def eval_target_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.target_metrics(_predictions(spark, folder))


@query("eval_threshold_sweep")
def eval_threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.metrics(_predictions(spark, folder))


@query("eval_best_threshold")
def eval_best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.best_threshold(evaluate.metrics(_predictions(spark, folder)))


def _report(spark: SparkSession, folder: str) -> str:
    """Pairs through a file into scores, and the report files of the evaluation."""
    pairs_path, path = scratch_path(spark, "pairs"), scratch_path(spark, "report")
    _labelled_pairs(spark, folder).write.json(pairs_path)
    scored = stage(evaluate.predictions(score_pairs(read_pairs(spark, pairs_path, lines=True), ENCODER)), "predictions")
    swept = evaluate.metrics(scored)
    write_metrics(path, scored.count(), evaluate.target_metrics(scored), evaluate.best_threshold(swept), swept, scored, ENCODER.name, DEFAULTS.eval_target)
    return path


@query("eval_predictions_file")
def eval_predictions_file(spark: SparkSession, folder: str) -> DataFrame:
    schema = "no BIGINT, judul_a STRING, judul_b STRING, label INT, score DOUBLE, semantic_score DOUBLE, lexical_score DOUBLE, level STRING"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{_report(spark, folder)}/predictions")


@query("eval_sweep_file")
def eval_sweep_file(spark: SparkSession, folder: str) -> DataFrame:
    schema = "threshold DOUBLE, tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE, accuracy DOUBLE"
    return spark.read.schema(schema).option("header", True).csv(f"{_report(spark, folder)}/threshold_sweep")


@query("eval_summary_file")
def eval_summary_file(spark: SparkSession, folder: str) -> DataFrame:
    summary = spark.read.json(f"{_report(spark, folder)}/summary")
    best = [F.col(f"best_threshold_metrics.{c}").alias(c) for c in ("threshold", "tp", "fp", "fn", "tn", "f1")]
    return summary.select(F.col("meta.total_pairs").alias("total_pairs"), F.size("metrics_by_threshold").alias("thresholds"), *best)


# --- jobs and streams -------------------------------------------------------------------------


def _job_states(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed")
        .otherwise("processing")
    )
    message = F.when(kind == "error", F.repeat(F.concat("props", F.lit(" ")), 300))
    rows = read_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 500).alias("total_processed"), ledger.clip_error(message).alias("error_message"),
    )
    return ledger.latest_states(rows, "seq")


@query("job_ledger_latest")
def job_ledger_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _job_states(spark, folder)


@query("job_ledger_unfinished")
def job_ledger_unfinished(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.unfinished(_job_states(spark, folder))


@query("stream_sync")
def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark)
    sync = SyncStream(table, ENCODER)
    feed, checkpoint = src.event_stream(spark, folder), scratch_path(spark, "checkpoint")
    run_available(lambda: sync.start(feed, checkpoint))
    return _contents(table.read())


@query("stream_check")
def stream_check(spark: SparkSession, folder: str) -> DataFrame:
    index = stage(_text_index(spark, folder), "index")
    output, checkpoint = scratch_path(spark, "hits"), scratch_path(spark, "checkpoint")
    feed = src.query_stream(spark, folder)
    run_available(lambda: start_checks(feed, index, ENCODER, output, checkpoint))
    return spark.read.parquet(output).select(*schemas.HIT_COLUMNS)
