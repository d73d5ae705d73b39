import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from serupa import schemas
from serupa.config import Settings
from serupa.operators import index as ix
from serupa.operators.corpus import program_distribution, year_distribution
from serupa.operators.encode import HashEncoder, PandasEncoder
from serupa.operators.index import ConcurrentCommit, EmptyInput, InconsistentIndex, IndexTable, index_rows
from serupa.operators.ingest import with_columns
from serupa.operators.ledger import JobLedger
from serupa.plans.load import bulk_load, resume_unfinished
from serupa.session import scratch_path
from serupa.streaming.check import start_checks
from serupa.streaming.sync import SyncStream, run_available

ENC = HashEncoder(16)


def docs(spark, *rows):
    return with_columns(spark.createDataFrame(list(rows), "document_id STRING, document_type STRING, judul STRING, tahun INT, position INT"), schemas.DOC)


def rows(spark, *items):
    return index_rows(docs(spark, *items), ENC, carry=("position",))


def state(table):
    return {(r.id, r.document, r.document_type) for r in table.read().collect()}


@pytest.fixture(params=[Settings(), Settings(broadcast_rows=0)], ids=["few", "many"])
def table(spark, request):
    return IndexTable(spark, scratch_path(spark, "index"), request.param)


def test_life_cycle(spark, table):
    assert table.count() == 0 and table.read().columns == schemas.INDEX.names
    assert table.upsert(rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1))) == 1
    assert table.replace(rows(spark, ("skripsi_1", "skripsi", "lama", 2020, 1), ("skripsi_1", "skripsi", "baru", 2020, 2),
                              ("skripsi_2", "skripsi", "judul dua", None, 3))) == 2
    want = {("skripsi_1", "baru", "skripsi"), ("skripsi_2", "judul dua", "skripsi")}
    assert state(table) == want
    table.upsert(rows(spark, ("skripsi_2", "laporan", "pindah tipe", 2021, 1), ("skripsi_3", "skripsi", "judul tiga", 2021, 2)))
    want = {("skripsi_1", "baru", "skripsi"), ("skripsi_2", "pindah tipe", "laporan"), ("skripsi_3", "judul tiga", "skripsi")}
    assert state(table) == want
    keys = spark.createDataFrame([("1",), ("skripsi_77",), ("1",)], "key STRING")
    for _ in range(2):  # idempotent
        table.delete(keys)
        assert state(table) == {r for r in want if r[0] != "skripsi_1"}
    table.upsert(rows(spark, ("skripsi_1", "skripsi", "kembali lagi", 2020, 1)))
    before = state(table)
    assert table.compact() == 3 and state(table) == before
    assert [c.kind for c in table.commits()] == ["merge", "replace", "merge", "delete", "delete", "merge", "compact"]


def test_merge_is_idempotent(spark, table):
    batch = rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1), ("skripsi_2", "skripsi", "judul dua", 2020, 1))
    table.upsert(batch)
    first = state(table)
    table.upsert(batch)
    assert state(table) == first


def test_partition_pruning(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    table.replace(rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1), ("x_2", "laporan", "judul dua", 2020, 1)))
    plan = table.read().where("document_type = 'laporan'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(document_type" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_failed_load_stays_invisible(spark, monkeypatch):
    table = IndexTable(spark, scratch_path(spark, "index"))
    table.replace(rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1)))
    twice = rows(spark, ("skripsi_2", "skripsi", "a", 2020, 1), ("skripsi_2", "skripsi", "b", 2020, 1))
    monkeypatch.setattr(IndexTable, "_latest", staticmethod(lambda r: r))
    with pytest.raises(InconsistentIndex):
        table.replace(twice)
    assert state(table) == {("skripsi_1", "judul satu", "skripsi")}


def test_repeated_ids_need_a_position(spark, table):
    twice = rows(spark, ("skripsi_2", "skripsi", "judul b", 2020, 7), ("skripsi_2", "skripsi", "judul a", 2020, 7))
    table.upsert(twice)
    assert state(table) == {("skripsi_2", "judul b", "skripsi")}  # of equal positions the later title
    with pytest.raises(InconsistentIndex):
        table.upsert(twice.drop("position"))


def test_rows_lost_before_the_write_are_noticed(spark, table):
    one = rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1))
    for load in (table.replace, table.upsert):
        with pytest.raises(InconsistentIndex, match="=2, vector=1"):
            load(one, expected=2)
    assert table.count() == 0 and table.upsert(one, expected=1) == 1


def test_a_taken_number_fails(spark, monkeypatch):
    table = IndexTable(spark, scratch_path(spark, "index"))
    table.upsert(rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1)))
    other, known = IndexTable(spark, table.path), table.commits()
    table.upsert(rows(spark, ("skripsi_2", "skripsi", "judul dua", 2020, 1)))
    with monkeypatch.context() as m:  # the other writer read the log before the second commit
        m.setattr(IndexTable, "commits", lambda self: known)
        with pytest.raises(ConcurrentCommit):
            other.upsert(rows(spark, ("skripsi_3", "skripsi", "judul tiga", 2020, 1)))
    assert {r.id for r in table.read().collect()} == {"skripsi_1", "skripsi_2"} and len(table.commits()) == 2
    other.upsert(rows(spark, ("skripsi_3", "skripsi", "judul tiga", 2020, 1)))
    assert table.commits()[-1].commit == 3 and table.commits()[-1].total == 3


def test_two_records_of_one_number(spark):
    """Both writers found the number free: the smaller folder has it, for every reader."""
    table = IndexTable(spark, scratch_path(spark, "index"))
    table.upsert(rows(spark, ("skripsi_1", "skripsi", "judul satu", 2020, 1)))
    mine = spark.read.json(f"{table.path}/commits").drop("number")
    for folder in ("commit=1/part=a", "commit=1/part=z"):
        mine.withColumn("folder", F.lit(folder)).write.mode("append").json(f"{table.path}/commits/number=1")
    assert [c.folder for c in table.commits()] == ["commit=1/part=a"]


def test_ledger_reads_one_folder(spark):
    ledger = JobLedger(spark, scratch_path(spark, "ledger"))
    for n in range(4):
        ledger.create(f"job{n}", n)
    plan = ledger.rows_of("job2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert [r.total_received for r in ledger.find("job2").collect()] == [2] and ledger.states().count() == 4
    assert ledger.find("none").count() == 0 and ledger.rows().columns == JobLedger.SCHEMA.names


def test_drop_scratch():
    """In a session of its own process, as it deletes what that session has staged."""
    code = (
        "import os, tempfile\n"
        "from serupa.session import build_session, drop_scratch, stage\n"
        "root = tempfile.mkdtemp(prefix='serupa-tests-')\n"
        "spark = build_session('local[1]', **{'spark.ui.enabled': 'false', 'spark.checkpoint.dir': root})\n"
        "assert stage(spark.range(3), 'ids').count() == 3 and len(os.listdir(root + '/serupa')) == 1\n"
        "os.mkdir(root + '/serupa/other')\n"
        "drop_scratch(spark)\n"
        "assert os.listdir(root + '/serupa') == ['other']\n"
        "drop_scratch(spark)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


def test_reconcile(spark):
    ids = lambda n: spark.range(n).select(F.col("id").cast("string").alias("document_id"))
    cases = [(True, 5, 5, True), (True, 5, 4, False), (False, 5, 5, True), (False, 5, 9, True), (False, 5, 4, False)]
    for replace, expected, found, good in cases:
        got = ix.reconcile(ids(expected), ids(found), replace).first()
        assert (got.status == "completed") is good and (got.error_message is None) is good
    doubled = ids(5).unionByName(ids(5))
    assert ix.reconcile(doubled, ids(5), True).first().status == "completed"


def test_pages_of_ids(spark):
    index = spark.range(7).select(F.concat(F.lit("d"), "id").alias("id"))
    assert [r.id for r in ix.page_of_ids(index, 3, 2).collect()] == ["d2", "d3", "d4"]
    assert [r.id for r in ix.page_of_ids(index, 3, after="d1").collect()] == ["d2", "d3", "d4"]


def test_stats(spark):
    meta = spark.createDataFrame(
        [("Informatika", 2024), ("Informatika", 2024), ("Sistem Informasi", 2023), (None, 0)], "program_studi STRING, tahun INT"
    )
    assert {r.program_studi: r.n for r in program_distribution(meta).collect()} == {
        "Informatika": 2, "Sistem Informasi": 1, "Tidak Diketahui": 1
    }
    assert {r.tahun: r.n for r in year_distribution(meta).collect()} == {"2024": 2, "2023": 1}
    assert program_distribution(meta.where("false")).count() == 0


def test_bulk_load(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    ledger = JobLedger(spark, scratch_path(spark, "ledger"))
    assert ledger.states().count() == 0
    raw = docs(spark, ("skripsi_1", "skripsi", "deteksi padi", 2020, 1), ("skripsi_2", "skripsi", "x", 2020, 2))
    result = bulk_load("j1", raw, table, ledger, ENC, reset_index=True)
    assert (result.received, result.quarantined, result.total_indexed) == (2, 1, 1)
    assert {r.word for r in result.stopwords.collect()} == {"deteksi", "padi"}
    job = ledger.find("j1").first()
    assert (job.status, job.total_received, job.total_processed, job.rejected, job.error_message) == ("completed", 2, 1, 1, None)
    assert [r.errors for r in spark.read.parquet(f"{table.path}/quarantine/j1").collect()] == [["judul_too_short"]]
    assert job.created_at <= job.started_at <= job.completed_at
    with pytest.raises(EmptyInput):
        bulk_load("j2", raw.where("false"), table, ledger, ENC)
    with pytest.raises(EmptyInput):
        bulk_load("j3", raw.where("judul = 'x'"), table, ledger, ENC)  # nothing valid
    failed = ledger.find("j3").first()
    assert failed.status == "failed" and failed.error_message and table.count() == 1
    ledger.create("j4", 3)
    ledger.create("j5", 3)
    ledger.mark_processing("j5")
    ledger.mark_failed("j3", "e" * 3000)
    assert len(ledger.find("j3").first().error_message) == 2000
    seen = []
    assert resume_unfinished(ledger, seen.append) == 2 and seen == ["j4", "j5"]


def changes(spark, *items):
    schema = "op STRING, skripsi_id STRING, document_id STRING, judul STRING, event_time TIMESTAMP"
    return spark.createDataFrame(
        [(op, str(n), f"skripsi_{n}", title, None) for op, n, title, _ in items], schema
    ).drop("event_time").join(
        spark.createDataFrame([(str(n), title, t) for _, n, title, t in items], "skripsi_id STRING, judul STRING, t LONG"),
        ["skripsi_id", "judul"],
    ).withColumn("event_time", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize(("share", "folding"), [(0.1, "compact"), (99.0, "squash")])
def test_sync_batches(spark, share, folding):
    table = IndexTable(spark, scratch_path(spark, "index"))
    ledger = JobLedger(spark, scratch_path(spark, "ledger"))
    sync = SyncStream(table, ENC, ledger, squash_every=2, compact_share=share)
    first = changes(spark, ("upsert", 1, "judul satu", 10), ("upsert", 1, "judul baru", 20), ("upsert", 2, "judul dua", 10),
                    ("delete", 3, "-----", 50), ("upsert", 4, "x", 5))
    sync.apply(first, 0)
    assert {(r.id, r.document) for r in table.read().collect()} == {("skripsi_1", "judul baru"), ("skripsi_2", "judul dua")}
    assert sync.words == ["baru", "dua", "judul"]
    assert [r.judul for r in spark.read.parquet(f"{table.path}/quarantine/stream/sync/0").collect()] == ["x"]
    commits = len(table.commits())
    sync.apply(first, 0)  # a replayed batch
    assert len(table.commits()) == commits
    late = changes(spark, ("upsert", 3, "terlambat", 40), ("delete", 1, "-----", 15), ("delete", 2, "-----", 30))
    sync.apply(late, 1)
    assert {(r.id, r.document) for r in table.read().collect()} == {("skripsi_1", "judul baru")}
    assert sync.words == ["baru", "dua", "judul"]  # deletes alone do not refresh them
    later = changes(spark, ("upsert", 1, "zaman kuno", 19), ("upsert", 2, "judul kembali", 31), ("delete", 1, "-----", 21))
    sync.apply(later, 2)
    assert {(r.id, r.document) for r in table.read().collect()} == {("skripsi_2", "judul kembali")}
    sync.apply(changes(spark, ("upsert", 3, "terlambat lagi", 45), ("upsert", 1, "judul akhir", 22)), 3)
    assert {r.id for r in table.read().collect()} == {"skripsi_1", "skripsi_2"} and table.commits()[-1].total == 2
    assert {r.job_id: r.status for r in ledger.states().collect()} == {
        f"stream/sync/{n}": "completed" for n in range(4)
    }
    assert folding in [c.kind for c in table.commits()]


def test_failed_refresh_keeps_stopwords(spark, monkeypatch):
    table = IndexTable(spark, scratch_path(spark, "index"))
    sync = SyncStream(table, ENC)
    sync.words = ["lama"]

    def broken(*args, **kwargs):
        raise RuntimeError("broken")

    monkeypatch.setattr("serupa.operators.corpus.dynamic_stopwords", broken)
    sync.apply(changes(spark, ("upsert", 1, "judul satu", 10)), 0)
    assert sync.words == ["lama"] and table.count() == 1


def test_changes_of_the_same_time(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    sync = SyncStream(table, ENC)
    same = lambda title, seq: changes(spark, ("upsert", 1, title, 10)).withColumn("sequence", F.lit(seq))
    sync.apply(same("judul satu", 1).unionByName(same("judul dua", 2)), 0)
    assert [r.document for r in table.read().collect()] == ["judul dua"]
    sync.apply(same("judul tua", 1), 1)
    assert [r.document for r in table.read().collect()] == ["judul dua"]
    sync.apply(same("judul tiga", 3), 2)
    assert [r.document for r in table.read().collect()] == ["judul tiga"]


def test_sync_stream_restarts(spark):
    root = scratch_path(spark, "feed")
    batch = changes(spark, ("upsert", 1, "judul satu", 10), ("upsert", 2, "judul dua", 10))
    batch.write.mode("append").parquet(root)
    table = IndexTable(spark, scratch_path(spark, "index"))
    sync, checkpoint = SyncStream(table, ENC), scratch_path(spark, "checkpoint")
    feed = lambda: spark.readStream.schema(batch.schema).parquet(root)
    run_available(lambda: sync.start(feed(), checkpoint))
    assert table.count() == 2
    n = len(table.commits())
    run_available(lambda: sync.start(feed(), checkpoint))
    assert len(table.commits()) == n
    changes(spark, ("delete", 1, "-----", 20)).write.mode("append").parquet(root)
    run_available(lambda: sync.start(feed(), checkpoint))
    assert {r.id for r in table.read().collect()} == {"skripsi_2"}


def test_stream_check(spark):
    index = rows(spark, ("skripsi_1", "skripsi", "deteksi penyakit padi", 2020, 1)).cache()
    root, out = scratch_path(spark, "queries"), scratch_path(spark, "hits")
    asked = spark.createDataFrame([(1, "Deteksi penyakit padi", 5, 0.5, None), (2, "KP", 5, 0.5, None)], schemas.QUERY)
    asked.write.parquet(root)
    feed = spark.readStream.schema(schemas.QUERY).parquet(root)
    run_available(lambda: start_checks(feed, index, ENC, out, scratch_path(spark, "checkpoint")))
    got = spark.read.parquet(out).collect()
    assert [(r.query_id, r.id, r.level) for r in got] == [(1, "skripsi_1", "SANGAT TINGGI")]
    assert [(r.query_id, r.errors) for r in spark.read.parquet(f"{out}_rejected").collect()] == [(2, ["judul_too_short"])]


def test_stream_check_sees_commits(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    table.upsert(rows(spark, ("skripsi_1", "skripsi", "deteksi penyakit padi", 2020, 1)))
    root, out, checkpoint = (scratch_path(spark, n) for n in ("queries", "hits", "checkpoint"))
    feed = lambda: spark.readStream.schema(schemas.QUERY).parquet(root)
    for i, extra in enumerate((None, "deteksi penyakit jagung")):
        if extra:
            table.upsert(rows(spark, ("skripsi_2", "skripsi", extra, 2020, 1)))
        spark.createDataFrame([(i, "Deteksi penyakit jagung", 5, 0.9, None)], schemas.QUERY).write.mode("append").parquet(root)
        run_available(lambda: start_checks(feed(), table.read, ENC, out, checkpoint))
    assert [(r.query_id, r.id) for r in spark.read.parquet(out).collect()] == [(1, "skripsi_2")]


def test_only_last_of_an_id_is_encoded(spark):
    """Repeated ids are cut down before they get vectors, by position and then by title."""
    rows = [(f"skripsi_{i % 7}", "skripsi", f"judul nomor {i:03d}", i // 14) for i in range(140)] + [("skripsi_1", "skripsi", "judul tanpa tempat", None)]
    items = with_columns(spark.createDataFrame(rows, "document_id STRING, document_type STRING, judul STRING, position BIGINT"), schemas.DOC)
    seen = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            seen.add(len(texts))
            return np.ones((len(texts), 4))

        return encode

    table = IndexTable(spark, scratch_path(spark, "index"))
    jobs = JobLedger(spark, scratch_path(spark, "ledger"))
    bulk_load("job", items, table, jobs, PandasEncoder(load, 4, "counting"), reset_index=True)
    assert {(r.id, r.document) for r in table.read().collect()} == {(f"skripsi_{i % 7}", f"judul nomor {i:03d}") for i in range(133, 140)}
    assert seen.value == 7
    assert ix.last_documents(items.drop("position")).count() == 141  # without an order all rows stay
