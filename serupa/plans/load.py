"""Load jobs: raw documents to index commits, with ledger and stopword refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings
from serupa.operators import corpus
from serupa.operators.encode import Encoder
from serupa.operators.index import EmptyInput, IndexTable, index_rows, last_documents
from serupa.operators.ingest import ingest
from serupa.operators.ledger import JobLedger


@dataclass
class LoadResult:
    status: str
    received: int
    quarantined: int
    total_indexed: int
    stopwords: DataFrame | None


def bulk_load(
    job_id: str,
    raw: DataFrame,
    index: IndexTable,
    ledger: JobLedger,
    encoder: Encoder,
    reset_index: bool = False,
    dynamic=(),
    settings: Settings = DEFAULTS,
) -> LoadResult:
    """Validate, encode and commit a table of raw documents; ``position`` in ``raw`` orders equal ids.

    ``raw`` is read several times and should be a stored table. Rejected rows are written, with their
    errors, to ``quarantine/<job_id>`` beside the index. The index as read back must hold every valid id
    that was received. The ledger shows the job as pending, processing and completed or failed. A failed
    load leaves the index as it was. Stopwords are computed anew only after a completed one.
    """
    received = raw.count()
    if not received:
        raise EmptyInput("Data tidak boleh kosong.")
    ledger.create(job_id, received)
    ledger.mark_processing(job_id)
    try:
        valid, quarantine = ingest(raw, settings)
        carry = ("position",) if "position" in raw.columns else ()
        rows = index_rows(last_documents(valid), encoder, dynamic, settings, carry)
        rejected = index.reject(quarantine, job_id)
        expected = valid.agg(F.countDistinct("document_id")).first()[0]
        total = (index.replace if reset_index else index.upsert)(rows, source=job_id, expected=expected)
        ledger.update_progress(job_id, received - rejected, rejected)
        words = corpus.dynamic_stopwords(corpus.titles(index.read()), settings=settings)
        ledger.mark_completed(job_id)
    except Exception as error:
        ledger.mark_failed(job_id, str(error))
        raise
    return LoadResult("completed", received, rejected, total, words)


def resume_unfinished(ledger: JobLedger, start) -> int:
    """Call ``start(job_id)`` for every job that was never finished; returns their number."""
    jobs = ledger.unfinished().select("job_id").orderBy(F.col("job_id")).toLocalIterator()
    return sum(1 for row in jobs if start(row.job_id) or True)
