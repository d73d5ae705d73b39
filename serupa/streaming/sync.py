"""Keep the index current from a change feed."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from serupa import schemas
from serupa.config import DEFAULTS, Settings
from serupa.operators import corpus
from serupa.operators.encode import Encoder
from serupa.operators.index import IndexTable, index_rows
from serupa.operators.ingest import delete_key, ingest, last_per_key
from serupa.operators.ledger import JobLedger
from serupa.session import stage

log = logging.getLogger(__name__)


class SyncStream:
    """Applies batches of changes: ``op`` (upsert or delete), ``event_time`` and document columns.

    Within a batch the newest event per document wins; of equal times the higher ``sequence`` (0 if the feed has
    none), then the later title. A change older than one that was applied before is ignored, deletes included,
    so late data cannot undo newer data; one of the same time and sequence is applied. The applied times are kept
    beside the index, one small table per batch, folded together with the index. Rejected rows are written to
    the index's quarantine.

    After ``squash_every`` batches the changes are folded into one commit. Once they exceed a tenth of
    the index, a new full index is written, so that its cost is spread over that many changes.
    """

    SOURCE, FOLDED = "stream/", "times/"

    def __init__(self, index: IndexTable, encoder: Encoder, ledger: JobLedger | None = None,
                 settings: Settings = DEFAULTS, squash_every: int = 50, compact_share: float = 0.1) -> None:
        self.index, self.encoder, self.ledger = index, encoder, ledger
        self.settings, self.squash_every, self.compact_share = settings, squash_every, compact_share
        self.words: list[str] = []
        self.refresh_stopwords()

    def refresh_stopwords(self) -> None:
        """Recompute the dynamic stopwords; a failure keeps the old ones and never fails a load."""
        try:
            current = corpus.dynamic_stopwords(corpus.titles(self.index.read()), settings=self.settings)
            self.words = corpus.inline_words(current)
        except Exception:
            log.exception("dynamic stopwords not refreshed")

    def _seen(self) -> DataFrame | None:
        """``id, event_time`` of all changes applied so far."""
        paths: list[str] = []
        for c in self.index.commits():
            source = c.source or ""
            if source.startswith(self.FOLDED):
                paths = [f"{self.index.path}/{source}"]
            elif source.startswith(self.SOURCE):
                paths.append(f"{self.index.path}/times/{source}")
        return self.index.spark.read.parquet(*paths) if paths else None

    def _newer(self, changes: DataFrame, rows: int) -> DataFrame:
        """Drop changes that are not newer than the last one applied to their id."""
        seen = self._seen()
        if seen is None:
            return changes
        if rows <= self.settings.broadcast_rows:  # few changes: cut the history down to them without a shuffle
            seen = seen.join(F.broadcast(changes.select("id")), "id", "left_semi")
        last = seen.groupBy("id").agg(F.max(F.struct("event_time", "sequence")).alias("_seen"))
        joined = changes.join(last, "id", "left")
        return joined.where(F.col("_seen").isNull() | (F.struct("event_time", "sequence") >= F.col("_seen"))).drop("_seen")

    def _fold(self) -> None:
        size, changed, commits = self.index.pending()
        large = changed > self.compact_share * size
        if commits < self.squash_every and not (large and size):
            return
        folded = f"{self.FOLDED}folded/{self.index.commits()[-1].commit + 1}"
        last = self._seen().groupBy("id").agg(F.max(F.struct("event_time", "sequence")).alias("t")).select("id", "t.*")
        last.write.mode("overwrite").parquet(f"{self.index.path}/{folded}")
        (self.index.compact if large else self.index.squash)(folded)

    def apply(self, batch: DataFrame, batch_id: int, name: str = "sync") -> None:
        """One micro-batch; applying the same batch again does nothing."""
        source = f"{self.SOURCE}{name}/{batch_id}"
        if self.index.contains_source(source) or batch.isEmpty():
            return
        feed = stage(batch, "feed")
        received = feed.count()
        if self.ledger:
            self.ledger.create(source, received)
            self.ledger.mark_processing(source)
        try:
            self._apply(feed, received, source)
        except Exception as error:
            if self.ledger:
                self.ledger.mark_failed(source, str(error))
            raise
        if self.ledger:
            self.ledger.mark_completed(source)

    def _apply(self, feed: DataFrame, received: int, source: str) -> None:
        if "sequence" not in feed.columns:
            feed = feed.withColumn("sequence", F.lit(0))
        feed = feed.withColumn("sequence", F.col("sequence").cast("bigint"))
        saves, rejected = ingest(feed.where("op <> 'delete'"), self.settings)
        self.index.reject(rejected, source)
        saves = saves.withColumn("id", F.col("document_id"))
        drops = feed.where("op = 'delete'").withColumn("id", delete_key(F.col("document_id"), self.settings))
        both = saves.unionByName(drops, allowMissingColumns=True)
        latest = stage(self._newer(last_per_key(both, "id", "event_time", "sequence", "judul"), received), "changes")
        saved = latest.where("op <> 'delete'")
        rows = index_rows(saved.drop("id"), self.encoder, self.words, self.settings).select(*schemas.INDEX.names)
        latest.select("id", "event_time", "sequence").write.mode("overwrite").parquet(f"{self.index.path}/times/{source}")
        self.index.change(rows, latest.where("op = 'delete'").select("id"), source)
        self._fold()
        if not saved.isEmpty():  # deletes alone keep the stopwords
            self.refresh_stopwords()

    def start(self, feed: DataFrame, checkpoint: str, name: str = "sync", **trigger) -> StreamingQuery:
        """Run on a streaming feed. The checkpoint replays an unfinished batch under its number."""
        return (
            feed.writeStream.foreachBatch(lambda batch, batch_id: self.apply(batch, batch_id, name))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def run_available(start: Callable[[], StreamingQuery]) -> None:
    """Process what is there and wait for the end."""
    query = start()
    query.awaitTermination()
