"""The vector index as a table: keyed upsert, delete, replace, reconciliation.

A commit appends its rows as one Parquet folder and then one small commit record; only recorded rows
exist for readers, so a failed load stays invisible. ``replace`` and ``compact`` commits hold a full
index, partitioned by document type. ``merge`` and ``delete`` commits hold just the changed rows: a
change costs what the change is large. A read is the last full index without the changed ids, plus
their latest rows. ``squash`` commits fold the changes so far into one folder.

Each writer has a folder of its own, named by its record, and claims its commit number with the record. Of
several writers at once one succeeds; the others fail with ``ConcurrentCommit`` and change nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa import schemas
from serupa.config import DEFAULTS, Settings
from serupa.operators.encode import Encoder, encode_documents
from serupa.operators.ingest import delete_key, last_per_key, metadata

_FULL = ("replace", "compact")
# Messages of an inconsistent load, after a replace and after a merge.
LOAD_ERRORS = {
    True: "Jumlah vector hasil reindex tidak konsisten (expected=%d, vector=%d).",
    False: "Jumlah vector terindeks lebih kecil dari data yang diterima (received=%d, vector=%d).",
}
_ROWS = T.StructType([*schemas.INDEX.fields, T.StructField("op", T.StringType())])
_COMMIT = schemas.schema_of(
    "commit BIGINT, folder STRING, kind STRING, source STRING, changed BIGINT, expected BIGINT, total BIGINT, at TIMESTAMP"
)


class InconsistentIndex(RuntimeError):
    """The index would not hold what a load should have left in it."""


class EmptyInput(ValueError):
    """A load without rows."""


class ConcurrentCommit(RuntimeError):
    """Another writer made the commit that this one prepared; its rows stay invisible."""


def index_rows(
    docs: DataFrame, encoder: Encoder, dynamic=(), settings: Settings = DEFAULTS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Valid documents as index rows: vector, metadata and the title as stored text."""
    encoded = encode_documents(docs, encoder, dynamic, settings)
    return metadata(encoded, settings, ("embedding", *carry)).select(
        F.col("document_id").alias("id"), "embedding", F.col("judul").alias("document"), *schemas.METADATA, *carry
    )


def last_documents(docs: DataFrame) -> DataFrame:
    """Valid documents without those that a load would drop: the last of each id by ``position``, then by title.

    For use before ``index_rows``: rows without vectors are narrow to sort, and only what is kept is encoded.
    """
    return last_per_key(docs, "document_id", "position", "judul") if "position" in docs.columns else docs


def page_of_ids(index: DataFrame, limit: int = 500, offset: int = 0, after: str | None = None) -> DataFrame:
    """One page of ids in order. ``after``, the last id of the page before, costs the same on every page;
    ``offset`` sorts all rows before it as well."""
    ids = index.select("id") if after is None else index.select("id").where(F.col("id") > after)
    return ids.orderBy("id").offset(offset).limit(limit)


def reconcile(received: DataFrame, index: DataFrame, replace: bool, key: str = "document_id") -> DataFrame:
    """One row: distinct received ids, index size, ``status`` and ``error_message`` of the load."""
    expected = received.select(F.countDistinct(key)).scalar()
    totals = index.agg(F.count("*").alias("total_indexed")).withColumn("expected_total", expected)
    e, t = F.col("expected_total"), F.col("total_indexed")
    message = load_error(e, t, replace)
    return totals.select(
        "expected_total",
        "total_indexed",
        F.when(message.isNull(), "completed").otherwise("failed").alias("status"),
        message.alias("error_message"),
    )


def load_error(expected, total, replace: bool):
    """Message when the index size contradicts the load: equality after a replace, at least as many after a merge."""
    bad = total != expected if replace else total < expected
    return F.when(bad, F.format_string(LOAD_ERRORS[replace], expected, total))


def _load_error(expected: int, total: int, replace: bool) -> str:
    return LOAD_ERRORS[replace] % (expected, total)


@dataclass
class IndexTable:
    spark: SparkSession
    path: str
    settings: Settings = DEFAULTS

    def commits(self) -> list:
        """All commit records; there are as many as loads, each a few bytes. Of two writers that claimed a number
        at once, the one with the smaller folder name has it."""
        try:
            records = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").select(*_COMMIT.names)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        found = {c.commit: c for c in records.orderBy(F.desc("commit"), F.desc("folder")).collect()}
        return [found[n] for n in sorted(found)]

    def _record(self, number: int, folder: str, *rest) -> None:
        """Claim the number for the rows in ``folder``; fails if another writer has it."""
        record = self.spark.createDataFrame([(number, folder, *rest, datetime.now(timezone.utc))], _COMMIT)
        try:
            record.coalesce(1).write.mode("error").json(f"{self.path}/commits/number={number}")
        except Exception as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            raise ConcurrentCommit(f"commit {number} was made by another writer; load again") from error
        if self.commits()[-1].folder != folder:
            raise ConcurrentCommit(f"commit {number} was made by another writer; load again")

    def _read(self, commits: list) -> DataFrame:
        paths = [f"{self.path}/rows/{c.folder}" for c in commits]
        return self.spark.read.schema(_ROWS).option("basePath", f"{self.path}/rows").parquet(*paths).select(
            *_ROWS.names, F.col("commit").cast("bigint").alias("commit")
        )

    def _current(self) -> tuple[list, list]:
        """The commit of the last full index, if any, and the commits with all changes since."""
        full, later = [], []
        for c in self.commits():
            if c.kind in _FULL:
                full, later = [c], []
            elif c.kind == "squash":
                later = [c]
            else:
                later.append(c)
        return full, later

    def pending(self) -> tuple[int, int, int]:
        """Size of the last full index, rows changed since, and in how many commits."""
        full, later = self._current()
        return full[0].total if full else 0, sum(c.changed for c in later), len(later)

    def _changes(self, later: list) -> DataFrame:
        return last_per_key(self._read(later), "id", "commit")

    def read(self) -> DataFrame:
        """The current index."""
        full, later = self._current()
        base = self._read(full).select(*schemas.INDEX.names) if full else None
        if not later:
            return base if full else self.spark.createDataFrame([], schemas.INDEX)
        changes = self._changes(later)
        kept = changes.where("op = 'upsert'").select(*schemas.INDEX.names)
        if not full:
            return kept
        changed = self._small(self._read(later).select("id"), sum(c.changed for c in later))
        return base.join(changed, "id", "left_anti").unionByName(kept)

    def _small(self, ids: DataFrame, rows: int) -> DataFrame:
        """Broadcast the changed ids while they are few; otherwise the join shuffles."""
        return F.broadcast(ids) if rows <= self.settings.broadcast_rows else ids

    def count(self) -> int:
        return self.read().count()

    def contains_source(self, source: str) -> bool:
        return any(c.source == source for c in self.commits())

    def _commit(self, rows: DataFrame, kind: str, source: str | None, allow_empty: bool = False, expected: int | None = None) -> int:
        """Write rows, check the index they would give as read back, then record the commit.

        ``expected``: how many different ids were received; the written rows must hold as many.
        """
        commits = self.commits()
        number = commits[-1].commit + 1 if commits else 1
        folder = f"commit={number}/part=w{uuid.uuid4().hex}"  # of this writer alone
        writer = rows.select(*_ROWS.names).write
        (writer.partitionBy("document_type") if kind in _FULL else writer).parquet(f"{self.path}/rows/{folder}")
        written = self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows/{folder}")
        saved = F.when(F.col("op") == "upsert", F.col("id"))
        changed, saves, distinct = written.agg(F.count("*"), F.count(saved), F.countDistinct(saved)).first()
        if not changed and not allow_empty:
            raise EmptyInput("nothing to load")
        if kind == "squash":
            total = commits[-1].total
        elif kind in _FULL or not commits:
            total = saves
        else:
            total = saves + self.read().join(self._small(written.select("id"), changed), "id", "left_anti").count()
        wanted = distinct if expected is None else expected
        if kind != "squash" and (saves != distinct or distinct != wanted or (total != wanted if kind in _FULL else total < wanted)):
            raise InconsistentIndex(_load_error(wanted, total if kind in _FULL else min(total, distinct), kind in _FULL))
        self._record(number, folder, kind, source, changed, distinct, total)
        return total

    def reject(self, rows: DataFrame, source: str) -> int:
        """Write the rejected rows of a load below ``quarantine`` (a repeated load replaces them); how many they are."""
        path = f"{self.path}/quarantine/{source}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).count()

    def replace(self, rows: DataFrame, source: str | None = None, expected: int | None = None) -> int:
        """Reset the index to exactly these rows (the last one of an id by ``position``)."""
        return self._commit(self._latest(rows).withColumn("op", F.lit("upsert")), "replace", source, expected=expected)

    def upsert(self, rows: DataFrame, source: str | None = None, expected: int | None = None) -> int:
        """Merge rows by id (the last one of an id by ``position``)."""
        return self._commit(self._latest(rows).withColumn("op", F.lit("upsert")), "merge", source, expected=expected)

    def delete(self, keys: DataFrame, source: str | None = None) -> int:
        """Delete by key; idempotent."""
        ids = keys.select(delete_key(F.col("key"), self.settings).alias("id")).distinct()
        return self._commit(_deletes(ids), "delete", source, allow_empty=True)

    def change(self, upserts: DataFrame, deleted_ids: DataFrame, source: str | None = None) -> int:
        """One commit with upserts and deletes of different ids."""
        rows = upserts.withColumn("op", F.lit("upsert")).unionByName(_deletes(deleted_ids))
        return self._commit(rows, "merge", source, allow_empty=True)

    def squash(self, source: str | None = None) -> int:
        """Fold all change commits since the last full index into one."""
        _, later = self._current()
        return self._commit(self._changes(later), "squash", source, allow_empty=True)

    def compact(self, source: str | None = None) -> int:
        """Fold all changes into a new full index."""
        return self._commit(self.read().withColumn("op", F.lit("upsert")), "compact", source, allow_empty=True)

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """The last row of each id: by ``position``, equal ones by title. Without that column ids must be unique;
        repeated ids then fail the check of the commit instead of giving an arbitrary row."""
        return last_per_key(rows, "id", "position", "document") if "position" in rows.columns else rows


def _deletes(ids: DataFrame) -> DataFrame:
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.INDEX.fields if f.name != "id"]
    return ids.select("id", *blank, F.lit("delete").alias("op"))
