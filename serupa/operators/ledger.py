"""Job ledger: every state change appends a full row; the latest row of a job is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa import schemas
from serupa.config import DEFAULTS, Settings

UNFINISHED = ("pending", "processing")
BUCKETS = 64  # folders of a ledger


def clip_error(message: Column, settings: Settings = DEFAULTS) -> Column:
    return F.substring(message, 1, settings.job_error_max_chars)


def latest_states(rows: DataFrame, *order: str) -> DataFrame:
    """Latest row per job by the order columns (max_by combines map-side, so a busy job is no hot spot)."""
    state = [c for c in rows.columns if c != "job_id"]
    newest = F.max_by(F.struct(*state), F.struct(*order)).alias("s")
    return rows.groupBy("job_id").agg(newest).select("job_id", *[F.col("s")[c].alias(c) for c in state])


def unfinished(states: DataFrame) -> DataFrame:
    return states.where(F.col("status").isin(*UNFINISHED))


def _bucket(job_id: Column) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(BUCKETS)).cast("int")


class JobLedger:
    """Ledger of index jobs in a folder; one small file per state change, written by the job's driver.

    Files lie in folders by a hash of the job id, so a job's lookup and changes read the files of one folder.
    """

    SCHEMA = T.StructType([*schemas.JOB.fields, T.StructField("seq", T.LongType())])

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.path, self.settings = spark, path, settings

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).json(self.path)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def rows_of(self, job_id: str) -> DataFrame:
        job = F.lit(job_id)
        return self._stored().where((F.col("bucket") == _bucket(job)) & (F.col("job_id") == job)).drop("bucket")

    def states(self) -> DataFrame:
        return latest_states(self.rows(), "seq").drop("seq")

    def find(self, job_id: str) -> DataFrame:
        return latest_states(self.rows_of(job_id), "seq").drop("seq")

    def unfinished(self) -> DataFrame:
        return unfinished(self.states())

    def _append(self, row: DataFrame) -> None:
        typed = row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.SCHEMA.fields])
        typed.withColumn("bucket", _bucket(F.col("job_id"))).coalesce(1).write.mode("append").partitionBy("bucket").json(self.path)

    def create(self, job_id: str, total_received: int) -> None:
        one = self.spark.range(1)
        self._append(
            one.select(
                F.lit(job_id).alias("job_id"), F.lit("pending").alias("status"),
                F.lit(total_received).alias("total_received"), F.lit(0).alias("total_processed"), F.lit(0).alias("rejected"),
                F.lit(None).alias("error_message"), F.current_timestamp().alias("created_at"),
                F.lit(None).alias("started_at"), F.lit(None).alias("completed_at"), F.lit(0).alias("seq"),
            )
        )

    def _change(self, job_id: str, **columns: Column) -> None:
        now = latest_states(self.rows_of(job_id), "seq")
        self._append(now.withColumns({**columns, "seq": F.col("seq") + 1}))

    def mark_processing(self, job_id: str) -> None:
        none = F.lit(None)
        self._change(
            job_id, status=F.lit("processing"), total_processed=F.lit(0), error_message=none,
            started_at=F.current_timestamp(), completed_at=none,
        )

    def update_progress(self, job_id: str, processed: int, rejected: int = 0) -> None:
        self._change(job_id, total_processed=F.lit(processed), rejected=F.lit(rejected))

    def mark_completed(self, job_id: str) -> None:
        """All received rows were processed, but for the rejected ones."""
        self._change(
            job_id, status=F.lit("completed"), total_processed=F.col("total_received") - F.coalesce("rejected", F.lit(0)),
            error_message=F.lit(None), completed_at=F.current_timestamp(),
        )

    def mark_failed(self, job_id: str, message: str) -> None:
        self._change(
            job_id, status=F.lit("failed"), error_message=clip_error(F.lit(message), self.settings),
            completed_at=F.current_timestamp(),
        )
