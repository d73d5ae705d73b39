"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made = threading.local()  # ``paths``: what was staged for the table that ``stage_alone`` builds


def build_session(master: str | None = None, name: str = "serupa", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session that was started without it."""
    sc = spark.sparkContext
    if getattr(sc, "_serupa_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='serupa-')}/serupa", "zip", here.parent, here.name)
    sc.addPyFile(archive)
    sc._serupa_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may go without it and gets a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="serupa-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/serupa/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder; all paths of an application share one folder."""
    return f"{_own_scratch(spark)}/{uuid.uuid4().hex}/{name}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application put below the scratch folder: for the end of a job, once its results are written."""
    _delete(spark, _own_scratch(spark))


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back: computed once, lineage cut, survives lost executors.

    The shuffle files of that write are deleted with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage the table that ``make`` builds, then delete what ``make`` staged for it; nothing else may read that."""
    outer, made = getattr(_made, "paths", None), []
    _made.paths = made
    try:
        table = make()
    finally:
        _made.paths = outer
    kept = stage(table, name)
    for path in made:
        _delete(spark, path.rpartition("/")[0])
    return kept


def spread(df: DataFrame, small_bytes: int = 1 << 30) -> DataFrame:
    """Give a small input a partition per core; anything larger keeps the partitions of its files."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(wanted) if size <= small_bytes and df.rdd.getNumPartitions() < wanted else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
