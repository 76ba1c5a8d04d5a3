"""Storage that every executor and the driver can see, and other common helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of a query as soon as it has ended, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one is made only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        else:
            path = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Later queries read the files only, so the shuffles that made them go at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def discard(held: DataFrame) -> None:
    """Delete a ``stored`` table from which nothing is read any more."""
    spark = held.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(held.stored_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df`` (of files, their size), 0 where it has none.  Costs no job; a rough guide only."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 53 else 0
