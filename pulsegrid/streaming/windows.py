"""Structured Streaming twins: hourly windows, sessions of presence, duplicates within a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream with event time."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    # a stream reads folders or patterns; a pattern that matches only the file itself leaves the files beside it out
    one = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def hourly_counts(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values by user and hour; values are kept with their ids and summed in that order, in whatever order they come."""
    s = event_stream(spark, path).withWatermark("at", delay)
    values = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))).alias("x")
    got = s.groupBy("user_id", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), values)
    total = F.when(F.size("x") > 0, F.aggregate(F.array_sort("x"), F.lit(0.0), lambda s, p: s + p["value"]))
    return got.select("user_id", F.col("w.start").alias("hour"), "n", total.alias("total"))


def presence_sessions(spark: SparkSession, path: str, gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    s = event_stream(spark, path).withWatermark("at", delay)
    return s.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def distinct_events(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    return event_stream(spark, path).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, folder: str | None = None, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available and read its result table.

    The mode "complete" is for aggregates and has the windows still open at the
    end; streams without an aggregate need "append".
    """
    spark = stream.sparkSession
    base = folder or shared_folder(spark)
    base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        written.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{max(written)}") if written else spark.createDataFrame([], stream.schema)
