"""Interval joins and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containment_join(words: DataFrame, segments: DataFrame, by: list[str], bucket: int | None = None) -> DataFrame:
    """Words (start, end) inside segments (start_time, end_time) of the same recording.

    Words across a boundary are dropped and overlapping segments repeat a word.
    With ``bucket`` both sides are also keyed by buckets of that many units, so
    that one long recording is spread over many tasks.
    """
    inside = (F.col("start") >= F.col("start_time")) & (F.col("end") <= F.col("end_time"))
    if bucket is None:
        return words.join(segments, by).where(inside)
    w = words.withColumn("_bucket", F.floor(F.col("start") / bucket))
    s = segments.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    return w.join(s, [*by, "_bucket"]).where(inside).drop("_bucket")


def spread(points: DataFrame, by: list[str], rows: int = 100_000) -> DataFrame:
    """Points by recording, in enough partitions for about ``rows`` of them a task where the session's number gives a task more.

    A point may become many windows, and all of a task's windows are summed in its memory.
    """
    n = -(-points.count() // rows)
    return points.repartition(n, *by) if n > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) else points


def split_by_window(segments: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each window of ``width`` that a segment overlaps, with the clipped part: linear, no theta join.

    Adds window_start, clip_start, clip_end and the shares of the segment where
    the part begins and ends, by which other values can be interpolated.
    """
    ended = segments.where(F.col(end) > F.col(start))
    parts = ended.withColumn("_k", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))
    parts = parts.withColumn("window_start", F.col("_k") * width).drop("_k")
    parts = parts.withColumn("clip_start", F.greatest(start, "window_start")).withColumn("clip_end", F.least(F.col(end), F.col("window_start") + width))
    length = (F.col(end) - F.col(start)).cast("double")
    return parts.withColumn("share_start", (F.col("clip_start") - F.col(start)) / length).withColumn("share_end", (F.col("clip_end") - F.col(start)) / length)


def great_circle(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = 6.371e6) -> Column:
    """Metres between two points, by the haversine formula."""
    a, b = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def window_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    """Hours observed, moving and at rest, kilometres, and home measures of each window of clipped segments.

    ``parts``: window_start, clip_start, clip_end (microseconds), status (1
    moving, 2 at rest), metres of the part, home0 and home1 (metres from home
    at its ends).
    """
    hours = (F.col("clip_end") - F.col("clip_start")) / F.lit(3.6e9)
    home = (F.col("home0") + F.col("home1")) / 2
    return parts.groupBy(*by, "window_start").agg(
        F.sum(hours).alias("observed_time"), F.sum(F.when(F.col("status") == 1, hours).otherwise(0.0)).alias("move_time"), F.sum(F.when(F.col("status") == 2, hours).otherwise(0.0)).alias("pause_time"),
        (F.sum(F.bround("metres")) / 1000).alias("dist_travelled"), F.sum(F.when(home <= 50, hours).otherwise(0.0)).alias("home_time"),
        F.greatest(F.max("home0"), F.max("home1")).alias("home_max_dist"), ((F.sum("home0") + F.sum("home1")) / (2 * F.count("home0"))).alias("home_mean_dist"),
    )


def with_empty_windows(stats: DataFrame, by: list[str], width: int) -> DataFrame:
    """Adds a row of nulls for each window without data between a recording's first and last; no join, each row fills the gap after it."""
    after = F.lead("window_start").over(Window.partitionBy(*by).orderBy("window_start"))
    rows = stats.withColumn("_last", F.coalesce(after - F.lit(width), F.col("window_start")))
    rows = rows.withColumn("_at", F.explode(F.sequence(F.col("window_start"), F.col("_last"), F.lit(width).cast("long"))))
    held = F.col("_at") == F.col("window_start")
    measures = [c for c in stats.columns if c not in (*by, "window_start")]
    return rows.select(*by, F.col("_at").alias("window_start"), *[F.when(held, F.col(c)).alias(c) for c in measures])


def quality_gate(points: DataFrame, by: list[str], at: str, rows: int = 60, share: float = 0.05, width: int = 3_600_000_000) -> DataFrame:
    """Whether enough windows (hours), counted from a recording's first point, have more than ``rows`` points."""
    ends = points.groupBy(*by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    each = points.join(ends, by).groupBy(*by, F.expr(f"({at} - _first) div {width}").alias("window")).agg(F.count("*").alias("n"), F.max(F.expr(f"(_last - _first) div {width} + 1")).alias("span"))
    out = each.groupBy(*by).agg(F.count_if(F.col("n") > rows).alias("good"), F.max("span").alias("span"))
    return out.withColumn("passes", F.col("good") >= F.lit(share) * F.col("span"))


def is_day(at: Column, zone: str = "UTC") -> Column:
    """Whether a time (microseconds) falls into the local hours 8 to 19."""
    if zone == "UTC":
        return F.pmod(F.floor(at / F.lit(3.6e9)), F.lit(24)).between(8, 19)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MICROSECOND", at, epoch))).between(8, 19)


def in_range(lat: str, lon: str) -> Column:
    """Whether all points of a table have possible coordinates (an aggregate)."""
    return F.count_if((F.abs(lat) > 90) | (F.abs(lon) > 180)) == 0
