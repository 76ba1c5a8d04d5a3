"""Location measures by hour and day of local time, and of the whole recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import stats as A

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Measures with mean and deviation in the summary.
MEASURES = ["move_time", "pause_time", "dist_travelled", "home_time", "home_max_dist", "home_mean_dist"]


def local_micros(at: Column, zone: str) -> Column:
    """Local wall-clock microseconds of a time in microseconds UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MICROSECOND", at, epoch))
    return F.timestamp_diff("MICROSECOND", epoch, local)


def night(at: Column) -> Column:
    return ~F.pmod(F.floor(at / F.lit(float(HOUR))), F.lit(24)).between(8, 19)


def home_location(segments: DataFrame, by: list[str], cell: float = 0.01) -> DataFrame:
    """(by, hlat, hlon): the centre of the cell with the longest observed rest that begins at night (local t0, t1); of equal ones the southernmost, westernmost."""
    rest = segments.where((F.col("status") == 2) & F.col("observed") & night(F.col("t0")))
    cells = rest.groupBy(*by, F.floor(F.col("lat0") / cell).alias("_a"), F.floor(F.col("lon0") / cell).alias("_o")).agg(F.sum(F.col("t1") - F.col("t0")).alias("_us"))
    best = cells.groupBy(*by).agg(F.min_by(F.struct("_a", "_o"), F.struct(-F.col("_us"), F.col("_a"), F.col("_o"))).alias("_h"))
    return best.select(*by, ((F.col("_h._a") + 0.5) * cell).alias("hlat"), ((F.col("_h._o") + 0.5) * cell).alias("hlon"))


def window_table(segments: DataFrame, home: DataFrame, by: list[str], width: int) -> DataFrame:
    """The measures of each window of local time between a recording's first and last; windows without data are rows of nulls."""
    p = I.split_by_window(segments.join(home, by, "left"), "t0", "t1", width)
    at = lambda a, b, share: F.col(a) + (F.col(b) - F.col(a)) * F.col(share)
    p = p.withColumns({"la": at("lat0", "lat1", "share_start"), "lo": at("lon0", "lon1", "share_start"), "lb": at("lat0", "lat1", "share_end"), "lp": at("lon0", "lon1", "share_end")})
    gc = lambda a, b, c, d: I.great_circle(F.col(a), F.col(b), F.col(c), F.col(d))
    p = p.withColumns({"metres": gc("la", "lo", "lb", "lp"), "h0": gc("la", "lo", "hlat", "hlon"), "h1": gc("lb", "lp", "hlat", "hlon"), "hrs": (F.col("clip_end") - F.col("clip_start")) / F.lit(float(HOUR))})
    dark = night((F.col("clip_start") + F.col("clip_end")) / 2)
    seen = F.when(F.col("observed"), F.col("hrs")).otherwise(0.0)
    got = p.groupBy(*by, "window_start").agg(
        F.sum(seen).alias("observed_time"), F.sum(F.when(~dark, seen).otherwise(0.0)).alias("observed_time_day"), F.sum(F.when(dark, seen).otherwise(0.0)).alias("observed_time_night"),
        F.sum(F.when(F.col("status") == 1, F.col("hrs")).otherwise(0.0)).alias("move_time"), F.sum(F.when(F.col("status") == 2, F.col("hrs")).otherwise(0.0)).alias("pause_time"),
        (F.sum(F.bround("metres")) / 1000).alias("dist_travelled"), F.sum(F.when((F.col("h0") + F.col("h1")) / 2 <= 50, F.col("hrs")).otherwise(0.0)).alias("home_time"),
        (F.greatest(F.max("h0"), F.max("h1")) / 1000).alias("home_max_dist"), ((F.sum("h0") + F.sum("h1")) / (2 * F.count("h0")) / 1000).alias("home_mean_dist"),
    )
    form = "yyyy-MM-dd" if width == DAY else "yyyy-MM-dd HH:00:00"
    got = I.with_empty_windows(got, by, width)
    return got.withColumn("datetime", F.date_format(F.timestamp_add("MICROSECOND", F.col("window_start"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), form))


def gps_analysis(segments: DataFrame, by: list[str], zone: str = "UTC") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hourly, daily, summary) of trajectories: status (1 moving, 2 at rest), t0 and t1 in microseconds UTC, lat0, lon0, lat1, lon1, observed."""
    local = segments.withColumns({"t0": local_micros(F.col("t0"), zone), "t1": local_micros(F.col("t1"), zone)})
    home = home_location(local, by)
    hourly, daily = window_table(local, home, by, HOUR), window_table(local, home, by, DAY)
    names = ["datetime", "observed_time", "move_time", "pause_time", "dist_travelled", "home_time", "home_max_dist", "home_mean_dist"]
    daily = daily.select(*by, "datetime", "observed_time", "observed_time_day", "observed_time_night", *names[2:])
    return hourly.select(*by, *names), daily, A.day_summary(daily, by, MEASURES)


def stops(points: DataFrame, by: list[str], order: list[str], metres: float = 50.0) -> DataFrame:
    """Segments between points in order: at rest (2) within ``metres`` of the point before, else moving (1)."""
    from ..operators.series import in_order

    w = in_order(by, order)
    ahead = points.select("*", *[F.lead(c).over(w).alias(f"{c}1") for c in ("t", "lat", "lon")]).where("t1 > t")
    far = I.great_circle(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")) > metres
    return ahead.select(*by, *[c for c in order if c != "t"], F.when(far, 1).otherwise(2).alias("status"), F.col("t").alias("t0"), "t1", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "lat1", "lon1")
