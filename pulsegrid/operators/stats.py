"""Summaries of framewise tables.  Missing values are null and are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, as an integer of units 10^-digits: equal on every engine."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("long")


def present(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def in_sequence(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of a recording in one task and in order: what is summed next comes out the same however the table is cut.

    Sums of doubles depend on their order, and means that lie on a tie of the rounding show it.
    """
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column."""
    return df.groupBy(*by).agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def nonzero_summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, sample deviation and range, where zero too is missing."""
    x = lambda c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType))
    return df.groupBy(*by).agg(*[a for c in columns for a in (F.avg(x(c)).alias(f"{c}_mean"), F.stddev_samp(x(c)).alias(f"{c}_stddev"), (F.max(x(c)) - F.min(x(c))).alias(f"{c}_range"))])


def day_summary(days: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Over days: number, total observed time (null if any day's is), mean and population deviation of the measures."""
    total = F.when(F.count("observed_time") == F.count("*"), F.sum("observed_time"))
    return days.groupBy(*by).agg(F.count("*").alias("no_days"), total.alias("total_observed_time"), *[a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))])


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, and median absolute deviation from it."""
    med = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(med, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def silence_summary(silence: DataFrame, by: list[str], pause: str, duration: Column) -> DataFrame:
    """Pauses of 0.05 to 2 s per second of speech, with median and MAD of the pauses."""
    rate = silence.groupBy(*by).agg((F.count_if((F.col(pause) > 0.05) & (F.col(pause) < 2)) / F.nullif(duration - F.sum(pause), F.lit(0.0))).alias("spir"))
    return rate.join(mad(silence, by, pause), by)


def zscore(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / sample deviation, by an aggregate joined back: no group has to fit into one task."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.nullif(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    return df.join(m, by).withColumn(name, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))


def coefficient_of_variation(df: DataFrame, by: list[str], value: str, name: str = "cv") -> DataFrame:
    return df.groupBy(*by).agg((F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias(name))


def baseline_ratio(df: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """(x + 1) / (mean of the baseline + 1) - 1 for each column; one row of means is joined."""
    means = base.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(means))
    return out.withColumns({c: (F.col(c) + 1) / F.nullif(F.col(f"_{c}") + 1, F.lit(0.0)) - 1 for c in columns}).drop(*[f"_{c}" for c in columns])


def region_mean(values: Column, index: list[int]) -> Column:
    """Mean of the elements at the listed places, nulls skipped; a place listed twice counts twice."""
    picked = F.filter(F.transform(F.array(*map(F.lit, index)), lambda i: F.get(values, i)), lambda x: x.isNotNull())
    total = F.aggregate(picked, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(picked) > 0, total / F.size(picked))


def other_places(size: int, index: list[int]) -> Column:
    return F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.array(*map(F.lit, index)))


def unvoiced_share(value: Column) -> Column:
    """Per cent of rows that are not above zero (an aggregate)."""
    return 100 * (1 - F.count_if(value > 0) / F.count("*"))


def speaking_split(df: DataFrame, by: list[str], probability: str, columns: list[str]) -> DataFrame:
    """Mean and deviation while speaking (above 0.5) and not; rows without a probability are in neither."""
    p = F.col(probability)
    parts = {"speaking": p > 0.5, "not_speaking": p <= 0.5}
    return df.groupBy(*by).agg(*[a for n, cond in parts.items() for c in columns for a in (F.avg(F.when(cond, F.col(c))).alias(f"{c}_mean_{n}"), F.stddev_samp(F.when(cond, F.col(c))).alias(f"{c}_std_{n}"))])


def rescaled_for_skip(df: DataFrame, skip: int, exempt: str = "mouth_openness") -> DataFrame:
    """Means of displacements between sampled frames by frame: over k + 1, deviations over its root."""
    by = {c: F.col(c) / (skip + 1 if c.endswith("_mean") else (skip + 1) ** 0.5) for c in df.columns if c.endswith(("_mean", "_std")) and not c.startswith(exempt)}
    return df.withColumns(by)


def largest(x: Column, missing: float) -> Column:
    """Greatest value, where ``missing`` stands for none (an aggregate)."""
    return F.max(F.nullif(x, F.lit(missing)))


def mean_of_files(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Means of all numeric columns over files."""
    numeric = [f.name for f in summaries.schema if f.name not in by and f.dataType.typeName() in ("double", "float", "integer", "long")]
    return summaries.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def cepstral_moments(frames: DataFrame, by: list[str], vector: str, n: int = 14) -> DataFrame:
    """Mean and population variance of each coefficient, and the median absolute deviation of the second."""
    one = lambda i: F.get(vector, F.lit(i)).cast("double")
    got = frames.groupBy(*by).agg(*[a for i in range(n) for a in (F.avg(one(i)).alias(f"mfcc{i + 1}_mean"), F.var_pop(one(i)).alias(f"mfcc{i + 1}_var"))])
    return got.join(mad(frames.select(*by, one(1).alias("_second")), by, "_second").select(*by, F.col("mad").alias("spectral_variability")), by)


def first_person_sentiment(turns: DataFrame, by: list[str], share: str, pos: str, neg: str) -> DataFrame:
    """Means over turns of (100 - share) * pos, of share * neg, and of whichever belongs to the larger of pos and neg."""
    a, b = (100 - F.col(share)) * F.col(pos), F.col(share) * F.col(neg)
    return turns.groupBy(*by).agg(F.avg(a).alias("positive"), F.avg(b).alias("negative"), F.avg(F.when(F.col(pos) > F.col(neg), a).otherwise(b)).alias("overall"))


def labelled_speakers(scores: DataFrame, by: list[str], speaker: str, score: str) -> DataFrame:
    """The speaker with the highest score by a script is the clinician; of equal ones the smaller label."""
    return scores.groupBy(*by).agg(F.min_by(speaker, F.struct(-F.col(score), F.col(speaker))).alias("clinician"))


def slope(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "slope") -> DataFrame:
    """Least-squares slope over the places 0, 1, ... of the values that are not null."""
    from .series import in_order

    known = df.where(F.col(value).isNotNull()).withColumn("_x", F.row_number().over(in_order(by, order)) - 1)
    return known.groupBy(*by).agg(F.regr_slope(value, F.col("_x").cast("double")).alias(name))


def fps(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """int(1 / step) for the commonest step between frames; the smallest of equally common ones."""
    from .series import in_order

    steps = df.withColumn("_d", F.round(F.col(time) - F.lag(time).over(in_order(by, [time])), 6)).where("_d > 0")
    n = steps.groupBy(*by, "_d").count()
    return n.groupBy(*by).agg(F.min_by("_d", F.struct(-F.col("count"), F.col("_d"))).alias("_d")).select(*by, F.floor(1 / F.col("_d")).cast("int").alias("fps"))
