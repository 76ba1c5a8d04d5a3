"""Voice measures: summaries of framewise tables, spectral measures of samples, phonations by sound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import series as S
from ..operators import stats as A

FRAMEWISE = ["f0", "f1", "f2", "f3", "f4", "loudness", "hnr"]


def vocal_summary(frames: DataFrame, silence: DataFrame, by: list[str], frame: str = "frame_idx", voiced: bool = True, rate: int = 100) -> DataFrame:
    """One row a recording: summaries of the framewise columns over speech (or all frames), relative deviations, moments, unvoiced share, pauses.

    ``silence``: pause_start, pause_end, pause_duration in seconds.
    """
    columns = [c for c in FRAMEWISE if c in frames.columns]
    size = frames.groupBy(*by).agg(F.count("*").alias("n_frames"), A.unvoiced_share(F.col("f0")).alias("silence_ratio"))
    speech = S.speech_runs(silence, size, by, "pause_start", "pause_end", rate=rate).withColumnRenamed("frame_idx", frame)
    spoken = A.in_sequence(frames.join(speech, [*by, frame], "left_semi"), by, [frame])
    own = spoken if voiced else A.in_sequence(frames, by, [frame])
    ratio = lambda c: F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0))
    relative = spoken.groupBy(*by).agg(ratio("f0").alias("rel_f0_sd"), ratio("loudness").alias("rel_se0_sd"))
    pauses = A.silence_summary(silence.join(size.select(*by, (F.col("n_frames") / rate).alias("_s")), by), by, "pause_duration", F.first("_s"))
    parts = [A.nonzero_summary(own, by, columns), relative, A.moments(own, by, "f0").withColumnsRenamed({"skewness": "f0_skewness", "kurtosis": "f0_kurtosis"}), pauses.withColumnsRenamed({"median": "dur_med", "mad": "dur_mad"})]
    out = size.drop("n_frames")
    for p in parts:
        out = out.join(p, by, "left")
    return out


def _moments(x: np.ndarray) -> list[float | None]:
    """Mean, population variance, excess kurtosis and skewness."""
    if not len(x):
        return [None] * 4
    d, var = x - x.mean(), x.var()
    return [float(x.mean()), float(var), float((d**4).mean() / var**2 - 3) if var else None, float((d**3).mean() / var**1.5) if var else None]


def spectral_measures(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``clips`` with moments of cepstral peak prominence and of the ratio of low to high frequencies."""
    names = [f"{k}_{m}" for k in ("cpp", "lhr") for m in ("mean", "var", "kurtosis", "skewness")]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def measured(x: pd.Series, hz: pd.Series) -> pd.DataFrame:
        rows = []
        for a, h in zip(x, hz, strict=True):
            a = np.asarray(a, float)
            rows.append(_moments(N.cepstral_peak(a, int(h))) + _moments(N.low_high_ratio(a, int(h))))
        return pd.DataFrame(rows, columns=names, dtype=float)

    return clips.withColumn("_m", measured(samples, rate)).select(*clips.columns, *[F.col(f"_m.{n}").alias(n) for n in names])


def articulation(channels: Column) -> Column:
    """struct<acf1, acf2, acf3>: mean eigenvalues of three bands of the smoothed channels' time-delay correlations."""

    @F.pandas_udf("acf1 double, acf2 double, acf3 double")
    def bands(x: pd.Series) -> pd.DataFrame:
        rows = [N.coordination(np.vstack([N.kalman(np.asarray(c, float)) for c in one])) for one in x]
        return pd.DataFrame(rows, columns=["acf1", "acf2", "acf3"])

    return bands(channels)


def phonation_summary(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Means of the acoustic measures over the phonations of each sound, without measures of pauses."""
    from ..sources.transcripts import phonation_measures

    return A.mean_of_files(phonation_measures(summaries), [*by, "phonation_type"])
