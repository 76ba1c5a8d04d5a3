"""Facial, head and eye measures from framewise tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import series as S
from ..operators import stats as A


def facial_displacement(frames: DataFrame, by: list[str], frame: str, regions: dict[str, list[int]], size: int, normalise: dict | None = None) -> DataFrame:
    """Frames with the displacement of each landmark and its mean over regions; ``overall`` and ``upper_face`` (what ``lower_face`` leaves) besides."""
    points = frames.withColumn("landmarks", V.normalised_face(F.col("landmarks"), **normalise)) if normalise is not None else frames
    moved = S.with_landmark_displacement(points, by, [frame])
    d, low = F.col("displacement"), regions.get("lower_face", [])
    parts = {"overall": list(range(size)), **regions, "upper_face": [i for i in range(size) if i not in set(low)]}
    return moved.withColumns({name: A.region_mean(d, index) for name, index in parts.items()})


def facial_summary(displaced: DataFrame, by: list[str], columns: list[str], skip: int = 0) -> DataFrame:
    """Mean and deviation of the measures, rescaled to single frames where ``skip`` frames were left out between sampled ones."""
    return A.rescaled_for_skip(A.summary(displaced, by, columns), skip)


def box_centres(frames: DataFrame) -> DataFrame:
    """Centres of boxes: means of the corners that are known."""
    mean = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) + F.col(b)) / 2).otherwise(F.coalesce(a, b))
    return frames.withColumns({"bb_center_x": mean("bb_x1", "bb_x2"), "bb_center_y": mean("bb_y1", "bb_y2")})


def head_movement(frames: DataFrame, by: list[str], frame: str, by_width: bool = False, order: str = "XYZ") -> DataFrame:
    """Frames with ``xy_disp`` of the box centre since the last frame that has one, and the change of the whole rotation angle.

    The first frame with a centre has the displacement 0; a recording with fewer than two has none.
    """
    centred = box_centres(frames)
    known = F.col("bb_center_x").isNotNull() & F.col("bb_center_y").isNotNull()
    seen = centred.where(known)
    w = S.in_order(by, [frame])
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = V.distance2(F.col("bb_center_x"), F.col("bb_center_y"), F.lag("bb_center_x").over(w), F.lag("bb_center_y").over(w))
    moved = seen.select(*by, frame, F.when(n > 1, F.coalesce(step, F.lit(0.0)) / (F.nullif(F.abs(F.col("bb_x2") - F.col("bb_x1")), F.lit(0.0)) if by_width else F.lit(1.0))).alias("xy_disp"))
    turned = centred.withColumn("euclidean_angle", V.rotation_angle(F.col("pitch"), F.col("yaw"), F.col("roll"), order))
    turns = S.with_step(turned.where("euclidean_angle is not null"), by, [frame], "euclidean_angle", "euclidean_angle_disp").select(*by, frame, "euclidean_angle_disp")
    return turned.join(moved, [*by, frame], "left").join(turns, [*by, frame], "left")


HEAD = ["xy_disp", "pitch", "yaw", "roll", "euclidean_angle_disp"]


def head_summary(moved: DataFrame, by: list[str], frame: str) -> DataFrame:
    return A.summary(A.in_sequence(moved, by, [frame]), by, HEAD)


def blink_times(blinks: DataFrame, fps: Column) -> DataFrame:
    """Frames of blinks as seconds besides."""
    return blinks.withColumns({f"blink_{k}_time": F.col(f"blink_{k}_frame") / fps for k in ("peak", "starting", "ending")})


def blink_summary(recordings: DataFrame, blinks: DataFrame, by: list[str], n_frames: str = "n_frames", fps: str = "fps") -> DataFrame:
    """Blinks and blinks a minute of every recording, 0 where it has none."""
    n = blinks.groupBy(*by).agg(F.count("*").alias("blinks"))
    got = recordings.join(n, by, "left").withColumn("blinks", F.coalesce("blinks", F.lit(0)))
    return got.select(*by, "blinks", (F.col("blinks") / (F.col(n_frames) / F.col(fps)) * 60).alias("blink_rate"))


def with_probability(frames: DataFrame, probabilities: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Frames with their speaking probability, null where there is none."""
    return frames.join(probabilities.select(*by, frame, "probability"), [*by, frame], "left")


def summary_against_baseline(frames: DataFrame, base: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Summary of ratios to the means of another recording, the baseline of each."""
    means = base.groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    ratio = frames.join(means, by).withColumns({c: (F.col(c) + 1) / F.nullif(F.col(f"_{c}") + 1, F.lit(0.0)) - 1 for c in columns})
    return A.summary(ratio, by, columns)


def facial_expressivity(frames: DataFrame, by: list[str], frame: str, regions: dict[str, list[int]], size: int = 468, base: DataFrame | None = None, normalise: dict | None = None, skip: int = 0, probability: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(displacement, summary) of landmark frames that have ``mouth_openness``.

    With a baseline, of the same recordings, displacements are ratios to its
    means; with a speaking probability the summary is split by it.
    """
    moved = facial_displacement(frames, by, frame, regions, size, normalise)
    columns = ["overall", *regions, *([] if "upper_face" in regions else ["upper_face"])]
    if base is not None:
        means = facial_displacement(base, by, frame, regions, size, normalise).groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
        moved = moved.join(means, by, "left").withColumns({c: (F.col(c) + 1) / F.nullif(F.col(f"_{c}") + 1, F.lit(0.0)) - 1 for c in columns}).drop(*[f"_{c}" for c in columns])
    measured = [*columns, "mouth_openness"]
    if probability is not None:
        return moved, A.rescaled_for_skip(A.speaking_split(moved, by, probability, measured), skip)
    return moved, facial_summary(moved, by, measured, skip)


def emotional_expressivity(frames: DataFrame, by: list[str], columns: list[str], base: DataFrame | None = None, probability: str | None = None) -> DataFrame:
    """Summary of emotion scores and action units, as ratios to a baseline's means where there is one, split by speaking where asked for."""
    if base is not None:
        return summary_against_baseline(frames, base, by, columns)
    return A.summary(frames, by, columns) if probability is None else A.speaking_split(frames, by, probability, columns)
