"""Operators over ordered series: one partition is one recording.

All windows of a recording share one partitioning and order, so chained calls
sort and shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a time stamp without zone, whatever the session's zone."""
    name = ts if isinstance(ts, str) else "ts"
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def with_pause(df: DataFrame, by: list[str], order: list[str], start: str = "start", end: str = "end", name: str = "pause") -> DataFrame:
    """Start less the end of the row before, over all speakers; the first row's is null."""
    return df.withColumn(name, F.col(start) - F.lag(end).over(in_order(by, order)))


def with_islands(df: DataFrame, by: list[str], order: list[str], label: str, name: str = "turn_id") -> DataFrame:
    """Numbers the runs of equal labels from 1 (gaps and islands)."""
    w = in_order(by, order)
    fresh = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def with_sessions(df: DataFrame, by: list[str], order: list[str], at: str, gap: float, name: str = "session_id") -> DataFrame:
    """Numbers stretches of presence: a new one starts where the step is larger than ``gap``."""
    w = in_order(by, order)
    fresh = F.when(F.col(at) - F.lag(at).over(w) <= F.lit(gap), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def combine_turns(df: DataFrame, by: list[str], order: list[str], label: str, text: str, start: str, end: str, confidence: str) -> DataFrame:
    """One row for each run of a speaker: first start, last end, mean confidence, joined text."""
    runs = with_islands(df, by, order, label)
    words = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return runs.groupBy(*by, "turn_id").agg(
        F.min(label).alias(label), F.min(start).alias(start), F.max(end).alias(end), F.avg(confidence).alias(confidence), F.array_join(F.transform(words, lambda s: s["_text"]), " ").alias(text)
    )


def with_rolling_std(df: DataFrame, by: list[str], order: list[str], value: str, rows: int, name: str = "rolling_std") -> DataFrame:
    """Sample deviation over the last ``rows`` rows; null for fewer than two."""
    return df.withColumn(name, F.stddev_samp(value).over(in_order(by, order).rowsBetween(-(rows - 1), 0)))


def with_step(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "step") -> DataFrame:
    """Absolute change of a value since the row before."""
    return df.withColumn(name, F.abs(F.col(value) - F.lag(value).over(in_order(by, order))))


def with_displacement(df: DataFrame, by: list[str], order: list[str], vector: str, name: str = "displacement") -> DataFrame:
    """Euclidean distance of a vector to the one in the row before."""
    before = F.lag(vector).over(in_order(by, order))
    squares = F.zip_with(F.col(vector), before, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return df.withColumn(name, F.when(before.isNotNull(), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))))


def with_landmark_displacement(df: DataFrame, by: list[str], order: list[str], points: str = "landmarks", name: str = "displacement") -> DataFrame:
    """Array of distances of each x, y, z point to its place in the frame before."""
    before = F.lag(points).over(in_order(by, order))
    d = lambda a, b, k: (a[k] - b[k]) * (a[k] - b[k])
    return df.withColumn(name, F.when(before.isNotNull(), F.zip_with(F.col(points), before, lambda a, b: F.sqrt(d(a, b, "x") + d(a, b, "y") + d(a, b, "z")))))


def with_extremum(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "is_peak") -> DataFrame:
    """Whether a row is strictly above both of its neighbours."""
    w = in_order(by, order)
    return df.withColumn(name, F.coalesce((F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)), F.lit(False)))


def with_ffill(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "filled") -> DataFrame:
    return df.withColumn(name, F.last(value, True).over(in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def with_interpolation(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "filled") -> DataFrame:
    """Linear in the row number between known values; leading gaps stay null, trailing ones keep the last value."""
    w = in_order(by, order)
    at = F.row_number().over(w)
    rows = df.withColumn("_at", at).withColumn("_known", F.when(F.col(value).isNotNull(), F.col("_at")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ends = [("_v0", F.last(value, True).over(back)), ("_p0", F.last("_known", True).over(back)), ("_v1", F.first(value, True).over(ahead)), ("_p1", F.first("_known", True).over(ahead))]
    for n, c in ends:
        rows = rows.withColumn(n, c)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_at") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p1").isNull(), F.col("_v0")).otherwise(line)).drop("_at", "_known", "_v0", "_p0", "_v1", "_p1")


def sampled_frames(df: DataFrame, frame: str, video_fps: float, fps: float, rule: str) -> DataFrame:
    """Keeps the frames that a sampling rule keeps: landmarks, emotion, pose or clustering."""
    skip = int(video_fps / fps)
    period = {"landmarks": 1 if fps >= video_fps else skip + 1, "emotion": skip + 1, "pose": max(1, skip), "clustering": max(1, round(video_fps / fps))}[rule]
    return df.where(F.pmod(frame, F.lit(period)) == 0)


def with_missing_frames(df: DataFrame, by: list[str], frame: str, n_frames: int | DataFrame) -> DataFrame:
    """Adds a row of nulls for each frame without a detection; the number of frames is given, or by recording as a column ``n``."""
    ends = df.select(*by).distinct().withColumn("n", F.lit(n_frames)) if isinstance(n_frames, int) else n_frames
    spine = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias(frame)).withColumn(frame, F.col(frame).cast(df.schema[frame].dataType))
    return spine.join(df, [*by, frame], "left")


def decimated(df: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of each recording, from the first."""
    return df.withColumn("_at", F.row_number().over(in_order(by, order)) - 1).where(F.pmod("_at", F.lit(step)) == 0).drop("_at")


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each recording."""
    return df.withColumn("_at", F.row_number().over(in_order(by, order))).where(F.col("_at") <= n).drop("_at")


def beside(left: DataFrame, right: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Columns of ``right`` beside the rows of ``left`` by their place in the recording; ``left`` fixes the number of rows."""
    at = F.row_number().over(in_order(by, order)).alias("_at")
    return left.select("*", at).join(right.select(*by, *columns, at), [*by, "_at"], "left").drop("_at")


def phrase_ranges(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, phrase, first_word, last_word): the ranges of words of a text's sentences."""
    count = lambda p: F.size(F.filter(F.split(p, "\\s+"), lambda w: w != ""))
    sizes = F.filter(F.transform(F.split(text, "[.!?]+"), count), lambda n: n > 0)
    each = df.select(*by, F.posexplode(sizes).alias("phrase", "_n"))
    last = F.sum("_n").over(in_order(by, ["phrase"]).rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("_last", last).select(*by, "phrase", (F.col("_last") - F.col("_n")).alias("first_word"), (F.col("_last") - 1).alias("last_word"))


def with_turn_tangentiality(turns: DataFrame, by: list[str], order: list[str], vector: str, words: str, least: int, name: str = "turn_to_turn") -> DataFrame:
    """Cosine with the turn before, of any speaker; null for the first turn and where either has fewer than ``least`` words."""
    from ..functions.vectors import cosine

    w = in_order(by, order)
    long = (F.col(words) >= least) & (F.lag(words).over(w) >= least)
    rows = turns.withColumns({"_before": F.lag(vector).over(w), "_long": long})
    return rows.withColumn(name, F.when(F.col("_long"), cosine(F.col(vector), F.col("_before")))).drop("_before", "_long")


def presence_frames(df: DataFrame, by: list[str], frame: str, per_row: int, fps: float, least: int) -> DataFrame:
    """Sessions of at least ``least`` frames, up-sampled to every frame: the sessions' spine outer-joined with the rows."""
    s = with_sessions(df, by, [frame], frame, 1.5 * per_row)
    size = F.count("*").over(Window.partitionBy(*by, "session_id")) * per_row
    kept = s.withColumn("_n", size).where(F.col("_n") > least).drop("_n")
    ends = kept.groupBy(*by, "session_id").agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    spine = ends.select(*by, "session_id", F.explode(F.sequence("lo", F.greatest("lo", F.col("hi") - 1))).alias(frame))
    return spine.join(kept, [*by, "session_id", frame], "full_outer")


def speech_runs(silence: DataFrame, recordings: DataFrame, by: list[str], start: str, end: str, n_frames: str = "n_frames", least: float = 0.1, rate: int = 100) -> DataFrame:
    """Frames of speech as a frame number for each row: stretches longer than ``least`` seconds before a silence, and the rest.

    ``recordings`` has the number of frames.  The rest begins where the silence
    after the last such stretch ends; all frames are speech without any stretch.
    """
    before = F.lag(end).over(in_order(by, [start]))
    runs = silence.withColumn("_from", F.coalesce(before, F.lit(0.0))).where(F.col(start) - F.col("_from") > least)
    lo, hi = F.ceil(F.col("_from") * rate), F.floor(F.col(start) * rate) - 1
    between = runs.where(lo <= hi).select(*by, F.explode(F.sequence(lo, hi)).alias("frame_idx"))
    tail = recordings.join(runs.groupBy(*by).agg(F.max_by(end, start).alias("_end")), by, "left")
    first = F.when(F.col("_end").isNull(), F.lit(0).cast("long")).when(F.col(n_frames) / F.lit(float(rate)) - F.col("_end") > least, F.floor(F.col("_end") * rate))
    rest = tail.withColumn("_first", first).where(F.col("_first") < F.col(n_frames))
    return between.unionByName(rest.select(*by, F.explode(F.sequence(F.col("_first"), F.col(n_frames).cast("long") - 1)).alias("frame_idx")))


def with_coherence(df: DataFrame, by: list[str], order: list[str], vector: str, least: int = 1) -> DataFrame:
    """Word coherence of each turn: ``coherence`` with the word before, ``coherence_5`` and ``_10`` as means over the 5 and 11 words
    around, itself included, and ``variability_k`` with the k-th next.

    Means are null where the words around don't all exist, and in turns of no
    more than 5 (10) words; all are null in turns of fewer than ``least`` words.
    """
    from ..functions.vectors import cosine

    w = in_order(by, order)
    rows = df.withColumns({"_n": F.count("*").over(Window.partitionBy(*by)), **{f"_v{k}": F.lead(vector, k).over(w) for k in range(1, 11)}})
    rows = rows.withColumns({f"_s{k}": F.when(F.col("_n") >= least, cosine(F.col(vector), F.col(f"_v{k}"))) for k in range(1, 11)})

    def mean(m: int, n: int) -> Column:
        around = [F.lit(1.0)] + [x for k in range(1, m + 1) for x in (F.col(f"_s{k}"), F.lag(f"_s{k}", k).over(w))]
        return F.when(F.col("_n") > n, sum(around[1:], around[0]) / len(around))

    rows = rows.withColumns({"coherence": F.lag("_s1").over(w), "coherence_5": mean(2, 5), "coherence_10": mean(5, 10), **{f"variability_{k}": F.col(f"_s{k}") for k in range(2, 11)}})
    return rows.drop("_n", *[f"_{x}{k}" for x in "vs" for k in range(1, 11)])


def diarized_words(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, at, word, speaker): the words of diarized texts; a mark that means nothing keeps the speaker before, which is 1 at first."""
    from ..functions.text import speaker_mark

    each = df.select(*by, F.posexplode(F.filter(F.split(text, "\\s+"), lambda w: w != "")).alias("at", "word"))
    spk = F.last(speaker_mark(F.col("word")), True).over(in_order(by, ["at"]).rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("speaker", F.coalesce(spk, F.lit("1"))).where(~F.col("word").startswith("<spk:"))
