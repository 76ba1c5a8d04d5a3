"""Transcripts of three dialects as one table of words, and GPS files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GPS = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("accuracy", T.DoubleType())])
AWS = "results struct<items array<struct<type string, start_time string, end_time string, speaker_label string, alternatives array<struct<confidence string, content string>>>>>"
WHISPER = "segments array<struct<start double, end double, text string, speaker string, words array<struct<word string, start double, end double, score double, speaker string>>>>"
VOSK = "array<struct<word string, start double, end double, conf double>>"
WORDS = ["recording_id", "old_idx", "word", "start", "end", "confidence", "speaker"]


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """CSV with exactly the header timestamp, latitude, longitude, accuracy; another header is an error."""
    return spark.read.schema(GPS).option("header", True).option("enforceSchema", False).csv(path)


def dialect(js: Column) -> Column:
    """aws, whisper or vosk, by the shape of the document."""
    has = lambda path: F.get_json_object(js, path).isNotNull()
    return F.when(has("$.jobName") & has("$.results"), "aws").when(has("$.segments[0].words"), "whisper").otherwise("vosk")


def aws_words(docs: DataFrame) -> DataFrame:
    """Items with a confidence above 0; old_idx counts all items, punctuation too."""
    items = docs.select("recording_id", F.posexplode(F.from_json("json", AWS)["results"]["items"]).alias("old_idx", "i"))
    best = F.get("i.alternatives", F.lit(0))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    out = items.select("recording_id", "old_idx", best["content"].alias("word"), number("i.start_time").alias("start"), number("i.end_time").alias("end"), F.expr("try_cast(get(i.alternatives, 0).confidence as double)").alias("confidence"), F.col("i.speaker_label").alias("speaker"))
    return out.where("confidence > 0")


def whisper_words(docs: DataFrame) -> DataFrame:
    """Words with a score, times and a speaker; old_idx counts all words of all segments."""
    segments = F.from_json("json", WHISPER)["segments"]
    words = F.flatten(F.transform(segments, lambda s: F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), F.coalesce(w["score"], F.lit(0.0)).alias("confidence"), F.coalesce(w["speaker"], s["speaker"], F.lit("no_speaker")).alias("speaker")))))
    flat = docs.select("recording_id", F.posexplode(words).alias("old_idx", "w")).select("recording_id", "old_idx", "w.*")
    return flat.where("confidence > 0 and start is not null and end is not null and speaker <> 'no_speaker'")


def vosk_words(docs: DataFrame) -> DataFrame:
    """One speaker, confidence above 0."""
    flat = docs.select("recording_id", F.posexplode(F.from_json("json", VOSK)).alias("old_idx", "w")).select("recording_id", "old_idx", "w.word", "w.start", "w.end", F.col("w.conf").alias("confidence"), F.lit("speaker0").alias("speaker"))
    return flat.where("confidence > 0")


def read_words(docs: DataFrame) -> DataFrame:
    """(recording_id, json) documents of any dialect as one table of words."""
    kind = docs.withColumn("_dialect", dialect(F.col("json")))
    parts = [f(kind.where(F.col("_dialect") == n)).select(*WORDS) for n, f in (("aws", aws_words), ("whisper", whisper_words), ("vosk", vosk_words))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def replaced_labels(words: DataFrame, names: dict[str, str], column: str = "speaker") -> DataFrame:
    """Speaker labels by a map, e.g. to clinician and participant; others stay."""
    expr = F.col(column)
    for old, new in names.items():
        expr = F.when(F.col(column) == old, F.lit(new)).otherwise(expr)
    return words.withColumn(column, expr)


def vosk_turns(docs: DataFrame) -> DataFrame:
    """A whole word list as one turn of no named speaker: words, text, start and end of each recording."""
    listed = docs.select("recording_id", F.from_json("json", VOSK).alias("w"))
    texts = F.transform("w", lambda x: x["word"])
    return listed.select("recording_id", F.lit("").alias("speaker"), texts.alias("words"), F.array_join(texts, " ").alias("text"), F.array_min(F.transform("w", lambda x: x["start"])).alias("start"), F.array_max(F.transform("w", lambda x: x["end"])).alias("end"))


def whisper_text(docs: DataFrame) -> DataFrame:
    """The texts of all segments put together."""
    return docs.select("recording_id", F.array_join(F.transform(F.from_json("json", WHISPER)["segments"], lambda s: s["text"]), "").alias("text"))


def speaker_counts(words: DataFrame, by: list[str]) -> DataFrame:
    """How many speakers a recording has; with more than one a label must be given."""
    return words.groupBy(*by).agg(F.count_distinct("speaker").alias("speakers"))


def phonations(words: DataFrame, by: list[str], order: list[str], least: float = 0.7) -> DataFrame:
    """Held sounds longer than ``least`` seconds, named speaker_sound and a number from 0 by speaker and sound."""
    from pyspark.sql import Window

    from ..functions.text import phonation

    held = words.withColumn("phonation", phonation(F.col("word"))).where(F.col("phonation").isNotNull() & (F.col("end") - F.col("start") > least))
    number = F.row_number().over(Window.partitionBy(*by, "speaker", "phonation").orderBy(*order)) - 1
    return held.withColumn("name", F.concat("speaker", F.lit("_"), "phonation", number.cast("string")))


def phonation_measures(summaries: DataFrame, name: str = "name") -> DataFrame:
    """Acoustic summaries of phonations with their type, the first letter of the name's last part, and without pause measures."""
    kind = F.substring(F.substring_index(name, "_", -1), 1, 1)
    return summaries.drop("spir", "dur_med", "dur_mad", "silence_ratio").withColumn("phonation_type", kind)


def diarization_rows(tracks: DataFrame) -> DataFrame:
    """Tracks with labels like SPEAKER_07 as intervals of speaker7."""
    number = F.element_at(F.split("label", "_"), -1).cast("int").cast("string")
    return tracks.withColumn("speaker", F.concat(F.lit("speaker"), number)).withColumnsRenamed({"start": "start_time", "end": "end_time"}).withColumn("interval", F.col("end_time") - F.col("start_time"))


def numbered_ranges(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Millisecond ranges to cut from a recording, named by speaker and the speaker's turn from 0."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*by, "speaker").orderBy(*order)) - 1
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return turns.withColumns({"name": F.concat("speaker", F.lit("-"), number.cast("string")), "start_ms": ms("start"), "end_ms": ms("end")})
