"""Models and services behind one contract: a factory that a worker calls once, and a model that maps a batch to rows.

A model takes a list of inputs and returns a row (a dict) for each, or None
where it has no result; such inputs give a row of nulls.  What it raises for a
single input is not swallowed: wrap it in ``retried`` for calls that may fail.
"""

from __future__ import annotations

import functools
import io
import random
import time
import wave
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list], list]

#: What each kind of model returns.  Media models take a path or bytes, text models a text.
SCHEMAS = {
    "landmarks": "landmarks array<struct<x: double, y: double, z: double>>",
    "emotions": "scores map<string, double>, mouth_openness double",
    "pose": "bb_x1 double, bb_y1 double, bb_x2 double, bb_y2 double, face_confidence double, pitch double, roll double, yaw double",
    "faces": "faces array<struct<bb_x: int, bb_y: int, bb_w: int, bb_h: int, right_eye_x: int, right_eye_y: int, left_eye_x: int, left_eye_y: int, confidence: double, face_embedding: array<double>>>",
    "transcript": "json string",
    "tracks": "tracks array<struct<label: string, start: double, end: double>>",
    "embedding": "vector array<double>",
    "log_probabilities": "log_p array<double>",
    "tags": "tags array<string>",
    "trees": "trees array<string>",
    "answer": "answer string",
    "glottal": "mean_hrf double, std_hrf double, mean_naq double, std_naq double, mean_qoq double, std_qoq double",
    "tremor": "values array<double>",
    "tract_variables": "channels array<array<double>>",
    "framewise": "f0 array<double>, formants array<array<double>>, loudness array<double>, hnr array<double>",
}


def with_model(df: DataFrame, factory: Callable[[], Model], column: str, kind: str, batch: int = 8) -> DataFrame:
    """``df`` with the columns that a model of ``kind`` returns for ``column``; the model is made once a task."""
    added = T._parse_datatype_string(SCHEMAS[kind])
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in batches:
            for lo in range(0, len(part), batch):
                rows = part.iloc[lo : lo + batch].reset_index(drop=True)
                got = [g or {} for g in model(rows[column].tolist())]
                for f in added.fields:
                    rows[f.name] = pd.Series([g.get(f.name) for g in got], dtype="object")
                yield rows

    return df.mapInPandas(run, schema)


def with_embedding(df: DataFrame, column: str, factory: Callable[[], Model] | None = None, dims: int = 64) -> DataFrame:
    """``df`` with ``vector``: by a model, or the hash embedding where none is given."""
    return with_model(df, factory, column, "embedding") if factory is not None else df.withColumn("vector", hash_embedding(F.col(column), dims))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A vector from a text's words alone: each word adds 1 or -1 at a place; a stand-in for a language model, the same everywhere."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.struct((F.pmod(F.crc32(w), F.lit(dims))).cast("int").alias("at"), F.when(F.pmod(F.floor(F.crc32(w) / F.lit(dims)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    total = lambda i: F.aggregate(F.filter(places, lambda p: p["at"] == i), F.lit(0.0), lambda s, p: s + p["v"])
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), total)


def perplexity(log_probabilities: Column) -> Column:
    """exp(-mean) of the log probabilities of a text's words; null for fewer than two."""
    total = F.aggregate(log_probabilities, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(log_probabilities) >= 2, F.exp(-total / F.size(log_probabilities)))


def sentiment(words: Column, lexicon: Column, alpha: float = 15.0) -> Column:
    """struct<neg, neu, pos, compound> from a map of word to valence: shares of the words' strength, and the sum s as s / sqrt(s^2 + alpha)."""
    v = F.transform(words, lambda w: F.coalesce(F.try_element_at(lexicon, w), F.lit(0.0)))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    pos, neg = add(F.transform(v, lambda x: F.when(x > 0, x + 1).otherwise(0.0))), add(F.transform(v, lambda x: F.when(x < 0, 1 - x).otherwise(0.0)))
    none, s = add(F.transform(v, lambda x: F.when(x == 0, 1.0).otherwise(0.0))), add(v)
    whole = F.nullif(pos + neg + none, F.lit(0.0))
    return F.struct((neg / whole).alias("neg"), (none / whole).alias("neu"), (pos / whole).alias("pos"), (s / F.sqrt(s * s + alpha)).alias("compound"))


def wide_landmarks(frames: DataFrame, size: int = 468) -> DataFrame:
    """Landmarks as columns lmk001_x and so on: the layout of the sink."""
    return frames.select(*[c for c in frames.columns if c != "landmarks"], *[F.get("landmarks", F.lit(i))[k].alias(f"lmk{i + 1:03d}_{k}") for i in range(size) for k in "xyz"])


def landmark_arrays(wide: DataFrame, size: int = 468) -> DataFrame:
    """The inverse of ``wide_landmarks``."""
    names = {f"lmk{i + 1:03d}_{k}" for i in range(size) for k in "xyz"}
    points = F.array(*[F.struct(*[F.col(f"lmk{i + 1:03d}_{k}").alias(k) for k in "xyz"]) for i in range(size)])
    return wide.select(*[c for c in wide.columns if c not in names], points.alias("landmarks"))


def measures_of_files(files: DataFrame, factory: Callable[[], Model], kind: str, least_seconds: float = 0.0, duration: str = "duration") -> DataFrame:
    """Measures of audio files by a model; files shorter than ``least_seconds`` don't reach it and have nulls."""
    long = with_model(files.where(F.col(duration) >= least_seconds), factory, "path", kind)
    return long.unionByName(files.where(~(F.col(duration) >= least_seconds) | F.col(duration).isNull()), allowMissingColumns=True)


def silences(frames: DataFrame, by: list[str], frame: str, loudness: str, threshold: float, rate: int = 100, least: float = 0.5) -> DataFrame:
    """(by, pause_start, pause_end, pause_duration): stretches of ``least`` seconds or more whose loudness is below a threshold."""
    from ..operators.series import with_islands

    quiet = with_islands(frames.withColumn("_quiet", F.coalesce(F.col(loudness) < threshold, F.lit(True))), by, [frame], "_quiet", "_run")
    runs = quiet.where("_quiet").groupBy(*by, "_run").agg((F.min(frame) / rate).alias("pause_start"), ((F.max(frame) + 1) / rate).alias("pause_end"))
    return runs.withColumn("pause_duration", F.round(F.col("pause_end") - F.col("pause_start"), 6)).where(F.col("pause_duration") >= least).drop("_run")


def retried(call: Callable, tries: int = 3, base_delay: float = 90.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` again after 90, 180, ... seconds and up to one more, ``tries`` times; the last error is raised."""

    @functools.wraps(call)
    def wrapper(*args, **kwargs):
        for k in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(base_delay * 2**k + random.random())

    return wrapper


@dataclass(frozen=True)
class Transcription:
    """Options of transcription services and their defaults."""

    model: str = "tiny"
    language: str = "en"
    compute_type: str = "int16"
    device: str = "cpu"
    batch_size: int = 16
    min_speakers: int | None = None
    max_speakers: int | None = None
    infra_model: object = None


@dataclass(frozen=True)
class Correction:
    """Options of diarization correction."""

    region: str = "us-east-1"
    max_new_tokens: int = 2048
    top_p: float = 0.5
    temperature: float = 0.2
    parallel_processing: bool = True


def options(kind: type, given: dict):
    """Options of a kind from named values; unknown names are an error."""
    unknown = given.keys() - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return kind(**given)


def with_resources(spark: SparkSession, paths: list[str]) -> None:
    """Files that models need, sent to every worker once."""
    for p in paths:
        spark.sparkContext.addFile(p)


# -- audio files ------------------------------------------------------------


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rate, samples array<int>, duration) of the WAV files of a folder, channels averaged."""

    def run(batches):
        for part in batches:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1).astype(np.int32)
                    rows.append((path, w.getframerate(), x.tolist(), len(x) / w.getframerate()))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "duration"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<int>, duration double")


def write_wavs(clips: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """A WAV file for each (name, rate, samples) row below a shared folder; returns (name, path).  A clip written again is the same file."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for part in batches:
            paths = []
            for n, rate, x in zip(part[name], part["rate"], part["samples"], strict=True):
                with fs.open_output_stream(f"{base}/{n}.wav", compression=None) as out:
                    out.write(wav_bytes(np.array(x), int(rate)))
                paths.append(f"{folder}/{n}.wav")
            yield pd.DataFrame({name: part[name], "path": paths})

    return clips.select(name, "rate", "samples").mapInPandas(run, f"`{name}` string, path string")


def level(samples: Column) -> Column:
    """Loudness of 16-bit samples in decibels below full scale; null for silence."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rms = F.sqrt(square / F.size(samples)) / 32_768.0
    return F.when(rms > 0, 20 * F.log10(rms))


# -- table functions ----------------------------------------------------------


@F.udtf(returnType="at int, word string")
class Words:
    """Words of a text as rows: a table function for SQL."""

    def eval(self, text: str):
        yield from enumerate((text or "").split())


@F.udtf(returnType="old_idx int, word string, start double, end double, confidence double, speaker string")
class TranscriptWords:
    """Words of a nested transcript document as rows."""

    def eval(self, js: str):
        import json

        n = 0
        for s in (json.loads(js or "{}") or {}).get("segments", []):
            for w in s.get("words", []):
                if w.get("score") and "start" in w and "end" in w and (w.get("speaker") or s.get("speaker")):
                    yield n, w["word"], float(w["start"]), float(w["end"]), float(w["score"]), w.get("speaker") or s["speaker"]
                n += 1


def register(spark: SparkSession) -> None:
    """Table functions by name, for SQL."""
    spark.udtf.register("words_of", Words)
    spark.udtf.register("transcript_words", TranscriptWords)
