"""Queries that SQL can't express: dynamic programmes, mixtures, clusters, smoothers, streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import numeric as N
from ..functions import text as T
from ..operators import series as S
from ..operators import stats as A
from . import catalogue as C


def edit_alignment(spark, sf_dir):
    """Word edit distance of each turn to the text of the next turn of its conversation."""

    def distances(batches):
        for b in batches:  # one pair of texts at a time becomes words of Python
            got = [N.aligned_words(x.as_py(), y.as_py()) for x, y in zip(b.column("w"), b.column("nw"), strict=True)]
            cost, aligned = (pa.array([g[k] for g in got], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), cost, aligned], ["conv_id", "turn", "cost", "aligned"])

    c = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    c = c.withColumn("nw", F.lead("w").over(S.in_order(["conv_id"], ["turn"]))).where("nw is not null")
    return c.mapInArrow(distances, "conv_id long, turn long, cost int, aligned int")


def _per_recording(spark, sf_dir, run, schema):
    return C.words(spark, sf_dir).select("user_id", "event_id", "t", "value").groupBy("user_id").applyInPandas(lambda p: run(p.sort_values(["t", "event_id"])), schema)


def blinks(spark, sf_dir):
    """Peaks of the negated z-score of each recording with their bounds at half prominence."""

    def run(p):
        z = -(p.value - p.value.mean()) / p.value.std() if len(p) > 1 else p.value * 0
        return pd.DataFrame([(p.user_id.iloc[0], i, a, b) for i, a, b in N.peaks(z.fillna(0).to_numpy())], columns=["user_id", "peak", "start", "end"])

    return _per_recording(spark, sf_dir, run, "user_id long, peak int, start double, end double")


def gmm_speaking(spark, sf_dir):
    """Mixtures of many recordings at a time; only one of them need fit into a task."""

    def run(batches):
        for p in _whole_recordings(batches):
            step = p.groupby("user_id", sort=False, dropna=False).value.rolling(3, min_periods=2).std().to_numpy()
            sizes = p.groupby("user_id", sort=False, dropna=False).size().to_numpy()
            yield p[["user_id", "event_id"]].assign(probability=N.gaussian_mixtures(step, sizes))

    e = A.in_sequence(C.words(spark, sf_dir).select("user_id", "event_id", "t", "value"), C.BY, C.ORDER)
    return e.mapInPandas(run, "user_id long, event_id long, probability double")


def _whole_recordings(batches):
    """Frames in order of recordings, cut anew so that none is split; the last one waits for the next batch."""
    held = []
    for b in batches:
        if not len(b):
            continue
        ids = b.user_id.fillna(np.inf).to_numpy()  # no key is infinite
        rest = ids == ids[-1]
        if rest.all() and (not held or held[-1].user_id.fillna(np.inf).iloc[-1] == ids[-1]):
            held.append(b)
            continue
        yield pd.concat([*held, b[~rest]], ignore_index=True)
        held = [b[rest]]
    if held:
        yield pd.concat(held, ignore_index=True)


def kalman_smoothing(spark, sf_dir):
    return _per_recording(spark, sf_dir, lambda p: p[["user_id", "event_id"]].assign(smooth=N.kalman(p.value.to_numpy())), "user_id long, event_id long, smooth double")


def coordination(spark, sf_dir):
    def run(p):
        x = np.vstack([p.value.to_numpy(), np.diff(p.value.to_numpy(), prepend=p.value.iloc[0])])
        bands = N.coordination(x, 5, 2)
        return pd.DataFrame([(p.user_id.iloc[0], *bands)], columns=["user_id", "top", "middle", "bottom"])

    return _per_recording(spark, sf_dir, run, "user_id long, top double, middle double, bottom double")


def kmeans_faces(spark, sf_dir):
    """Two clusters of the vectors of each recording; rows without enough confidence are in none (-1)."""
    v = C._vectors(spark, sf_dir).withColumn("confidence", F.when(F.col("vec_id") % 9 == 0, 0.5).otherwise(0.9))
    return clustered_faces(v, ["label"], "vec_id", "v", "confidence").select("vec_id", "label", "cluster")


def clustered_faces(faces, by: list[str], order: str, vector: str, confidence: str, least: float = 0.7, k: int = 2):
    """Adds ``cluster``, from 0, of the faces with a confidence above ``least``; -1 for the others.  A task holds one recording."""
    schema = StructType([*faces.schema.fields, StructField("cluster", IntegerType())])

    def run(p):
        p = p.sort_values(order)
        sure = (p[confidence] > least).to_numpy()
        cluster = np.full(len(p), -1)
        if sure.any():
            cluster[sure] = N.kmeans(np.stack(p[vector][sure]), k)
        return p.assign(cluster=cluster)

    return faces.groupBy(*by).applyInPandas(run, schema)


def speaker_transfer(spark, sf_dir):
    """Labels of the conversations' words corrected by a stand-in for the model, which swaps the names and keeps the turns."""
    from . import diarization
    from .measures import conversation_words

    def factory():
        return lambda asked: [{"answer": a.replace("<spk:1>", "<spk:x>").replace("<spk:2>", "<spk:1>").replace("<spk:x>", "<spk:2>")} for a in asked]

    w = conversation_words(spark, sf_dir).where("speaker <> 'system'")
    return diarization.diarization_correction(w, factory, limit=400).select("recording_id", "old_idx", "word", "speaker")


def spectral_summary(spark, sf_dir):
    """Cepstral and spectral measures of the embeddings of each recording, read as a signal of 8 kHz."""
    from . import voice

    v = C._vectors(spark, sf_dir).groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"])).alias("samples")).withColumn("rate", F.lit(8000))
    return voice.spectral_measures(v).drop("samples", "rate")


def articulation(spark, sf_dir):
    """Coordination of two smoothed channels of each recording."""
    from . import voice

    one = lambda i: F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.get("v", F.lit(i)).alias("x")))), lambda p: p["x"])
    rows = C._vectors(spark, sf_dir).withColumn("g", F.col("label") % 2).groupBy("g").agg(F.array(one(0), one(1)).alias("channels"))
    return rows.withColumn("a", voice.articulation(F.col("channels"))).select("g", "a.*")


def queries() -> dict:
    own = [edit_alignment, gmm_speaking, kalman_smoothing, coordination, kmeans_faces, speaker_transfer, spectral_summary, articulation]
    return {f.__name__: f for f in own}
