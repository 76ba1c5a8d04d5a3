"""Adapters, options, audio files, table functions, diarization correction, output schemas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.models import adapters as M
from pulsegrid.plans import diarization


def test_models_give_a_row_each(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "x")], "k string, text string")

    def factory():
        return lambda batch: [{"vector": [float(len(t))]} if t else None for t in batch]

    got = {r.k: r.vector for r in M.with_embedding(df, "text", factory).collect()}
    assert got == {"a": [7.0], "b": None, "c": [1.0]}
    short = M.measures_of_files(spark.createDataFrame([("p", 2.0), ("q", 5.0), ("r", None)], "path string, duration double"), lambda: lambda b: [{"values": [1.0]}] * len(b), "tremor", 3.0)
    assert {r.path: r["values"] for r in short.collect()} == {"p": None, "q": [1.0], "r": None}


def test_hash_embedding_is_of_the_words_alone(spark):
    df = spark.createDataFrame([("b a", "A  b", "c")], "x string, y string, z string")
    r = df.select(*[M.hash_embedding(F.col(c), 8).alias(c) for c in "xyz"]).first()
    assert r.x == r.y != r.z and sum(map(abs, r.z)) == 1


def test_retries_and_options():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert M.retried(flaky, 3, 90, waits.append)() == "done" and 90 <= waits[0] <= 91 and 180 <= waits[1] <= 181
    with pytest.raises(ZeroDivisionError):
        M.retried(lambda: 1 / 0, 2, 0, waits.append)()
    assert M.options(M.Transcription, {"language": "de"}).language == "de" and M.options(M.Transcription, {}).batch_size == 16
    with pytest.raises(ValueError, match="colour"):
        M.options(M.Correction, {"colour": 1})


def test_audio_files(spark, tmp_path):
    x = (np.sin(np.arange(1600) / 8) * 16_000).astype(int)
    clips = spark.createDataFrame([("s0-0", 16_000, x.tolist()), ("s1-0", 8000, [0] * 80)], "name string, rate int, samples array<int>")
    folder = f"file://{tmp_path}/wavs"
    assert {r.name for r in M.write_wavs(clips, folder).collect()} == {"s0-0", "s1-0"}
    got = {r.path.rsplit("/", 1)[1]: r for r in M.read_wavs(spark, folder).withColumn("level", M.level(F.col("samples"))).collect()}
    assert got["s0-0.wav"].samples == x.tolist() and got["s0-0.wav"].duration == pytest.approx(0.1) and got["s1-0.wav"].level is None
    assert got["s0-0.wav"].level == pytest.approx(20 * np.log10(np.sqrt(np.mean(x.astype(float) ** 2)) / 32768))


def test_table_functions(spark):
    M.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM words_of('a  b')").collect()] == [(0, "a"), (1, "b")]
    js = '{"segments":[{"speaker":"S0","words":[{"word":"a","start":0,"end":1,"score":0.5},{"word":"b","score":1}]}]}'
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM transcript_words('{js}')").collect()] == [(0, "a", 0.0, 1.0, 0.5, "S0")]


def test_diarization_correction(spark):
    """The model swaps the names and gives one word to the other speaker; names follow the transcript, the word moves."""
    rows = [("r", i, w, s) for i, (w, s) in enumerate([("hello", "A"), ("there", "A"), ("yes", "B"), ("so", "B"), ("good", "A")])] + [("one", 0, "alone", "A")]
    words = spark.createDataFrame(rows, "recording_id string, old_idx int, word string, speaker string")

    def factory():
        return lambda asked: [{"answer": "<spk:2> hello there yes <spk:1> so <spk:2> good"} for _ in asked]

    got = diarization.diarization_correction(words, factory).orderBy("old_idx").collect()
    assert [(r.word, r.speaker) for r in got] == [("hello", "A"), ("there", "A"), ("yes", "A"), ("so", "B"), ("good", "A")]
    long = diarization.diarization_correction(words, lambda: lambda asked: [{"answer": "<spk:1> blah " * 50} for _ in asked]).orderBy("old_idx").collect()
    assert [r.speaker for r in long] == ["A", "A", "B", "B", "A"]


def test_clusters_of_sure_faces(spark):
    from pulsegrid.plans.models import clustered_faces

    rows = [("r", i, [float(i % 2) * 9, 0.0], 0.9 if i else 0.1) for i in range(7)]
    got = {r.i: r.cluster for r in clustered_faces(spark.createDataFrame(rows, "r string, i int, v array<double>, c double"), ["r"], "i", "v", "c").collect()}
    assert got[0] == -1 and got[1] == got[3] == got[5] != got[2] == got[4] == got[6]


@pytest.mark.parametrize("name, n", [("gps.hourly", 8), ("gps.daily", 10), ("gps.summary", 14), ("speech.word", 17), ("speech.turn", 34), ("speech.summary", 73), ("voice.framewise", 7), ("face.summary", 12), ("head.summary", 10), ("face.blinks", 6)])
def test_schemas(spark, name, n):
    assert len(schemas.TABLES[name]) == n == len(set(schemas.TABLES[name]))
    rec = spark.createDataFrame([("a",), ("b",)], "recording_id string")
    got = schemas.complete(schemas.empty(spark, name), rec, ["recording_id"], name)
    assert got.count() == 2 and got.columns == ["recording_id", *schemas.TABLES[name]]
