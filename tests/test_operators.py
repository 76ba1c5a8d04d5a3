"""Hand-computed cases of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import numeric as N
from pulsegrid.functions import text as T
from pulsegrid.functions import vectors as V
from pulsegrid.operators import intervals as I
from pulsegrid.operators import series as S
from pulsegrid.operators import stats as A
from pulsegrid.sources import transcripts

WORDS = [("A", "hello", 0.0, 0.5), ("A", "there", 0.6, 1.0), ("B", "yes", 0.9, 1.2), ("A", "I", 1.5, 1.6), ("A", "think", 1.6, 2.0), ("A", "so", 2.5, 2.8)]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([("r", i, *w) for i, w in enumerate(WORDS)], "recording_id string, old_idx int, speaker string, word string, start double, end double")


def one(spark, column, **values):
    """A column's value over one row of real columns: the planner can't fold it away."""
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first().x


def test_pause_over_all_speakers(words):
    got = [r.pause for r in S.with_pause(words, ["recording_id"], ["old_idx"]).orderBy("old_idx").collect()]
    assert got[0] is None
    assert got[1:] == pytest.approx([0.1, -0.1, 0.3, 0, 0.5])


def test_islands_and_turns(words):
    got = S.combine_turns(words.withColumn("confidence", F.lit(0.5)), ["recording_id"], ["old_idx"], "speaker", "word", "start", "end", "confidence").orderBy("turn_id").collect()
    assert [(r.speaker, r.word, r.start, r.end, r.confidence) for r in got] == [("A", "hello there", 0.0, 1.0, 0.5), ("B", "yes", 0.9, 1.2, 0.5), ("A", "I think so", 1.5, 2.8, 0.5)]


def test_islands_count_null_labels_as_a_label(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", None])], "r int, i int, v string")
    assert [r.turn_id for r in S.with_islands(df, ["r"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 3]


def test_lexical(spark):
    w = "a a b b c c d d e f".split()
    col = F.col("w")
    assert one(spark, T.brunet(col), w=("array<string>", w)) == pytest.approx(5.429766, abs=1e-6)
    assert one(spark, T.honore(col), w=("array<string>", w)) == pytest.approx(345.387764, abs=1e-6)
    assert one(spark, T.mattr(col, 5), w=("array<string>", w)) == pytest.approx(0.633333, abs=1e-6)
    assert one(spark, T.repetition(col, 10), w=("array<string>", w)) == pytest.approx(40)
    assert one(spark, T.repetition(col, 10), w=("array<string>", [])) is None
    assert one(spark, T.mattr(col, 5), w=("array<string>", [])) is None
    assert one(spark, T.honore(col), w=("array<string>", list("abcdefghijk"))) is None


def test_chunks_and_diarized_text(spark):
    assert one(spark, T.chunk_starts(F.col("w"), 8), w=("array<string>", ["abc", "abc", "d", "efghijklmnop", "q"])) == [0, 2, 3, 4]
    assert one(spark, T.chunk_starts(F.col("w"), 8), w=("array<string>", [])) == []
    text = one(spark, T.diarized(F.col("w"), F.col("s")), w=("array<string>", ["a", "b", "c"]), s=("array<string>", ["1", "1", "2"]))
    assert text == "<spk:1> a b <spk:2> c"
    df = spark.createDataFrame([(1, "z " + text + " <spk:x> d <spk:11> e <spk:10 f")], "r int, t string")
    assert [(x.word, x.speaker) for x in S.diarized_words(df, ["r"], "t").orderBy("at").collect()] == [("z", "1"), ("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "2"), ("f", "10")]
    assert one(spark, T.strict_words(F.col("t")), t=("string", "a\nb  c\\ déjà-vu, it's <spk:1> 42!")) == "a b c déjàvu it's <spk:1> 42"
    assert one(spark, T.without_marks(F.col("t")), t=("string", "Hello, World.")) == "hello world"
    assert one(spark, T.without_marks(F.col("t")), t=("string", "a , b")) == "a , b"


def test_first_person_is_case_sensitive(spark):
    assert one(spark, T.first_person_share(F.col("w")), w=("array<string>", ["I", "i", "we", "Me", "mine", "x"])) == pytest.approx(40)
    assert one(spark, T.first_person_share(F.col("w")), w=("array<string>", ["x"])) is None


def test_speech_frames(spark):
    """Stretches over 0.1 s before silences, the rest after the last of them, all frames where there is none."""
    silence = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.05, 1.5), ("b", 0.05, 2.0)], "r string, s double, e double")
    rec = spark.createDataFrame([("a", 300), ("b", 200), ("c", 20)], "r string, n_frames int")
    got = {}
    for x in S.speech_runs(silence, rec, ["r"], "s", "e").collect():
        got.setdefault(x.r, []).append(x.frame_idx)
    assert sorted(got["a"]) == [*range(50), *range(100, 300)]
    assert sorted(got["b"]) == [*range(200)] and sorted(got["c"]) == [*range(20)]


def test_coherence_is_null_at_edges_and_in_short_turns(spark):
    df = spark.createDataFrame([(t, i, [1.0, float(i % 2)]) for t, n in ((0, 5), (1, 6), (2, 12)) for i in range(n)], "t int, i int, v array<double>")
    got = S.with_coherence(df, ["t"], ["i"], "v").orderBy("t", "i").collect()
    known = lambda c, t: [r.i for r in got if r.t == t and r[c] is not None]
    assert known("coherence_5", 0) == [] and known("coherence_5", 1) == [2, 3] and known("coherence_5", 2) == list(range(2, 10))
    assert known("coherence_10", 1) == [] and known("coherence_10", 2) == [5, 6] and known("variability_4", 0) == [0]
    assert all(r.coherence is None for r in S.with_coherence(df, ["t"], ["i"], "v", 6).where("t = 0").collect())


@pytest.mark.parametrize("angles, want", [((0, 0, 0), 0), ((90, 0, 0), 90), ((0, 0, 45), 45)])
def test_rotation(spark, angles, want):
    got = one(spark, V.rotation_angle(F.col("p"), F.col("y"), F.col("r")), p=("double", float(angles[0])), y=("double", float(angles[1])), r=("double", float(angles[2])))
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("word, want", [("hello", 2), ("justification", 5), ("table", 2), ("ach", 1), ("a", 1), ("xyz", 1), ("syllables", 3)])
def test_syllables(spark, word, want):
    assert one(spark, T.syllables(F.col("w")), w=("string", word)) == want


def test_head_movement(spark):
    from pulsegrid.plans import motion

    rows = [("r", 0, 0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 0.0), ("r", 1, None, None, None, None, None, None, None), ("r", 2, 3.0, 4.0, 5.0, 6.0, 90.0, 0.0, 0.0), ("one", 0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 45.0)]
    df = spark.createDataFrame(rows, "r string, f int, bb_x1 double, bb_y1 double, bb_x2 double, bb_y2 double, pitch double, yaw double, roll double")
    got = {(x.r, x.f): x for x in motion.head_movement(df, ["r"], "f").collect()}
    assert [got["r", i].xy_disp for i in range(3)] == [0, None, 5] and got["one", 0].xy_disp is None
    assert got["r", 2].euclidean_angle_disp == pytest.approx(90) and got["r", 1].euclidean_angle is None and got["one", 0].euclidean_angle == pytest.approx(45)
    wide = {(x.r, x.f): x.xy_disp for x in motion.head_movement(df, ["r"], "f", True).collect()}
    assert wide["r", 2] == pytest.approx(2.5)
    blinks = spark.createDataFrame([("r", 3)], "r string, f int")
    rec = spark.createDataFrame([("r", 600, 30.0), ("none", 300, 30.0)], "r string, n_frames int, fps double")
    assert {tuple(x) for x in motion.blink_summary(rec, blinks, ["r"]).collect()} == {("r", 1, 3.0), ("none", 0, 0.0)}


def test_speech_of_one_speaker(spark, words):
    """F1a to F1d: pauses, turns and the file of speaker A."""
    from pulsegrid.plans import speech

    word, turn, file = speech.speech_characteristics(words.withColumn("confidence", F.lit(0.9)), speaker_label="A")
    assert [x.pre_word_pause for x in word.orderBy("old_idx").collect()] == pytest.approx([None, 0.1, None, 0, 0.5])
    a, b = turn.orderBy("turn_id").collect()
    assert (a.pre_turn_pause, b.pre_turn_pause, a.turn_length_words, b.turn_length_words) == (None, pytest.approx(0.3), 2, 3)
    assert (a.turn_length_minutes, b.turn_length_minutes) == pytest.approx((1 / 60, 1.3 / 60)) and (a.mean_pause_length, b.mean_pause_length) == pytest.approx((0.1, 0.25))
    assert (a.pause_variability, b.pause_variability) == pytest.approx((0, 0.0625), abs=1e-9) and (a.speech_percentage, b.speech_percentage) == pytest.approx((90, 61.538462))
    assert (a.words_per_min, b.words_per_min) == pytest.approx((120, 138.461538))
    f = file.first()
    assert (f.file_length, f.speaker_percentage, f.mean_pre_word_pause, f.mean_pause_variability) == pytest.approx((2.8 / 60, 82.142857, 0.2, 0.07))
    b = speech.turn_table(speech.timed_words(words), "B").first()
    assert b.pre_turn_pause == 0 and b.interrupt_flag


def test_windows_without_data(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 30, 2.0), ("b", 10, 3.0)], "u string, window_start long, x double")
    assert sorted(map(tuple, I.with_empty_windows(df, ["u"], 10).collect()), key=str) == sorted([("a", 0, 1.0), ("a", 10, None), ("a", 20, None), ("a", 30, 2.0), ("b", 10, 3.0)], key=str)


def test_eye_aspect_ratio(spark):
    pts = [(0, 0), (1, 1), (2, 1), (3, 0), (2, -1), (1, -1)]
    p = [(F.col("a") + x, F.col("a") + y) for x, y in pts]
    assert one(spark, V.eye_aspect_ratio(p), a=("double", 0.0)) == pytest.approx(2 / 3)


def test_cosine_lags(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 2.0]])], "t int, i int, v array<double>")
    got = df.select("i", V.cosine(F.col("v"), F.lag("v").over(S.in_order(["t"], ["i"]))).alias("c")).orderBy("i").collect()
    assert got[0].c is None and [r.c for r in got[1:]] == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 1])


def test_nonzero_summary(spark):
    r = A.nonzero_summary(spark.createDataFrame([(1, 0.0), (1, None), (1, 100.0), (1, 120.0)], "g int, x double"), ["g"], ["x"]).first()
    assert (r.x_mean, r.x_stddev, r.x_range) == pytest.approx((110, math.sqrt(200), 20))


def test_silence_summary(spark):
    df = spark.createDataFrame([(1, 0.6), (1, 1.0), (1, 3.0)], "g int, p double")
    r = A.silence_summary(df, ["g"], "p", F.lit(20.0)).first()
    assert (r.spir, r.median, r.mad) == pytest.approx((2 / 15.4, 1.0, 0.4))


def test_slope_skips_nulls(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate([1.0, None, 3.0, 5.0])], "g int, i int, y double")
    assert A.slope(df, ["g"], ["i"], "y").first().slope == pytest.approx(2)


def test_containment_join_with_and_without_buckets(spark):
    w = spark.createDataFrame([("r", 9, 11), ("r", 1, 2), ("r", 12, 13)], "r string, start long, end long")
    g = spark.createDataFrame([("r", 0, 10), ("r", 10, 20), ("r", 11, 19)], "r string, start_time long, end_time long")
    plain = sorted(map(tuple, I.containment_join(w, g, ["r"]).collect()))
    assert plain == sorted(map(tuple, I.containment_join(w, g, ["r"], 3).select("r", "start", "end", "start_time", "end_time").collect()))
    assert [x[1:3] for x in plain] == [(1, 2), (12, 13), (12, 13)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 400)), min_size=1, max_size=20))
def test_clipped_parts_add_up(spark, segments):
    df = spark.createDataFrame([(s, s + n) for s, n in segments], "a long, b long")
    parts = I.split_by_window(df, "a", "b", 60)
    assert parts.agg(F.sum(F.col("clip_end") - F.col("clip_start"))).first()[0] == sum(n for _, n in segments)
    assert parts.where("clip_end <= clip_start").count() == 0


def test_quality_gate(spark):
    rows = [("ok", i * 1000) for i in range(61)] + [("no", i * 1000) for i in range(60)]
    got = {r.u: r.passes for r in I.quality_gate(spark.createDataFrame(rows, "u string, t long"), ["u"], "t").collect()}
    assert got == {"ok": True, "no": False}


def test_day_by_zone(spark):
    t = 7 * 3_600_000_000
    assert one(spark, I.is_day(F.col("t")), t=("long", t)) is False
    assert one(spark, I.is_day(F.col("t"), "Europe/Berlin"), t=("long", t)) is True


def test_fill_and_interpolate(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "g int, i int, v double")
    assert [r.filled for r in S.with_interpolation(df, ["g"], ["i"], "v").orderBy("i").collect()] == [None, 1, 2, 3, 3]
    assert [r.filled for r in S.with_ffill(df, ["g"], ["i"], "v").orderBy("i").collect()] == [None, 1, 1, 3, 3]


def test_presence_frames(spark):
    df = spark.createDataFrame([(1, f, 1.0) for f in (0, 10, 20, 60, 70)], "g int, f int, x double")
    got = sorted(r.f for r in S.presence_frames(df, ["g"], "f", 10, 30, 25).collect())
    assert got == list(range(21))


def test_baseline_and_regions(spark):
    df, base = spark.createDataFrame([(0.2,)], "x double"), spark.createDataFrame([(0.4,), (0.6,)], "x double")
    assert A.baseline_ratio(df, base, ["x"]).first().x == pytest.approx(-0.2)
    assert one(spark, A.region_mean(F.col("v"), [0, 1, 1, 2]), v=("array<double>", [1.0, 4.0, None])) == pytest.approx(3)


def test_transcripts(spark):
    whisper = '{"segments":[{"speaker":"S0","start":0,"end":2,"text":"a b","words":[{"word":"a","start":0.0,"end":0.5,"score":0.9},{"word":"b","score":0.8},{"word":"c","start":1,"end":2,"score":0}]}]}'
    aws = '{"jobName":"j","results":{"items":[{"type":"pronunciation","start_time":"0.1","end_time":"0.4","speaker_label":"spk_0","alternatives":[{"confidence":"0.9","content":"hi"}]},{"type":"punctuation","alternatives":[{"confidence":"0.0","content":"."}]}]}}'
    vosk = '[{"word":"x","start":0,"end":1,"conf":1.0},{"word":"y","start":1,"end":2,"conf":0}]'
    df = spark.createDataFrame([("w", whisper), ("a", aws), ("v", vosk)], "recording_id string, json string")
    got = {(r.recording_id, r.old_idx, r.word, r.start, r.speaker) for r in transcripts.read_words(df).collect()}
    assert got == {("w", 0, "a", 0.0, "S0"), ("a", 0, "hi", 0.1, "spk_0"), ("v", 0, "x", 0.0, "speaker0")}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment_cost_is_edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    cost, pairs = N.align(a, b)
    assert cost == d[-1]
    assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))


def test_numeric_routines():
    assert N.transferred_speakers(list("abcd"), [1, 1, 2, 2], list("abcd"), [2, 2, 1, 1]) == [2, 2, 1, 1]
    y = np.zeros(50)
    y[20] = 5
    assert [p[0] for p in N.peaks(y)] == [20]
    p = N.gaussian_mixture(np.r_[np.zeros(50), np.full(50, 9.0), np.nan])
    assert p[:50].max() < 0.01 and p[50:100].min() > 0.99 and np.isnan(p[100])
    assert len(set(N.kmeans(np.array([[0, 0], [0, 1], [9, 9], [9, 8]], float), 2)[[0, 2]])) == 2
    s = N.kalman(np.full(30, 5.0))
    assert s[0] == 0 and s[5:] == pytest.approx(np.full(25, 5.0), abs=0.2)
    assert N.tree_scores("(S (NP (D the) (N cat)) (VP (V sat)))") == (3, 2)
    assert len(N.cepstral_peak(np.sin(np.arange(8000) / 10), 8000)) > 0 and len(N.low_high_ratio(np.sin(np.arange(16000) / 3), 16000)) > 0


def test_stream_equals_batch(spark, tmp_path):
    from pulsegrid.streaming.windows import hourly_counts, run_once

    src = "/root/testdata/sf0.001/events.parquet"
    got = {(r.user_id, r.hour): r.n for r in run_once(hourly_counts(spark, src), "t", f"file://{tmp_path}").collect()}
    e = spark.read.parquet(src).withColumn("at", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.h): r.n for r in e.groupBy("user_id", F.date_trunc("hour", "at").alias("h")).agg(F.count("*").alias("n")).collect()}
    last = max(h for _, h in want)
    assert all(want[k] == n for k, n in got.items()) and len(got) >= sum(h < last.replace(day=max(1, last.day - 1)) for _, h in want)


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_returns_every_window(spark, tmp_path, parts):
    from pulsegrid.streaming.windows import distinct_events, hourly_counts, run_once

    src = "/root/testdata/sf0.001/events.parquet"
    e = spark.read.parquet(src)
    if parts:
        src = f"{tmp_path}/events.parquet"
        e.repartition(parts).write.parquet(src)
    got = {tuple(r)[:3]: r.total for r in run_once(hourly_counts(spark, src), "t", f"file://{tmp_path}").collect()}
    batch = e.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    want = {(r.user_id, r.w.start, r.n): r.total for r in batch.collect()}
    assert got.keys() == want.keys() and sum(k[2] for k in got) == e.count()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert run_once(distinct_events(spark, src), "d", f"file://{tmp_path}", "append").count() == e.select("event_id").distinct().count()


def test_alignment_by_rows_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        cost, pairs = N.align(a, b)
        assert N._aligned_by_rows(a, b) == N.aligned_words(a, b) == (cost, sum(i >= 0 and j >= 0 for i, j in pairs))
    long = [f"w{i}" for i in rng.integers(0, 40, 1500)]
    tracemalloc.start()
    N.aligned_words(long, long[::-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6


def test_mixtures_of_many_are_those_of_each():
    rng = np.random.default_rng(1)
    sizes = np.r_[rng.integers(0, 60, 50), 1, 0, 2, 3]
    x = rng.gamma(2, 3, sizes.sum())
    x[rng.random(len(x)) < 0.1] = np.nan
    want = np.concatenate([N.gaussian_mixture(e) for e in np.split(x, np.cumsum(sizes)[:-1])])
    np.testing.assert_allclose(N.gaussian_mixtures(x, sizes), want, atol=1e-9)


def test_partitions_grow_with_the_points(spark):
    df = spark.range(1000).selectExpr("id % 50 r", "id t")
    got = I.spread(df, ["r"], 10)
    assert got.rdd.getNumPartitions() == 100 and got.count() == 1000
    assert I.spread(df, ["r"], 1000) is df


def test_recordings_are_whole_in_frames():
    import pandas as pd

    from pulsegrid.plans.models import _whole_recordings

    whole = pd.DataFrame({"user_id": [1, 1, 1, 2, 3, 3, 3, 3, None, None], "x": range(10)})
    for size in range(1, 11):
        got = list(_whole_recordings(whole.iloc[i : i + size] for i in range(0, 10, size)))
        assert pd.concat(got).x.tolist() == list(range(10))
        of = [set(g.user_id.fillna(-1)) for g in got]
        assert sum(map(len, of)) == 4
