"""Output tables: names and types of their columns, empty tables, and rows of nulls for recordings without a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GPS = ["observed_time", "move_time", "pause_time", "dist_travelled", "home_time", "home_max_dist", "home_mean_dist"]
_VARIABILITY = [f"word_coherence_variability_{k}" for k in range(2, 11)]
_COHERENCE = ["word_coherence", "word_coherence_5", "word_coherence_10", *_VARIABILITY]
_MATTR = [f"mattr_{k}" for k in (5, 10, 25, 50, 100)]
_SENTIMENT = ["sentiment_pos", "sentiment_neg", "sentiment_neu", "sentiment_overall"]
_LEXICAL = [*_SENTIMENT, *_MATTR, "honore_statistic", "brunet_index", "yngve_score", "frazier_score", "first_person_percentage", "first_person_sentiment_positive", "first_person_sentiment_negative"]
_REPEAT = ["word_repeat_percentage", "phrase_repeat_percentage"]
_TURN = ["first_order_sentence_tangeniality", "second_order_sentence_tangeniality", "turn_to_turn_tangeniality"]
_PERPLEXITY = ["semantic_perplexity", "semantic_perplexity_5", "semantic_perplexity_11", "semantic_perplexity_15"]
_PAIR = lambda names, a="mean", b="var": [f"{n}_{m}" for n in names for m in (a, b)]
_FRAMEWISE = ["f0", "f1", "f2", "f3", "f4", "loudness", "hnr"]
_FACE = ["overall", "lower_face", "upper_face", "lips", "eyebrows", "mouth_openness"]

#: Columns of each table.  Doubles, but for the names in ``TYPES``.  Fixed values.
TABLES = {
    "gps.hourly": ["datetime", *_GPS],
    "gps.daily": ["datetime", "observed_time", "observed_time_day", "observed_time_night", *_GPS[1:]],
    "gps.summary": ["no_days", "total_observed_time", *[f"{m}_{n}" for n in _GPS[1:] for m in ("mean", "sd")]],
    "speech.word": ["pre_word_pause", "num_syllables", "part_of_speech", "first_person", "verb_tense", *_COHERENCE],
    "speech.turn": ["pre_turn_pause", "turn_length_minutes", "turn_length_words", "words_per_min", "syllables_per_min", "speech_percentage", "mean_pause_length", "pause_variability", *_LEXICAL, *_REPEAT, *_TURN, *_PERPLEXITY, "interrupt_flag"],
    "speech.summary": [
        "file_length", "speech_length_minutes", "speech_length_words", "words_per_min", "syllables_per_min", "mean_pre_word_pause", "mean_pause_variability", "speech_percentage", *_LEXICAL, "first_person_sentiment_overall", *_REPEAT, *_PAIR(_COHERENCE),
        "num_turns", "num_one_word_turns", "mean_turn_length_minutes", "mean_turn_length_words", "mean_pre_turn_pause", "speaker_percentage", *_PAIR(_TURN), "turn_to_turn_tangeniality_slope", *_PAIR(_PERPLEXITY), "num_interrupts",
    ],
    "voice.framewise": _FRAMEWISE,
    "face.ear": ["frame", "ear"],
    "face.blinks": [f"blink_{k}_{m}" for m in ("frame", "time") for k in ("peak", "starting", "ending")],
    "face.blink_summary": ["blinks", "blink_rate"],
    "face.summary": _PAIR(_FACE, "mean", "std"),
    "head.summary": _PAIR(["xy_disp", "pitch", "yaw", "roll", "euclidean_angle_disp"], "mean", "std"),
}
TYPES = {"datetime": "string", "part_of_speech": "string", "verb_tense": "string", "first_person": "boolean", "interrupt_flag": "boolean", "num_syllables": "int", "no_days": "long", "frame": "int", "blinks": "long"}


def schema(name: str, keys: str = "recording_id string") -> str:
    return ", ".join([keys, *[f"{c} {TYPES.get(c, 'double')}" for c in TABLES[name]]])


def empty(spark: SparkSession, name: str, keys: str = "recording_id string") -> DataFrame:
    return spark.createDataFrame([], schema(name, keys))


def complete(got: DataFrame, recordings: DataFrame, by: list[str], name: str) -> DataFrame:
    """``got`` with all columns of the table, and a row of nulls for each recording that has none."""
    from pyspark.sql import functions as F

    full = got.select(*by, *[F.col(c) if c in got.columns else F.lit(None).cast(TYPES.get(c, "double")).alias(c) for c in TABLES[name]])
    return recordings.select(*by).join(full, by, "left")
