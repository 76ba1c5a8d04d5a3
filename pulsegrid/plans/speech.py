"""Speech characteristics of transcripts at three grains: words, turns, files.

Input is the unified table of words (``sources.transcripts.read_words``):
recording_id, old_idx, word, start, end, confidence, speaker.  Each step is an
expression over one partitioning by recording; the three tables share it.
Columns that need a model come from ``models.adapters`` and are joined by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import series as S

R = "recording_id"
WINDOWS = (5, 10, 25, 50, 100)


def timed_words(words: DataFrame) -> DataFrame:
    """Words that have times, with the pause before each over all speakers, and the number of their turn."""
    timed = words.where("start is not null and end is not null")
    paused = S.with_pause(timed, [R], ["old_idx"])
    return S.with_islands(paused, [R], ["old_idx"], "speaker")


def turns_of(words: DataFrame, speaker: str | None = None, least: int = 1) -> DataFrame:
    """The turns kept: those of ``speaker`` (of everybody if none is given) with ``least`` words or more."""
    w = words if speaker is None else words.where(F.col("speaker") == speaker)
    first = F.min_by("old_idx", "old_idx")
    parts = F.array_sort(F.collect_list(F.struct("old_idx", "word", "pause")))
    t = w.groupBy(R, "turn_id").agg(F.first("speaker").alias("speaker"), first.alias("utt_start"), F.max("old_idx").alias("utt_end"), F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("p"))
    return t.where(F.size("p") >= least)


def turn_table(words: DataFrame, speaker: str | None = None, least: int = 1, english: bool = True) -> DataFrame:
    """Pauses, rates, richness and repetition of each kept turn."""
    t = turns_of(words, speaker, least)
    inner = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["pause"])
    t = t.withColumns({"words": F.transform("p", lambda x: x["word"]), "pauses": inner, "pre": F.col("p")[0]["pause"], "minutes": (F.col("end") - F.col("start")) / 60})
    t = t.withColumns({"total": F.aggregate("pauses", F.lit(0.0), lambda a, x: a + x), "plain": T.plain_words(F.array_join("words", " "))})
    t = t.withColumns({"mean": F.when(F.size("pauses") > 0, F.col("total") / F.size("pauses")), "lower": F.transform("plain", F.lower)})
    t = t.withColumn("seen", T.occurrences(F.col("lower")))
    square = F.aggregate("pauses", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    some = F.col("minutes") > 0
    n = F.size("words")
    return t.select(
        R, "turn_id", "speaker", "utt_start", "utt_end", F.when(F.col("pre") <= 0, 0.0).otherwise(F.col("pre")).alias("pre_turn_pause"),
        F.col("minutes").alias("turn_length_minutes"), n.alias("turn_length_words"), F.when(some, n / F.col("minutes")).alias("words_per_min"),
        (F.when(some, T.syllable_sum(F.col("lower")) / F.col("minutes")) if english else F.lit(None).cast("double")).alias("syllables_per_min"),
        F.when(some, 100 * (1 - F.col("total") / (60 * F.col("minutes")))).alias("speech_percentage"), F.col("mean").alias("mean_pause_length"),
        F.when(F.size("pauses") > 0, square / F.size("pauses")).alias("pause_variability"),
        *[T.mattr_of(F.col("seen"), k).alias(f"mattr_{k}") for k in WINDOWS], T.honore(F.col("lower")).alias("honore_statistic"), T.brunet(F.col("lower")).alias("brunet_index"),
        T.first_person_share(F.col("plain")).alias("first_person_percentage"), F.coalesce(100 * (1 - T.mattr_of(F.col("seen"), 10)), F.lit(0.0)).alias("word_repeat_percentage"),
        F.coalesce(F.col("pre") <= 0, F.lit(False)).alias("interrupt_flag"),
    )


def word_table(words: DataFrame, speaker: str | None = None, least: int = 1) -> DataFrame:
    """The speaker's words: the pause before each, but for those that start a kept turn, and their syllables."""
    w = words if speaker is None else words.where(F.col("speaker") == speaker)
    kept = turns_of(words, speaker, least).select(R, F.col("utt_start").alias("old_idx"), F.lit(True).alias("_starts"))
    got = w.join(kept, [R, "old_idx"], "left")
    return got.select(R, "old_idx", "turn_id", "word", F.when(F.col("_starts").isNull(), F.col("pause")).alias("pre_word_pause"), T.syllable_sum(T.tokens(F.col("word"))).alias("num_syllables"))


def summary_table(words: DataFrame, speaker: str | None = None, least: int = 1) -> DataFrame:
    """One row a file: lengths, rates, means over turns, variances over words, and the speaker's share."""
    turns, own = turn_table(words, speaker, least), word_table(words, speaker, least)
    shares = words.groupBy(R, "turn_id").agg(F.first("speaker").alias("speaker"), (F.max("end") - F.min("start")).alias("s"), F.max("end").alias("end"))
    mine = F.sum(F.when(F.lit(True) if speaker is None else F.col("speaker") == speaker, F.col("s")))
    files = shares.groupBy(R).agg((F.max("end") / 60).alias("file_length"), (100 * mine / F.max("end")).alias("speaker_percentage"))
    means = ["syllables_per_min", *[f"mattr_{k}" for k in WINDOWS], "word_repeat_percentage"]
    t = turns.groupBy(R).agg(
        F.sum("turn_length_minutes").alias("speech_length_minutes"), F.sum("turn_length_words").alias("speech_length_words"), F.count("*").alias("num_turns"), F.count_if(F.col("turn_length_words") == 1).alias("num_one_word_turns"),
        F.avg("turn_length_minutes").alias("mean_turn_length_minutes"), F.avg("turn_length_words").alias("mean_turn_length_words"), F.avg("pre_turn_pause").alias("mean_pre_turn_pause"), F.count_if("interrupt_flag").alias("num_interrupts"),
        *[F.avg(c).alias(c) for c in means[1:]],
    )
    w = own.groupBy(R).agg(F.avg("pre_word_pause").alias("mean_pre_word_pause"), F.var_samp("pre_word_pause").alias("mean_pause_variability"), F.sum("num_syllables").alias("_syllables"))
    got = files.join(t, R, "left").join(w, R, "left")
    some = F.col("speech_length_minutes") > 0
    return got.withColumns({
        "words_per_min": F.when(some, F.col("speech_length_words") / F.col("speech_length_minutes")), "syllables_per_min": F.when(some, F.col("_syllables") / F.col("speech_length_minutes")),
        "speech_percentage": F.when(some, 100 * F.col("speech_length_minutes") / F.col("file_length")),
    }).drop("_syllables")


def speech_characteristics(words: DataFrame, language: str = "en", speaker_label: str | None = None, min_turn_length: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, turn, summary) tables of many recordings at once; without a speaker there is no turn-level table."""
    timed = timed_words(words)
    turns = turn_table(timed, speaker_label, min_turn_length, language.startswith("en"))
    return word_table(timed, speaker_label, min_turn_length), turns if speaker_label is not None else turns.limit(0), summary_table(timed, speaker_label, min_turn_length)
