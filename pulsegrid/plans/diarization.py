"""Correction of speaker labels by a language model: prompts, answers, transfer, write-back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..models import adapters
from ..operators import series as S

R = "recording_id"


def numbered_speakers(words: DataFrame) -> DataFrame:
    """Words with ``spk``, 1 or 2 in the order of the labels; recordings without exactly two speakers are left out."""
    names = words.groupBy(R).agg(F.array_sort(F.collect_set("speaker")).alias("names")).where(F.size("names") == 2)
    return words.join(names, R).withColumn("spk", F.array_position("names", F.col("speaker")).cast("int"))


def prompts(words: DataFrame, limit: int = 2250) -> DataFrame:
    """(recording_id, chunk, first, words, spk, prompt): chunks of up to ``limit`` characters as diarized text."""
    of = numbered_speakers(words).groupBy(R).agg(F.array_sort(F.collect_list(F.struct("old_idx", F.lower("word").alias("w"), "spk"))).alias("x"))
    flat = of.select(R, F.transform("x", lambda p: p["w"]).alias("w"), F.transform("x", lambda p: p["spk"]).alias("s"))
    cut = flat.select(R, "w", "s", T.chunk_starts(F.col("w"), limit).alias("starts")).select(R, "w", "s", "starts", F.posexplode("starts").alias("chunk", "first"))
    size = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("w")) - F.col("first")
    part = lambda c: F.slice(c, F.col("first") + 1, size)
    out = cut.select(R, "chunk", "first", part("w").alias("words"), part("s").alias("spk"))
    return out.withColumn("prompt", T.strict_words(T.diarized(F.col("words"), F.transform("spk", lambda s: s.cast("string")))))


def answered(chunks: DataFrame, factory, template: str = "{text}") -> DataFrame:
    """Chunks with the model's ``answer``."""
    return adapters.with_model(chunks.withColumn("_asked", T.prompt(template, F.col("prompt"))), factory, "_asked", "answer").drop("_asked")


def transferred(chunks: DataFrame) -> DataFrame:
    """(recording_id, at, spk): the answers' speakers on the words asked about.

    Answers much longer than the prompt are set aside: the words keep their speakers.
    """

    @F.pandas_udf("array<int>")
    def moved(words: pd.Series, spk: pd.Series, said: pd.Series, by: pd.Series, far: pd.Series) -> pd.Series:
        return pd.Series([list(s) if f or not len(b) else N.transferred_speakers(list(b), [int(x) for x in y], list(w), list(s)) for w, s, b, y, f in zip(words, spk, said, by, far, strict=True)])

    clean = chunks.withColumn("answer", T.strict_words(F.coalesce("answer", F.lit(""))))
    said = S.diarized_words(clean, [R, "chunk"], "answer").groupBy(R, "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "word", "speaker"))).alias("y"))
    both = clean.join(said, [R, "chunk"], "left")
    none = F.array().cast("array<string>")
    of = lambda k: F.coalesce(F.transform("y", lambda p: p[k]), none)
    got = both.withColumn("got", moved("words", "spk", of("word"), of("speaker"), F.length("answer") > 1.5 * F.length("prompt")))
    return got.select(R, "first", F.posexplode("got").alias("k", "spk")).select(R, (F.col("first") + F.col("k")).alias("at"), "spk")


def corrected(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Words with their corrected speakers; items without one, as punctuation, take that of the word before."""
    numbered = numbered_speakers(words).withColumn("at", F.row_number().over(S.in_order([R], ["old_idx"])) - 1)
    joined = numbered.drop("spk").join(labels, [R, "at"], "left")
    spk = F.last("spk", True).over(S.in_order([R], ["old_idx"]).rowsBetween(-(1 << 63), 0))
    return joined.withColumn("speaker", F.coalesce(F.get("names", spk - 1), F.col("speaker"))).drop("names", "spk", "at")


def diarization_correction(words: DataFrame, factory, template: str = "{text}", limit: int = 2250) -> DataFrame:
    """Words of transcripts of two speakers with labels corrected by a model."""
    return corrected(words, transferred(answered(prompts(words, limit), factory, template)))
