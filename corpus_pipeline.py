"""The corpus pipeline: five stages over ``documents``, each by one operator of ``pulsegrid.llm``.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is
written as Parquet and reread as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``; columns beyond those pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, jaccard, lines, mixing, quality
from pulsegrid.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its quality score is below this: it is the threshold of the classifier's own prediction.
LEAST_QUALITY = quality.LEAST_GOOD


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty texts, which it can't judge, stay or go by the prior.

    Without labels every score is 0.5 and nothing is judged, so all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not len(model.labels):
        return docs
    scored = quality.with_score(docs, model, "_quality_score")
    return scored.where(F.col("_quality_score") >= LEAST_QUALITY).drop("_quality_score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first occurrence; documents left without any text by that go too."""
    got = lines.cleaned(docs)
    emptied = (F.col("lines_removed") > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return got.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).drop("lines_removed")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar five-word shingles one row stays.

    It is the one with the smallest id, of rows that repeat this id the one with
    the smallest hash of its text; texts without words and rows without an id
    link with nothing and stay.
    """
    groups = stored(jaccard.linked_documents(docs, shingle=5, num=80, den=100).where("component is not null"), "near-duplicates")
    best = groups.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    others = groups.join(best, "component").where(F.struct("doc_id", "mark") != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    again = groups.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_mark"))
    kept = docs.join(others, own, "left_anti")
    if not again.limit(1).count():
        return kept.select(docs.columns)
    once = kept.join(again, own, "left_semi").withColumn("_mark", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_mark"])
    return kept.join(again, own, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target shares of source, language and topic."""
    return mixing.sampled(docs).where("kept").select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("bpe_round_trip", token_stage),
]

#: Classifier, tokenizer and connected components can't be written in SQL; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
