"""The ``opN_<name>`` queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, licenses, lines, mixing, quality, simhash, tokenfile, topk, warc
from .oracles import SQL
from .shared import stored, table

VOCABULARY = "word_bpe_49k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=1)
    return tokenfile.read_checksums(manifest)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    own = F.col("fingerprint")
    return got.select(
        "doc_id", "n_chars", "edited_sha256", simhash.shown(own).alias("fingerprint"), simhash.shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        simhash.likeness(own, F.col("edited_fingerprint")).alias("near_edited"), simhash.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_archives(warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages"))), payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    # windows add the licences that no line or paragraph has
    known = F.transform("hits", lambda h: h["license"])
    got = got.select("doc_id", F.concat("hits", F.filter("windows", lambda w: ~F.array_contains(known, w["license"]))).alias("hits"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0))
    return got.select("doc_id", F.size("hits").cast("long").alias("n_units"), F.array_join(names, ",").alias("licenses"), F.floor(best * 10000 + F.lit(0.5)).cast("long").alias("best_dice_e4"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.cleaned(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.sampled(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "lang", "topic", "tokens", "probability", "kept")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    got = quality.score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.LEAST_GOOD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_token_id_files, op3_document_fingerprints, op4_exact_top_k, op5_warc_revisits, op6_license_scans, op7_line_dedup, op8_bpe_round_trip, op9_source_mixing, op10_quality_classifier, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
