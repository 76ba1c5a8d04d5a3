"""Quality classifier by nearest-neighbour voting (operator 10).

Method: texts become latent-semantic vectors: hashed counts of two kinds of
terms over the whole text, words and adjacent UTF-8 bytes (the pieces of words
and what stands between them), damped by a logarithm and weighted by inverse
document frequency, beside bins for the shares of repeated and of distinct
words, projected by a truncated SVD.  The labelled vectors are
broadcast; every document's exact cosine with every one of them is computed in
blocks (one matrix product a block), and the labels of the nearest ``k`` vote
with weights that grow with similarity.

Weights, basis and vectors are whole numbers of fixed units, small enough that
every product and sum is exact in a double.  So a score depends on the text
alone, not on its place in a block or on the machine's order of additions.

The fit uses at most ``max_labelled`` labelled ids, the ones with the smallest
hash, and one text of each, so what is broadcast and collected is bounded
(``max_labelled`` x ``rank`` numbers) whatever the size of the corpus.  Scoring
covers every row and the whole text.

Defined cases: null and empty texts have a zero vector and get the prior share
of label 1; rows with null labels or ids are not learned from, nor are ids with
contradicting labels; of an id with several texts the smallest is learned from;
with no labelled rows every score is 0.5; equal texts get equal scores; ties
among neighbours go to the labelled rows of smaller id; extra columns are
ignored, and one named as the score column is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of byte pairs and of words.
PAIRS, WORDS = 4096, 2048
TERMS = PAIRS + WORDS
WORD_CACHE, WORD_BYTES = 200_000, 64
RANK = 64
NEIGHBOURS = 24
MAX_LABELLED = 6000
SHARPNESS = 12.0
#: A document is predicted good from this score on.
LEAST_GOOD = 0.7
BLOCK = 256
#: Upper ends of the bins for the share of words equal to the word before, and for the share of distinct words.
REPEAT_BINS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
DISTINCT_BINS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8)
SHAPE = len(REPEAT_BINS) + len(DISTINCT_BINS) + 2
#: A bin weighs as much as so large a share of all terms of the text.
SHAPE_WEIGHT = 0.5
#: Weight of words beside byte pairs.
WORD_WEIGHT = 0.25
WIDTH = TERMS + SHAPE
#: Units of weighted counts, of the basis and of vectors: sums of their products stay below 2^53.
COUNT_UNIT, BASIS_UNIT, VECTOR_UNIT = 1 << 12, 1 << 16, 1 << 20


class _Places(dict):
    """Bucket of each word, remembered for short ones."""

    def __missing__(self, word: str) -> int:
        got = PAIRS + xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % WORDS
        if len(word) <= WORD_BYTES:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = got
        return got


_PLACES = _Places()


def counts(text: str | None) -> np.ndarray:
    """Counts of adjacent byte pairs and of words of the whole text, hashed to buckets, then the word-share bins."""
    out = np.zeros(WIDTH, np.float64)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for lo in range(0, len(raw), 1 << 20):  # a very long text in bounded pieces that overlap by one byte
        part = raw[lo : lo + (1 << 20) + 1].astype(np.uint32)
        if len(part) > 1:
            pair = (part[:-1] << 8 | part[1:]) * np.uint32(2654435761)
            out[:PAIRS] += np.bincount(pair >> np.uint32(20), minlength=PAIRS)
    words = text.split()
    if words:
        out[:TERMS] += np.bincount(np.fromiter(map(_PLACES.__getitem__, words), np.int64, len(words)), minlength=TERMS)
    if len(words) > 1:
        repeated = sum(map(eq, words, islice(words, 1, None))) / len(words)
        out[TERMS + bisect_left(REPEAT_BINS, repeated)] = 1
        out[TERMS + len(REPEAT_BINS) + 1 + bisect_left(DISTINCT_BINS, len(set(words)) / len(words))] = len(words) >= 20
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([counts(t) for t in texts]) if texts else np.zeros((0, WIDTH))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length ``VECTOR_UNIT`` in whole numbers; zero rows stay zero."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(x / np.where(length > 0, length, 1) * VECTOR_UNIT)


def _weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of term weights of length ``COUNT_UNIT``, beside the bins, in whole numbers."""
    x = np.log1p(raw[:, :TERMS].astype(np.float64)) * idf
    # byte pairs and words are kinds of terms of equal length
    kinds = [k / np.where((n := np.sqrt((k * k).sum(axis=1, keepdims=True))) > 0, n, 1) for k in (x[:, :PAIRS], x[:, PAIRS:])]
    return np.rint(np.hstack([kinds[0] * COUNT_UNIT, kinds[1] * (COUNT_UNIT * WORD_WEIGHT), raw[:, TERMS:] * (COUNT_UNIT * SHAPE_WEIGHT)]))


@dataclass
class Model:
    idf: np.ndarray  # TERMS
    basis: np.ndarray  # WIDTH x rank, in BASIS_UNIT
    vectors: np.ndarray  # labelled x rank, rows of length VECTOR_UNIT
    labels: np.ndarray  # labelled
    prior: float
    k: int

    def embed(self, raw: np.ndarray) -> np.ndarray:
        """Latent vectors of rows of counts, in whole numbers."""
        return _units(_weighted(raw, self.idf) @ self.basis)

    def score(self, raw: np.ndarray) -> np.ndarray:
        out = np.full(len(raw), self.prior)
        if not len(self.labels):
            return out
        n = len(self.labels)
        k, bits = min(self.k, n), max(1, (n - 1).bit_length())
        for lo in range(0, len(raw), BLOCK):
            rows = raw[lo : lo + BLOCK]
            # products are below 2^41; with the row's number, earlier ones first, all keys of a document differ
            key = ((self.embed(rows) @ self.vectors.T).astype(np.int64) << bits) + (n - 1 - np.arange(n))
            best = np.sort(np.partition(key, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
            top, sim = n - 1 - (best & ((1 << bits) - 1)), (best >> bits) / VECTOR_UNIT**2
            weight = np.exp(SHARPNESS * (sim - sim[:, :1]))
            share = (weight * self.labels[top]).sum(1) / weight.sum(1)
            out[lo : lo + BLOCK] = np.where(rows.any(1), share, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_arrays(raw: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """Idf weights, SVD basis by subspace iteration, and the labelled vectors.  ``raw``, in single precision, is overwritten by its weights."""
    n = len(raw)
    if not n:
        return Model(np.ones(TERMS), np.zeros((WIDTH, 1)), np.zeros((0, 1)), np.zeros(0), 0.5, k)
    seen = np.zeros(TERMS, np.int64)
    for lo in range(0, n, BLOCK):
        seen += np.count_nonzero(raw[lo : lo + BLOCK, :TERMS], axis=0)
    idf = np.log((1 + n) / (1 + seen)) + 1
    for lo in range(0, n, BLOCK):  # whole numbers of less than 24 bits: exact in single precision
        raw[lo : lo + BLOCK] = _weighted(raw[lo : lo + BLOCK], idf)
    rank = min(rank, n)
    q = np.random.default_rng(7).standard_normal((WIDTH, rank + 8)).astype(np.float32)
    for _ in range(6):  # the basis needs no more digits, and it is rounded once for all
        q, _ = np.linalg.qr(raw.T @ (raw @ q / COUNT_UNIT) / COUNT_UNIT)
    turn = np.linalg.svd(raw @ q / COUNT_UNIT, full_matrices=False)[2].T
    basis = np.rint((q @ turn)[:, :rank].astype(np.float64) * BASIS_UNIT)
    vectors = [_units(raw[lo : lo + BLOCK].astype(np.float64) @ basis) for lo in range(0, n, BLOCK)]
    return Model(idf, basis, np.concatenate(vectors), labels.astype(np.float64), float(labels.mean()), k)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """Learn from rows of ``labels`` (doc_id, quality) that ``docs`` has.

    ``labels`` must already leave out held-out rows.  The sample's ids (bounded)
    are broadcast to the documents, so that only their texts are shuffled, to
    take one of each id; the executors send back sparse counts, not texts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "quality")
    sample = spark.createDataFrame(sample.toPandas().astype({"doc_id": "int64", "quality": "int32"}), "doc_id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("doc_id", "quality", "text")

    def sparse(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                rows = matrix(part.column(2).to_pylist())
                cells = [np.flatnonzero(r) for r in rows]
                cols = [part.column(0), part.column(1), pa.array([c.astype(np.int16) for c in cells], pa.list_(pa.int16())), pa.array([r[c].astype(np.float32) for r, c in zip(rows, cells, strict=True)], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "quality", "cell", "n"])

    got = texts.mapInArrow(sparse, "doc_id long, quality int, cell array<short>, n array<float>").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy())
    raw, (cells, values) = np.zeros((got.num_rows, WIDTH), np.float32), (got["cell"], got["n"])
    for i, at in enumerate(order.tolist()):
        raw[i, cells[at].values.to_numpy()] = values[at].values.to_numpy()
    labels = got["quality"].to_numpy()[order].astype(np.float64)
    del got, cells, values
    return fit_arrays(raw, labels, rank, k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``docs`` that is asked for stays outside: returns (doc_id, score) for each row, whole texts."""
    return _scored(docs.select("doc_id", "text"), model)


def with_score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with a further column ``name``."""
    return _scored(docs, model, name)


def _scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    keep = [i for i, c in enumerate(docs.columns) if c != name and not (name == "score" and c == "text")]
    names = [docs.columns[i] for i in keep] + [name]
    schema = ", ".join(f"`{docs.columns[i]}` {docs.dtypes[i][1]}" for i in keep) + f", `{name}` double"

    def run(batches):
        own = held.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                got = own.score(matrix(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [pa.array(got, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)
