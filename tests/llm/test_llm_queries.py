"""The opN_ queries on the smallest tables, and the stages of the pipeline, against brute force."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from math import floor

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import lines, mixing, quality, queries, simhash
from tests.llm.test_llm_operators import brute_components, brute_edited, brute_probabilities, brute_scan

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = queries.queries()[name](spark, SF).collect()
        return held[name]

    return get


def test_every_query_is_here():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11))


def test_op1(run, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op1_ngram_jaccard_join")} == brute_components(texts, 3, 90, 100)


def test_op2(run, texts):
    t, start, want = Tokenizer.from_file(VOCAB), 0, {}
    for i in sorted(texts):
        ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run("op2_token_id_files")} == want


def test_op3(run, texts, spark):
    want = brute_edited(list(texts.items()), dict.fromkeys(map(lambda t: t or "", texts.values()), 0))
    every = sorted({x for w in want for x in w[3:]})
    fp = {every[r.k]: r.fingerprint & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(every)), "k long, text string"), ["k"]).collect()}
    like = lambda a, b: 1 - (fp[a] ^ fp[b]).bit_count() / 64
    got = {tuple(r) for r in run("op3_document_fingerprints")}
    assert got == {(i, n, sha, f"{fp[a]:016x}", f"{fp[e]:016x}", like(a, e), like(a, nxt)) for i, n, sha, a, e, nxt in want}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(run, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(queries.oracle_sql()[name])
    got = run(name)
    assert Counter(tuple(r[c] for c in want.columns) for r in got) == Counter(want.fetchall())


def test_op6(run, texts):
    """Lines and paragraphs by brute force; what only windows find has a test of its own (test_license_windows)."""
    for r in run("op6_license_scans"):
        hits, names = brute_scan(texts[r.doc_id]), set(filter(None, r.licenses.split(",")))
        assert {n for _, n in hits} <= names and r.n_units >= len(hits)
        assert r.best_dice_e4 >= max((floor(d * 10000 + 0.5) for d, _ in hits), default=0)
        assert (r.n_units > 0) == (r.best_dice_e4 >= 8000) == bool(names)


def brute_lines(rows, min_chars=lines.MIN_CHARS, min_sites=lines.MIN_SITES):
    """{doc_id: (text, lines removed)} of (doc_id, text, source) rows with ids of their own."""
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(rows, key=lambda r: r[0]):
        for pos, x in enumerate((t or "").split("\n")):
            if len(x.strip(" ")) >= min_chars:
                sites[x.strip(" ")].add(s)
                first.setdefault(x.strip(" "), (i, pos))
    out = {}
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        kept = [x for pos, x in enumerate(parts) if len(sites.get(x.strip(" "), ())) < min_sites or first[x.strip(" ")] == (i, pos)]
        out[i] = (t if t is None else "\n".join(kept), len(parts) - len(kept))
    return out


def test_op7(run, spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, None if t is None else len(t), None if t is None else hashlib.md5(t.encode()).hexdigest()) for i, (t, n) in brute_lines(rows).items()}
    assert {r.doc_id: (r.lines_removed, r.n_chars, r.text_md5) for r in run("op7_line_dedup")} == want


def digests(texts):
    t, out = Tokenizer.from_file(VOCAB), {}
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_op8(run, texts):
    assert {r.doc_id: tuple(r)[1:] for r in run("op8_bpe_round_trip")} == digests(texts)


def test_op9(run, spark):
    rows, cells = run("op9_source_mixing"), Counter()
    for r in rows:
        cells[r.source or "(none)", r.lang or "(none)", r.topic] += r.tokens
    want = brute_probabilities(cells, 0.6, (0.5, 0.7, 0.7), {})
    draws = {r.doc_id: r.d for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", mixing.draw(F.col("doc_id")).alias("d")).collect()}
    for r in rows:
        p = want[r.source or "(none)", r.lang or "(none)", r.topic]
        assert r.probability == pytest.approx(p, rel=1e-6) and r.kept == (draws[r.doc_id] < r.probability)


def test_op10(run, texts, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = sorted(i for i in labels if i in texts and not out(i))
    model = quality.fit_arrays(quality.matrix([texts[i] for i in learned]).astype(np.float32), np.array([labels[i] for i in learned], float))
    got = {r.doc_id: r for r in run("op10_quality_classifier")}
    ids = sorted(texts)
    for i, s in zip(ids, model.score(quality.matrix([texts[i] for i in ids])), strict=True):
        assert (got[i].held_out, got[i].predicted) == (out(i), int(got[i].score >= 0.7)) and got[i].score == pytest.approx(s, abs=1e-9)


# -- pipeline -------------------------------------------------------------

MADE = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark):
    """Documents with copies, near copies, repeated ids, boilerplate, nulls and empties."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 80)) for _ in range(12)]
    footer = "This same footer line is on very many sites."
    rows = [(i, f"{b}\n{footer}" if i % 2 else b, "en", f"s{i}", 0) for i, b in enumerate(base)]
    rows += [(100 + i, b.replace(b.split()[40], "changed"), "de", f"t{i}", 0) for i, b in enumerate(base[:6])]
    rows += [(200 + i, f"{footer}", None, f"u{i}", 0) for i in range(9)]
    rows += [(0, base[0], "en", "s0", 0), (0, base[1], "en", "s0", 0), (300, None, None, None, None), (301, "", "en", "x", 0), (302, " \n ", "en", "x", 0), (None, base[2], "en", "x", 0), (303, "two words", "fr", "y", 9)]
    return rows, spark.createDataFrame(rows, MADE).withColumns({"mark": F.lit("m"), "component": F.lit(1)})


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "source_mixing", "bpe_round_trip"]


def test_quality_stage(spark, texts):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = sorted(i for i in labels if i in texts)
    model = quality.fit_arrays(quality.matrix([texts[i] for i in learned]).astype(np.float32), np.array([labels[i] for i in learned], float))
    ids = sorted(texts)
    want = {i for i, s in zip(ids, model.score(quality.matrix([texts[i] for i in ids])), strict=True) if s >= quality.LEAST_GOOD}
    got = corpus_pipeline.quality_stage(spark, d, SF)
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == want and 0 < len(want) < len(ids)


def test_line_stage(spark):
    rows, df = made(spark)
    rows = [r for r in rows if r[0] is not None and r not in rows[-7:-5]]
    got = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, MADE).withColumn("first", F.lit(1)), SF).collect()
    want = {i: t for i, (t, n) in brute_lines([(r[0], r[1], r[3]) for r in rows]).items() if not n or (t or "").strip()}
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert not {201, 208} & set(want) and corpus_pipeline.line_stage(spark, df, SF).count() > len(want)


def test_near_duplicate_stage(spark):
    rows, df = made(spark)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect())
    numbered = dict(enumerate(r[1] if r[0] is not None else None for r in rows))
    comp = brute_components(numbered, 5, 80, 100)
    mark = [r.m for r in spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i long, t string").orderBy("i").select(F.xxhash64("t").alias("m")).collect()]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[comp[i][1] if comp[i][0] and r[0] is not None else ("alone", i)].append((r[0] if r[0] is not None else -1, mark[i], i))
    want = Counter()
    for g in groups.values():
        i = min(g)[2]
        want[rows[i][0], rows[i][1]] += 1
    assert got == want and len(groups) < len(rows)
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), SF).count() == 0


def test_mixing_and_token_stages(spark):
    rows, df = made(spark)
    kept = corpus_pipeline.mixing_stage(spark, df, SF)
    got = kept.collect()
    assert kept.columns == df.columns and 0 < len(got) < len(rows)
    want = [tuple(r)[:5] for r in mixing.sampled(df).where("kept").select(df.columns).collect()]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    some = df.where("doc_id >= 100")
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.token_stage(spark, some, SF).collect()} == digests({r.doc_id: r.text for r in some.collect()})


def test_pipeline_runs(run, spark, texts):
    got = run("pipeline")
    assert 0 < len(got) < len(texts) and {r.doc_id for r in got} <= set(texts)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert Counter(map(tuple, d.collect())) == Counter(map(tuple, got))
