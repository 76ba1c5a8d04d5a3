"""Each operator against a brute-force version or an exact round trip, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import io
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, jaccard, licenses, lines, mixing, quality, shared, simhash, tokenfile, topk, warc

VOCAB = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "The same boilerplate line of a site footer."
ODD = ["", None, "   \n\t ", "one", "one two", "Ünïcödé ΣΑΣ <|endoftext|> it's 42\x1c!! 🙂 é", "word " * 30_000, "a\x00b"]


def docs(spark, texts, extra=False):
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 9}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"sid": F.lit("x"), "h": F.lit(1), "tokens": F.lit("y"), "w": F.lit(0), "kept": F.lit(1), "score": F.lit("z")}) if extra else df


# -- 1 --------------------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12, members=7):
    rng, out = random.Random(seed), list(ODD)
    for g in range(groups):
        n = rng.choice([3, 6, 10, 14, 25, 60, 150])
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, n // 20))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    return out


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, k, num, den):
    texts = near_copies(k)
    got = jaccard.linked_documents(docs(spark, texts, True), k, num, den).collect()
    want = brute_components(dict(enumerate(texts)), k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)


def test_jaccard_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b\tc d")], "doc_id long, text string")
    got = Counter(tuple(r)[:3] for r in jaccard.linked_documents(df, 3, 90, 100).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1)])
    assert jaccard.linked_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("num", [90, 80])
def test_signatures_miss_no_linked_pair(num):
    th, rng, missed = jaccard.Threshold(num, 100), np.random.default_rng(num), 0
    edges = jaccard.band_edges(3000)
    bands = [jaccard.plan_band(lo, hi - 1, th, 100_000) for lo, hi in zip(edges, edges[1:], strict=False)]
    for _ in range(400):
        n = int(rng.integers(5, 900) if rng.random() < 0.5 else rng.integers(5, 40))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, th.differ(n) + 1))
        keep = rng.random(len(a)).argsort()[min(gone // 2, len(a) - 1) :]
        b = np.unique(np.r_[a[keep], rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)])
        if th.linked(a, b) and not np.array_equal(a, b):
            keys = [jaccard.all_signatures(s, edges, bands, th)[0] for s in (a, b)]
            missed += not len(np.intersect1d(*keys))
            diff = int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum())
            assert diff * (num + 100) <= (100 - num) * (len(a) + len(b))
    assert not missed


@pytest.mark.parametrize("num, sets", [(90, 100_000), (80, 100_000), (90, 10**10), (80, 10**10)])
def test_linked_sets_share_over_spare_keys(spark, num, sets):
    th, rng, rows, pairs = jaccard.Threshold(num, 100), np.random.default_rng(num), [], []
    edges = jaccard.band_edges(1500)
    bands = [jaccard.plan_band(lo, hi - 1, th, sets) for lo, hi in zip(edges, edges[1:], strict=False)]
    assert sets < 10**10 or any(b.double for b in bands)
    for i in range(60):
        n = int(rng.integers(20, 1_200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = th.differ(n) - 1
        b = np.unique(np.r_[a[gone // 2 :], rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)])
        if not th.linked(a, b):
            continue
        keys, drops = zip(*[jaccard.all_signatures(x, edges, bands, th) for x in (a, b)], strict=True)
        place = int(np.searchsorted(edges, max(len(a), len(b)), side="right")) - 1
        common = np.intersect1d(*keys)
        shared = (common & np.uint64(63) == place).sum()
        assert shared > bands[place].spare and all(shared > d[k & np.uint64(63) == place].max() for k, d in zip(keys, drops, strict=True))
        pairs.append((2 * i, 2 * i + 1))
        own = set(common.tolist())
        for sid, k, d in zip(pairs[-1], keys, drops, strict=True):  # the worst case: what they share is most frequent
            rows += [(x, sid, y, 9 if x in own else 2) for x, y in zip(k.tolist(), d.tolist(), strict=True)]
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k, s, d, h) for k, s, d, h in rows], "sig long, sid long, drop int, held long")
    left = {}
    for r in jaccard._without_frequent(df).collect():
        left.setdefault(r.sid, set()).add(r.sig)
    assert len(pairs) > 20 and all(left[a] & left[b] for a, b in pairs)


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard_form_letters(spark, k, num):
    """Letters that share all but two words don't link, those that share all but one may; few candidates are made of them."""
    rng = random.Random(k)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(160):
        w = list(base)
        w[9] = f"n{rng.randrange(8 if i % 2 else 10**6)}"
        w[40] = f"a{rng.randrange(40 if i % 2 else 10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_documents(docs(spark, texts), k, num, 100).collect()}
    assert got == brute_components(dict(enumerate(texts)), k, num, 100)


def test_long_sketches_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base, other = rng.integers(0, 1 << 63, 2_400, dtype=np.uint64), rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    sets = {i: np.unique(s) for i, s in {1: base[:1_900], 2: base[:2_200], 3: base[:1_000], 4: base[:1_100], 5: other, 6: np.concatenate([base[:1_000], other[:1_000]])}.items()}
    rows = [(i, len(s), x.tolist()) for i, s in sets.items() if (x := jaccard.long_sketch(s)) is not None]
    assert [(i, len(x)) for i, _, x in rows] == [(1, 32), (2, 64), (4, 32), (5, 32), (6, 32)]
    sketches = spark.createDataFrame(rows, "sid long, n long, long array<long>")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 5), (5, 6), (2, 5)], "a long, b long")
    threshold = jaccard.Threshold(80, 100)
    got = {(r.a, r.b) for r in jaccard._refined(pairs, sketches, threshold).collect()}
    assert threshold.linked(sets[1], sets[2]) and threshold.linked(sets[3], sets[4])
    assert got == {(1, 2), (3, 4)}


def test_components_of_a_chain(spark):
    got = {r.sid: r.label for r in jaccard.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 99)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 99: 90}


def test_index_leaves_in_bounded_batches():
    """However many texts come in at once, a batch of keys has one text's beyond the bound at most; no key is lost."""

    class Docs:
        where = select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1_000)]
    th, edges = jaccard.Threshold(80, 100), jaccard.band_edges(500)
    bands = [jaccard.plan_band(lo, hi - 1, th, 1_000) for lo, hi in zip(edges, edges[1:], strict=False)]
    make = jaccard.Shingler(5)
    want = [jaccard.all_signatures(make(t), edges, bands, th)[0].view(np.int64) for t in texts]
    got = list(jaccard._index(Docs(), 5, 0, th, edges, bands)([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    assert np.array_equal(np.concatenate([b.column(0).to_numpy() for b in got]), np.concatenate(want))
    assert len(got) > 1 and max(b.num_rows for b in got) < jaccard.INDEX_ROWS + max(map(len, want))


def test_stored_tables_leave_no_shuffles(spark):
    """The shuffles of a stored table are deleted at once; what made it can be read again."""

    def files():
        jvm = spark._jvm
        every = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(every) if re.fullmatch(r"shuffle_.*\.data", f.getName())}

    before, conf = files(), spark.conf.get(shared.SHUFFLE_CLEANUP, None)
    df = spark.range(50_000).selectExpr("id % 1000 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v")).repartition(3, "v")
    for _ in range(2):
        held = shared.stored(df, "sums")
        assert (held.count(), held.agg(F.sum("v")).first()[0]) == (1000, 50_000 * 49_999 // 2)
        assert shared.stored(held.join(df, ["k", "v"]), "joined").count() == 1000
    assert spark.conf.get(shared.SHUFFLE_CLEANUP, None) == conf
    left = lambda: sum(n for name, n in files().items() if name not in before)
    until = time.time() + 10
    while left() > 5_000 and time.time() < until:
        time.sleep(0.1)
    assert left() <= 5_000  # the counts' own shuffles, of a row a partition, may stay


# -- 2, 8 -----------------------------------------------------------------


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_DOCS", 7)  # in the workers nothing changes: they import the module anew
    texts = near_copies(1)
    t = Tokenizer.from_file(VOCAB)
    manifest = tokenfile.write_ids(docs(spark, texts, True), VOCAB)
    got = {r.doc_id: tuple(r)[1:] for r in tokenfile.read_checksums(manifest).collect()}
    whole = {r.doc_id: (r.start, r.ids) for r in tokenfile.read_ids(manifest).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes())) and whole[i] == (start, ids.tolist())
        start += len(ids)
    assert tokenfile.read_ids(tokenfile.write_ids(docs(spark, texts).limit(0), VOCAB)).count() == 0


def test_token_files_null_and_repeated_ids(spark):
    rows = [(5, "b b"), (None, "a"), (5, "a a a"), (2, None), (None, None), (5, "a a a")]
    got = [tuple(r) for r in tokenfile.read_checksums(tokenfile.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB)).orderBy("start").collect()]
    t, start, want = Tokenizer.from_file(VOCAB), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def written(rows, lots=1):
    f = io.BytesIO()
    w = tokenfile.Writer(f)
    for lo in range(0, len(rows), lots):
        part = rows[lo : lo + lots]
        w.add([i for i, _ in part], np.array([len(x) for _, x in part]), np.array([i for _, x in part for i in x], np.int32))
    assert w.close() == len(f.getvalue())
    return f.getvalue()


@pytest.mark.parametrize("n, high", [(0, 5), (1, 5), (700, 3), (3000, 65_535), (3000, 1 << 20), (900, 1 << 28)])
def test_range_coder_round_trip(n, high):
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(0, high, n).tolist()) for i in range(3)]
    assert [(a, b.tolist()) for a, b in tokenfile.read_file(io.BytesIO(written(rows)))] == rows


@pytest.mark.parametrize("levels", [4, 6])
def test_distributions_are_items(levels):
    """A distribution is one item that moves as a whole, and learns as by the formula; its ends stay."""
    rng, lanes = np.random.default_rng(levels), tokenfile._Lanes(50, levels)
    for level in range(levels):
        k, size = min(level, 3), len(lanes.digits[level])
        want = np.tile((np.arange(17) * (tokenfile.WHOLE // 16)).astype(np.int16), (size, 1))
        for _ in range(40):
            at, digit = rng.choice(size, 30, replace=False), rng.integers(0, 16, 30)
            rows = lanes.rows(level, at)
            assert np.array_equal(rows, want[at])
            want[at] += tokenfile.TARGETS[k][digit] - want[at] >> tokenfile.RATES[k]
            lanes.renew(level, at, rows, digit)
        assert np.array_equal(lanes.rows(level, np.arange(size)), want)
        assert lanes.digits[level].shape == (size,) and (want[:, 0] == 0).all() and (want[:, 16] == tokenfile.WHOLE).all() and (np.diff(want) > 0).all()


def test_library_starts_no_threads():
    """A task's core is its own: the library doesn't spread a batch of runs over the machine."""
    code = f"import os; from pulsegrid.llm import tokenfile; m = tokenfile.Memo({VOCAB!r}, 1); n = len(os.listdir('/proc/self/task')); m.encode([f'w{{i}}' for i in range(5000)]); assert len(os.listdir('/proc/self/task')) == n"
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=60)


def test_token_documents_over_groups(monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP_IDS", 1000)
    rng = np.random.default_rng(3)
    rows = [(None, []), (1, rng.integers(0, 300, 3500).tolist()), (2, [7]), (3, rng.integers(0, 9, 500).tolist()), (4, []), (5, rng.integers(0, 9, 999).tolist())]
    data = written(rows, 2)
    assert [(a, b.tolist()) for a, b in tokenfile.read_file(io.BytesIO(data))] == rows
    assert max(len(p) for _, p, _ in tokenfile.read_pieces(io.BytesIO(data))) <= 1000
    assert len(data) < sum(len(x) for _, x in rows) * 2


def test_token_ids_too_large():
    with pytest.raises(ValueError, match="2\\^28"):
        written([(1, [1 << 28])])


@pytest.mark.parametrize("at", [200, -60, -20, 3])
def test_token_file_checksums(at):
    data = bytearray(written([(1, list(range(2000)))]))
    data[at] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.read_file(io.BytesIO(bytes(data))))


def test_memo_equals_whole_texts():
    """Runs without white space give the ids of whole texts: all code points beside white space and letters."""
    t, own = Tokenizer.from_file(VOCAB), tokenfile.Memo(VOCAB, 1)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        part = points[lo : lo + 20_000]
        texts = ["".join(f"a{c}b {c} e{c}" for c in part[i : i + 40]) for i in range(0, len(part), 40)]
        sizes, flat = own.encode(texts)
        want = [e.ids + [1] for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def in_jvm(spark, name, rows):
    got = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, data binary").select("i", tokenfile._called(spark, tokenfile._instance(spark, name), "data").alias("data"))
    return [bytes(r.data) if r.data is not None else None for r in sorted(got.collect())]


def test_jvm_coder_equals_numpy(spark, monkeypatch):
    """The JVM writes the bytes of the NumPy coder and reads them; carries, ids of all sizes, predictable and random ones."""
    monkeypatch.setattr(tokenfile, "LANES", 8)
    rng, cases = np.random.default_rng(5), []
    for high in (2, 40, 60_000, 1 << 20, 1 << 28):
        text = np.concatenate([rng.integers(0, high, 1500), np.tile(rng.integers(0, high, 7), 400), np.repeat(high - 1, 900), rng.zipf(1.3, 2000) % high])
        cases += [text.astype(np.int32), text[:1].astype(np.int32)]
    block = [min(tokenfile.BLOCK_IDS, max(tokenfile.LEAST_BLOCK, -(-len(c) // tokenfile.LANES))) for c in cases]
    groups = [tokenfile.group_bytes(c) for c in cases]
    heads = [np.array([tokenfile._levels(c), b], "<i4").tobytes() for c, b in zip(cases, block, strict=True)]
    assert in_jvm(spark, "Encode", [h + c.tobytes() for h, c in zip(heads, cases, strict=True)]) == groups
    assert in_jvm(spark, "Decode", groups) == [c.tobytes() for c in cases]
    damaged = bytearray(groups[4])
    damaged[-20] ^= 4
    assert in_jvm(spark, "Decode", [damaged]) == [None]


def test_cut_runs_equal_whole_texts(spark, monkeypatch):
    """Words, digits and signs give the ids of whole texts: all code points beside letters, digits, apostrophes and white space; also if numbers start anew."""
    monkeypatch.setattr(tokenfile, "_classes", {})
    monkeypatch.setattr(tokenfile, "TASK_RUNS", 5000)
    t = Tokenizer.from_file(VOCAB)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"A{c}b {c} É{c}1 {c}É" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    texts += [f"don't DON'T 'S x'sé ÀÈ×Ü÷ß a1b22 $$a--B '{o} a{o}b É{o}\x01 \x1cA\x85B\xa0C \u0301a e\u0301 E\u0301X" for o in ("<|endoftext|>", "<|startoftext|>'s", "<|", "")]
    texts += ["".join(random.Random(i).choices("aAzZéÉÿß×÷19'$-. \t\n\u0301", k=300)) for i in range(200)] + [None, "", " ", "\x01 a \x01"]
    rows = docs(spark, texts, True)
    got = {r.doc_id: r.ids for r in tokenfile.read_ids(tokenfile.write_ids(rows, VOCAB)).collect()}
    want = t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)
    assert len(got) == len(texts) and all(got[i] == w.ids + [1] for i, w in enumerate(want))


def test_library_is_asked_once_for_runs_in_use(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_RUNS", 40)
    own, asked = tokenfile.Memo(VOCAB, 1), []
    monkeypatch.setattr(own, "ask", lambda runs, ask=own.ask: asked.extend(runs) or ask(runs))
    for i in range(20):
        runs = [b"often", b"used"] + [f"rare{i}x{j}".encode() for j in range(30)]
        sizes, ids = own.recall(runs)
        want = [own.tokenizer.encode(r.decode(), add_special_tokens=False).ids for r in runs]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        assert len(own.held) + len(own.old) <= 2 * (40 + 32)
    assert asked.count("often") == asked.count("used") == 1


def test_table_reader_finds_damage(spark):
    manifest = tokenfile.write_ids(docs(spark, near_copies(3)), VOCAB)
    path = manifest.first().file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(tokenfile.MAGIC) + 60] ^= 16
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="checksum|blocks of a group"):
        tokenfile.read_checksums(manifest).collect()


def test_bpe_equals_library(spark):
    texts = near_copies(2) + ["".join(random.Random(i).choices("aAbΣσİıﬁ'sré́̈ \t\x1c\x85​09٣①日🙂_-#!<|>", k=60)) for i in range(60)]
    t = Tokenizer.from_file(VOCAB)
    got = {r.doc_id: r for r in bpe.encode_decode(docs(spark, texts, True), VOCAB).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs(spark, texts), VOCAB), VOCAB)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: r.decoded for i, r in got.items()}


def test_bpe_of_all_code_points():
    t, own = Tokenizer.from_file(VOCAB), bpe.BpeCodec(VOCAB)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        part = points[lo : lo + 20_000]
        texts = ["".join(f"a{c}b {c}{c}1 e{c}" for c in part[i : i + 40]) for i in range(0, len(part), 40)]
        assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_bpe_long_words_and_empty_table(spark):
    t, own = Tokenizer.from_file(VOCAB), bpe.BpeCodec(VOCAB, cache_words=3)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdeé日", k=n)) for n in (250, 257, 300, 5000, 20_000)] + ["ab" * 4000, "z" * 10_001] + [f"w{i} w{i % 3}" for i in range(50)]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    assert bpe.digests(docs(spark, texts[:3]).limit(0), VOCAB).count() == 0


# -- 3 --------------------------------------------------------------------


def brute_edited(rows, mark):
    """(doc_id, n_chars, edited_sha256, plain text, edited text, next text) of (doc_id, text) rows in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]]))
    out = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    return out


def check_edited(spark, rows, df):
    texts = sorted({t or "" for _, t in rows})
    mark = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    want = brute_edited(rows, mark)
    every = sorted({x for w in want for x in w[3:]})
    fp = {every[r.k]: r.fingerprint for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(every)), "k long, text string"), ["k"]).collect()}
    got = Counter(tuple(r) for r in simhash.edited_fingerprints(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint").collect())
    assert got == Counter((*w[:3], fp[w[3]], fp[w[4]], fp[w[5]]) for w in want)


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 5)
    texts = near_copies(3) + ["same text here once more", "same text here once more"]
    check_edited(spark, list(enumerate(texts)), docs(spark, texts, True))


def test_fingerprints_null_and_repeated_ids(spark):
    rows = [(7, "b c d e f g h i"), (7, "b c d e f g h i"), (7, "b c d e f g h i"), (7, "other text of the id"), (None, "no name"), (None, None), (None, ""), (1 << 62, "far away id"), (-5, "x" * 9)]
    schema = "doc_id long, text string"
    check_edited(spark, rows, spark.createDataFrame(rows, schema))
    check_edited(spark, rows[:1], spark.createDataFrame(rows[:1], schema))
    assert simhash.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    assert {r.fingerprint for r in simhash.fingerprints(spark.createDataFrame([(1, None), (2, ""), (3, " \t\n")], "k long, text string"), ["k"]).collect()} == {0}


def test_fingerprint_votes(spark):
    df = spark.createDataFrame([(1, "a b c a b c d"), (2, "x")], "k long, text string")
    hashes = spark.createDataFrame([(1, *"abc"), (1, *"bca"), (1, *"cab"), (1, *"abc"), (1, *"bcd"), (2, "x", None, None)], "k long, a string, b string, c string").select("k", F.xxhash64("a", "b", "c").alias("h")).collect()
    for r in simhash.fingerprints(df, ["k"]).collect():
        own = [h.h & (1 << 64) - 1 for h in hashes if h.k == r.k]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        assert r.fingerprint & (1 << 64) - 1 == want


def test_neighbours_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b, r.distance) for r in simhash.neighbours(spark.createDataFrame([(f,) for f in signed + signed[:3] + [None]], "fingerprint long")).collect()}
    want = {(a, b, d) for a in signed for b in signed if a < b and (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= 3}
    assert got == want and want


# -- 4 --------------------------------------------------------------------


def brute_top(vecs, k=5):
    """(query_id, rank, vec_id, score) with rows told apart by their place, in integers of any length."""
    good = [(n, i, [floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for n, (i, v) in enumerate(vecs) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, i, b in good if m != n and len(a) == len(b))[:k]
            want += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best)]
    return sorted(want)


def top_rows(df, **kw):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, 256, **kw).collect()))


@pytest.mark.parametrize("segment, dropped, values", [(64, 3, 1 << 20), (8192, 2, 60), (50, 0, 1 << 20)])
def test_top_k(spark, segment, dropped, values):
    rng = np.random.default_rng(segment)
    vecs = [(i, rng.normal(0, 0.3, 12).round(2).tolist()) for i in range(300)]
    vecs += [(1000 + i, vecs[0][1]) for i in range(40)] + [(5000, None), (5050, [None] * 12), (5100, [float("nan")] * 12), (5150, [float("inf")] * 12), (None, vecs[1][1]), (5200, []), vecs[3], vecs[50], vecs[50], (5250, [0.0] * 12), (5300, [1.0, -2.0]), (5301, [0.5, 0.5]), (50, [0.25] * 12)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "row": F.lit("x"), "x": F.lit(None).cast("int")})
    assert top_rows(df, segment_rows=segment, query_rows=4, dropped_bits=dropped, query_values=values) == brute_top(vecs)
    assert top_rows(df.limit(0)) == []


def test_top_k_large_components(spark):
    rng = np.random.default_rng(9)
    size = [1.0, 1e5, 2e7, 1e10, 2e12, 1e13, 1e100, 1e300, 1.7e308]
    vecs = [(i, (rng.normal(0, 0.4, 4) * size[int(rng.integers(len(size)))]).clip(-1.79e308, 1.79e308).tolist()) for i in range(400)]
    got = top_rows(spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3), segment_rows=32)
    assert got == brute_top(vecs) and len({s for _, _, _, s in got} & {(1 << 63) - 1}) == 1


# -- 5 --------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>é" * 600
    pages = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (9, "u", long), (None, "u", long), (6, "u", "q" * 999), (7, "u", "q" * 999), (8, "u", "r" * 1000), (10, "u", "r" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.read_archives(warc.write_archives(warc.with_revisits(df), 2000)).collect()
    assert not any(r.gap for r in got) and len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert by[i].record_type == "response" and bytes(by[i].payload) == data or by[i].record_type == "revisit"
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {1: 9, 2: 9, 8: 10}
    assert warc.read_archives(warc.write_archives(warc.with_revisits(df.limit(0)))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    raw = [warc.record(i, "u", b"p%d" % i * 50, hashlib.sha1(b"p%d" % i * 50).digest(), None) for i in range(5)]
    parts = [warc.member(r) if packed else r for r in raw]
    at = np.cumsum([0] + [len(p) for p in parts]).tolist()
    data = bytearray(b"".join(parts))
    data[at[1] + len(parts[1]) // 2 if packed else at[2] - 10] ^= 0xFF
    data[at[3] : at[3] + 3] = b"???"
    got = list(warc.salvage(bytes(data) + b"tail"))
    assert [g[:3] for g in got if g[0] == "gap"] == [("gap", at[1], at[2]), ("gap", at[3], at[4]), ("gap", at[5], at[5] + 4)]
    assert [warc.page_row(*g[3])[0] for g in got if g[0] == "record"] == [0, 2, 4]
    assert [g[1] for g in got] == [0] + [g[2] for g in got[:-1]]


def test_salvage_of_quoted_records():
    """A record in the block of a damaged one is no record, be the damage in the block or in the header."""
    rec = lambda i, body: warc.record(i, "u", body, hashlib.sha1(body).digest(), None)
    quoted = b"see:\r\n\r\n" + rec(99, b"inner page") + b"and so on"
    parts = [rec(1, b"first"), rec(2, quoted), rec(3, b"third")]
    at = np.cumsum([0] + [len(p) for p in parts]).tolist()
    for damage in (at[2] - 8, at[1]):
        data = bytearray(b"".join(parts))
        data[damage] ^= 0xFF
        got = list(warc.salvage(bytes(data)))
        assert [g[:3] for g in got] == [("record", 0, at[1]), ("gap", at[1], at[2]), ("record", at[2], at[3])]
    assert list(warc.salvage(b"")) == []


def test_warc_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "x" * 1000)] * 3 + [(2, "u", "x" * 1000)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.with_revisits(df))).collect())
    assert got == {(1, "revisit", 2): 3, (2, "response", None): 1}


# -- 6 --------------------------------------------------------------------


def brute_scan(text, t=0.8):
    hits, units = [], (text or "").split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text or "") if "\n" in p.strip()]
    for u in units:
        own = set(licenses.bigrams_of(u))
        best = max(((2 * len(own & set(g)) / (len(own) + len(g)), -k, n) for k, (n, g) in enumerate((n, licenses.bigrams_of(x)) for n, xs in sorted(licenses.TEMPLATES.items()) for x in xs)), default=(0, 0, ""))
        if best[0] >= t:
            hits.append((round(best[0], 9), best[2]))
    return hits


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    texts = ODD + ["x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "licensed, UNDER cc by 4.0!", mit.replace(", ", ",\n"), "a\n\n" + mit.replace("the ", "the\n") + "\n\nb", mit + " and more words", "All rights reserved.\nAll rights reserved.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: [(round(h.dice, 9), h.license) for h in r.hits] for r in licenses.scan(docs(spark, texts, True)).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert [x[1] for x in got[len(texts) - 1]] == ["GPL-3.0"]
    assert len(got[len(texts) - 2]) == 2 + 1  # a line that occurs twice, and the paragraph of both
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_windows(spark):
    read = lambda n: (licenses.TEXTS / f"{n}.txt").read_text()
    names = sorted(f.stem for f in licenses.TEXTS.glob("*.txt"))
    texts = [f"Some words before.\n{read(n)}\nand after" for n in names]
    lines_of = [
        ("Copyright (c) 2020 Jane Doe. All rights reserved.", ["Proprietary"]), ("Licensed under the MIT License.", ["MIT"]), ("    GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007", ["GPL-3.0"]),
        ("All of the words in this longer line are licensed under CC BY-NC 4.0. as far as the owner of them knows.", ["CC-BY-NC-4.0"]), ("A text without any license or copyright, all of it in the open.", []),
        ("a line\nsays licensed under the Apache\nLicense, Version 2.0. and then some more; also, released under the MIT license by us", ["Apache-2.0", "MIT"]),
    ]
    df = docs(spark, texts + [t for t, _ in lines_of] + ODD)
    got = {r.doc_id: [w.license for w in r.windows] for r in licenses.scan(df).collect()}
    for i, n in enumerate(names):
        assert n in got[i], n
    assert [got[len(names) + i] for i in range(len(lines_of))] == [n for _, n in lines_of]
    assert not any(got[len(names) + len(lines_of) + i] for i in range(len(ODD)))


# -- 7 --------------------------------------------------------------------


def test_line_dedup(spark):
    texts = ODD + [f"Own first line number {i} of this text\n{LINE}\nshort\n  {LINE}" for i in range(20)] + [f"Line on some sites only, here\nmore text {i} that is unique" for i in range(3)]
    df = docs(spark, texts, True)
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.cleaned(df, min_sites=8).collect()}
    sites, first = defaultdict(set), {}
    for i, t in enumerate(texts):
        for pos, x in enumerate((t or "").split("\n")):
            if len(x.strip(" ")) >= 20:
                sites[x.strip(" ")].add(None if i % 5 == 4 else i % 9)
                first.setdefault(x.strip(" "), (i, pos))
    for i, t in enumerate(texts):
        kept = [x for pos, x in enumerate((t or "").split("\n")) if len(sites.get(x.strip(" "), ())) < 8 or first[x.strip(" ")] == (i, pos)]
        assert got[i] == (None if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept))
    assert sum(LINE in (t or "") for t, _ in got.values()) == 1
    assert lines.cleaned(df.limit(0)).count() == 0


def test_line_dedup_by_sketch(spark):
    """A line on 40 sites is decided by its sketch alone, one on 9 and one on 7 by exact counts; null and repeated ids."""
    rows = [(i, f"A line that forty sites have in common.\nown text {i} of this very site" + ("\nA line that nine of the sites have." if i < 9 else "\nA line that seven sites have, or so." if i < 16 else ""), f"site{i}") for i in range(40)]
    rows += [(None, "A line that forty sites have in common.", "x"), (3, "own line of the repeated id\nA line that forty sites have in common.", "site3"), (50, None, None), (51, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"first": F.lit(1), "mark": F.lit(2), "_id": F.lit(3), "dropped": F.lit(4)})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.lines_removed) for r in lines.cleaned(df, min_sites=8).collect())
    want = []
    for i, t, _ in rows:
        drop = lambda x: i is not None and i > 0 and ("forty" in x or "nine" in x)  # noqa: B023, E731
        kept = [x for x in (t or "").split("\n") if not drop(x)]
        want.append((i if i is not None else -1, "\n".join(kept), len((t or "").split("\n")) - len(kept)))
    assert got == sorted(want)


# -- 9 --------------------------------------------------------------------


def brute_probabilities(cells, fraction, powers, targets):
    """{(source, lang, topic): probability} from {cell: tokens}, in plain Python: raking, then bisection of the scale."""
    total = sum(cells.values())
    share = []
    for d, (dim, power) in enumerate(zip(mixing.DIMS, powers, strict=True)):
        have = Counter()
        for c, t in cells.items():
            have[c[d]] += t
        raised = {k: v for k, v in targets.get(dim, {}).items() if have[k]} or {k: v**power for k, v in have.items() if v}
        share.append({k: v / sum(raised.values()) for k, v in raised.items()})
    w = {c: t / total for c, t in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            have = Counter()
            for c, x in w.items():
                have[c[d]] += x
            w = {c: x * share[d].get(c[d], 0) / have[c[d]] if have[c[d]] else 0 for c, x in w.items()}
        whole = sum(w.values())
        w = {c: x / whole for c, x in w.items()}
    kept = lambda s: sum(min(cells[c], s * x) for c, x in w.items())
    budget = min(fraction * total, sum(t for c, t in cells.items() if w[c]))
    low, high = 0.0, 1.0
    while kept(high) < budget * (1 - 1e-13) and high < 1e30:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < budget * (1 - 1e-13) else (low, mid)
    return {c: min(1.0, high * x / cells[c]) if cells[c] else 0.0 for c, x in w.items()}


SKEWED = {("hot", "en", "a"): 10**9, ("hot", "de", "b"): 10**9, ("rare", "en", "b"): 10, ("mid", "fr", "a"): 5000, ("mid", "en", "a"): 70, ("none", "en", "a"): 0}


@pytest.mark.parametrize("fraction, targets", [
    (0.6, {}), (0.6, {"source_key": {"rare": 0.999, "hot": 0.001}}), (0.3, {"source_key": {"absent": 1.0}, "topic": {"a": 3.0, "b": 1.0, "c": 9.0}}),
    (1.0, {"lang_key": {"en": 1.0}}), (0.5, {"source_key": {"hot": 0.0, "mid": 0.0, "rare": 0.0}}),
])
def test_mixing_cells(spark, monkeypatch, fraction, targets):
    """Both places of the arithmetic give each cell the probability of a plain loop."""
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    rows = spark.createDataFrame([(*c, t) for c, t in SKEWED.items()], "source_key string, lang_key string, topic string, tokens long")
    if targets.get("source_key", {}).get("hot") == 0.0:
        want = dict.fromkeys(SKEWED, 0.0)
    else:
        want = brute_probabilities(SKEWED, fraction, (0.5, 0.7, 0.7), targets)
    for cells in (100, 2):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", cells)
        got = {tuple(r)[:3]: r.probability for r in mixing.probabilities(rows, fraction, (0.5, 0.7, 0.7), targets).collect()}
        assert got == pytest.approx(want, rel=1e-9, abs=1e-18)


def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    at = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    want = [np.array([0.4, 0.3, 0.1, 0.1, 0.1]), np.full(4, 0.25), np.array([0.5, 0.3, 0.2])]
    w = mixing.rake(at, rng.random(60) + 0.01, want)
    assert all(np.allclose(np.bincount(a, w), t, atol=1e-8) for a, t in zip(at, want, strict=True))


def test_mixing_rows(spark):
    """Each document is kept if the hash of its id is below its cell's probability; nulls, empties, clashing columns."""
    texts = [f"word {i} " * (i % 40) for i in range(200)] + ODD + ["a | b | c | d | e | f", "word " * 700]
    df = docs(spark, texts, True).unionByName(docs(spark, ["no id", None], True).withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.sampled(df).collect()
    assert len(got) == len(texts) + 2 and got[0].asDict().keys() >= set(df.columns)
    cells = Counter()
    for r in got:
        n = len((r.text or "").split())
        key = (r.source or "(none)", r.lang or "(none)", r.topic)
        assert (r.source_key, r.lang_key) == key[:2] and r.tokens == n or "\x1c" in r.text
        cells[key] += r.tokens
    want = brute_probabilities(cells, 0.6, (0.5, 0.7, 0.7), {})
    draws = {r.doc_id: r.d for r in df.select("doc_id", mixing.draw(F.col("doc_id")).alias("d")).collect()}
    for r in got:
        assert r.probability == pytest.approx(want[r.source_key, r.lang_key, r.topic], rel=1e-6) and r.kept == (draws[r.doc_id] < r.probability)
    assert 0 < sum(r.kept for r in got) < len(got)
    given = mixing.sampled(df, topic=F.lit("t"), tokens=F.lit(7)).select("topic", "tokens").distinct().collect()
    assert [tuple(r) for r in given] == [("t", 7)]
    assert mixing.sampled(df.limit(0)).count() == 0


# -- 10 -------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit(d, lab.where(~out))
    got = quality.score(d, model).join(lab.where(out), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and (good >= 0.7).mean() > 0.97
    odd = quality.score(docs(spark, ODD, True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id < 2} == {model.prior}
    empty = quality.fit(d, lab.limit(0))
    assert {r.score for r in quality.score(docs(spark, ODD), empty).collect()} == {0.5}


def test_quality_equals_brute_force():
    """The vote of each document by a plain loop over all labelled vectors, in Python integers."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "&&&", "x!"], k=rng.randrange(1, 60))) for _ in range(150)] + ["word word word"] * 5 + [""]
    labels = np.array([i % 3 > 0 for i in range(60)] + [1, 0, 1], float)
    learned = texts[:60] + texts[150:153]  # equal texts among the labelled: ties
    model = quality.fit_arrays(quality.matrix(learned).astype(np.float32), labels, rank=8, k=5)
    got = model.score(quality.matrix(texts))
    vectors = model.embed(quality.matrix(texts)).astype(int).tolist()
    held = model.vectors.astype(int).tolist()
    for t, v, s in zip(texts, vectors, got, strict=True):
        best = sorted((-sum(a * b for a, b in zip(v, h, strict=True)), i) for i, h in enumerate(held))[:5]
        sims = [-b / quality.VECTOR_UNIT**2 for b, _ in best]
        weight = [math.exp(quality.SHARPNESS * (x - sims[0])) for x in sims]
        want = sum(w * labels[i] for w, (_, i) in zip(weight, best, strict=True)) / sum(weight) if t else model.prior
        assert s == pytest.approx(want, abs=1e-12)


def test_quality_equal_texts_and_odd_labels(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randrange(1, 300))) for _ in range(40)]
    texts = base * 30 + [None, ""] * 3
    d = docs(spark, texts, True)
    rows = [(i, i % 2) for i in range(30)] + [(30, 0), (30, 1), (31, 1), (31, 1), (None, 1), (32, None), (33, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(d, labels)
    assert len(model.labels) == 31 and model.prior == pytest.approx(16 / 31)
    got = {}
    for r in quality.score(d.repartition(7), model).collect():
        got.setdefault(texts[r.doc_id], set()).add(r.score)
    assert all(len(x) == 1 for x in got.values()) and got[None] == got[""] == {model.prior}
    again = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert len(quality.fit(again, labels).labels) == 1
    both = quality.with_score(d, model, "score")
    assert both.columns.count("score") == 1 and dict(both.dtypes)["score"] == "double" and both.count() == len(texts)
    assert quality.score(d.limit(0), model).count() == 0 and len(quality.fit(d.limit(0), labels).labels) == 0
