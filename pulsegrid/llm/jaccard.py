"""N-gram Jaccard self-join (operator 1).

Method: universe-partition pigeonhole.  A document is the set of 64-bit hashes
of its word shingles.  Sets are put into bands by size.  For the pairs whose
larger set is in a band, a similarity of at least num/den bounds the elements
in which two sets differ by H.  The universe of hashes is partitioned into
segments with quotas of 1 or 2 that sum to H + 1 or more, so in some segment
two linked sets differ by less than the quota.  Segments with quota 1 are
indexed by the hash of their subset; those with quota 2 also by those of its
one-deletion neighbours.  How many segments get which quota is decided for each
band from the number of sets of the whole corpus in it: more, smaller segments
cost fewer index rows but collide more.

Segments too small for their quota match nearly everything and are not indexed.
A set whose remaining quotas don't reach the sum repeats with another partition,
and on the last one indexes its empty segments too, so no pair is missed.

Each band has more segments than it needs, so linked sets share more than one
of its keys.  Each set drops its most frequent keys of a band, as many as it may
without losing a link (``signatures``).  The order of keys is the same for all
sets, so the least frequent key that linked sets share stays in both.  So
passages that many documents share, which fill whole segments of long ones,
propose next to no pairs, and how many don't grow with the square of the data.

Equal sets are one node from the start.  Pairs are verified exactly, on the
sets of both whole texts.  A bucket first proposes one node, chosen by a hash
of node and bucket, to all others (a star); so a node of a large group meets
other centres in other buckets.  Components of the verified links are formed;
then pairs inside a bucket that are still in different components, and those
alone, are verified.  So a large group of near copies costs one check a member
and bucket centre, not one a pair, and no link between components is lost.
Before texts are compared, pairs must pass an exact bound: a parity sketch has
a bit for each of 1,024 parts of the universe, set if the set has an odd number
of elements there, and two sketches differ in no more bits than the sets in
elements.  Pairs of larger sets must pass it again with a sketch that has at
least as many bits as the set has elements.

Defined cases: null and empty texts, and texts without words, have the empty
set and link with nothing; fewer words than a shingle are one shingle; rows
that repeat a document link with it; rows without an id get no component;
extra columns are ignored.  Shingles stand as their 64-bit hashes, also in the
exact check: two different shingles of a pair of texts with n shingles together
share one with a chance of about n^2 / 2^65.  Set hashes of 64 bits are checked
against a second one; on a collision the work is done again with another seed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, fits, stored

BAND_RATIO = 1.35
ATTEMPTS = 3
WORD_CACHE = 400_000
SEEN_SETS = 500_000
INDEX_ROWS = 100_000
SKETCH_WORDS = 16
BROADCAST_ROWS = 2_000_000
#: Spare agreements that each linked pair has beyond the one it needs: a share of the elements in which it may differ, and
#: in sets that have room for more segments at least so many.  The keys of form letters, which share all but a few words,
#: are frequent; the smaller the segments, the more of a set's keys have one of its own words and are rare.
SPARE, SMALL_SPARE = 0.25, 16
#: Low bits of an index key that hold the band.
BAND_BITS = 6
#: For the cost model: a check costs as much as so many index rows; two documents share a passage of so many
#: shingles with this chance, once frequent keys are dropped.
CHECK_COST, PASSAGE, PASSAGE_SHARE = 50, 20, 0.00005

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; words are runs of bytes other than ASCII white space, with A-Z in lower case."""

    def __init__(self, shingle: int, seed: int = 0):
        self.shingle, self.seed, self.words = shingle, seed, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        held, seed, digest = self.words, self.seed, xxhash.xxh3_64_intdigest
        get = held.get
        each = np.array([get(w) or held.setdefault(w, digest(w, seed)) for w in words], np.uint64)
        if len(each) < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(each.tobytes(), self.seed + 1)], np.uint64)
        n = len(each) - self.shingle + 1
        h = each[:n]
        for k in range(1, self.shingle):
            h = mixed(h + _GOLD) + each[k : n + k]
        return np.unique(mixed(h))


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den."""

    num: int
    den: int

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or self.num * max(len(a), len(b)) > self.den * min(len(a), len(b)):
            return False
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        common = int((large[at] == small).sum())
        return self.den * common >= self.num * (len(a) + len(b) - common)

    def differ(self, most: int) -> int:
        """Most elements in which linked sets of up to ``most`` elements can differ."""
        return (self.den - self.num) * 2 * most // (self.den + self.num)


def band_edges(most: int) -> list[int]:
    """Least size of each band, up to the one that holds ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, ceil(edges[-1] * BAND_RATIO)))
    return edges


@dataclass(frozen=True)
class Band:
    """Segments of a band: the first ``double`` have quota 2, the others quota 1; linked sets share over ``spare`` keys."""

    low: int
    differ: int
    single: int
    double: int
    spare: int = 0

    @property
    def quota(self) -> int:
        """Quotas that a set must hold: linked sets then agree in segments of at least ``spare + 1`` keys."""
        return self.differ + 1 + self.spare * (2 if self.double else 1)


def plan_band(low: int, high: int, threshold: Threshold, sets: int) -> Band:
    """The cheapest segments for the pairs whose larger set has low..high elements, of which the corpus has ``sets``."""
    differ, best = threshold.differ(high), None
    if not differ:
        return Band(low, 0, 0, 0)  # linked sets are equal
    more = max(int(differ * SPARE), min(SMALL_SPARE, low // 2 - differ))
    for double in range((differ + 1) // 2 + more + 1):
        need = Band(low, differ, 0, double, more).quota
        if 2 * double > need:
            break
        single = need - 2 * double
        for _ in range(3):  # spare segments for those too small for their quota
            z = low / (single + double)
            lost1, lost2 = exp(-z), exp(-z) * (1 + z)
            spare = single * lost1 + 2 * double * lost2 + sqrt(single * lost1 + 4 * double * lost2)
            single = need - 2 * double + ceil(spare) if double * 2 + single < need + spare else single
        z = (low + high) / 2 / (single + double)
        rows = single + double * (1 + z)
        clash = CHECK_COST * sets * PASSAGE_SHARE * PASSAGE * exp(-2 * z) * (1 if not double else 1 + z * double / (single + double))
        if best is None or rows + clash < best[0]:
            best = (rows + clash, Band(low, differ, single, double, more))
    return best[1]


def signatures(elements: np.ndarray, number: int, band: Band) -> tuple[np.ndarray, int]:
    """The index keys of a set in a band, and how many of them, the most frequent ones, it may drop.

    Where one partition with quotas 1 serves, a linked set disagrees in at most
    ``differ`` of the segments, so all but the ``differ + 1`` least frequent keys
    may go; else ``spare``, which linked sets always share beyond one.
    """
    k, out = band.single + band.double, []
    if not k:
        return np.zeros(0, np.uint64), 0
    quota = np.ones(k, np.int64)
    quota[: band.double] = 2
    place = np.arange(k, dtype=np.uint64)
    for attempt in range(ATTEMPTS):
        salt = mixed(np.array([number * 1_000_003 + attempt * 7919 + 1], np.uint64))
        spread = mixed(elements ^ salt)
        seg = (spread % np.uint64(k)).astype(np.int64)
        value = mixed(spread + _GOLD)
        total, count = np.zeros(k, np.uint64), np.bincount(seg, minlength=k)
        np.add.at(total, seg, value)
        tag = mixed(place * _GOLD + salt)
        enough = count >= quota
        full = bool(quota[enough].sum() >= band.quota)
        last = attempt == ATTEMPTS - 1 and not full
        out.append(mixed(total[(count > 0) | last] ^ tag[(count > 0) | last]))
        if band.double:
            cut = (seg < band.double) & ((count[seg] > 1) | last)
            s = seg[cut]
            out.append(mixed((total[s] - value[cut]) ^ tag[s]))
        if full:
            break
    mask = np.uint64((1 << BAND_BITS) - 1)
    keys = np.unique(np.concatenate(out) & ~mask | np.uint64(number) & mask)
    return keys, len(keys) - band.differ - 1 if len(out) == 1 else band.spare


def all_signatures(elements: np.ndarray, edges: list[int], bands: list[Band], threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Keys in the set's own band and in those of larger partners that it can link with, and what each band's may drop."""
    n, out, drops = len(elements), [], []
    own = int(np.searchsorted(edges, n, side="right")) - 1
    for b in range(own, len(bands)):
        if b > own and threshold.den * n < threshold.num * bands[b].low:
            break
        keys, drop = signatures(elements, b, bands[b])
        out.append(keys)
        drops.append(np.full(len(keys), drop, np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(drops) if out else np.zeros(0, np.int32)


def sketch(elements: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of the number of elements in each of 64 * words parts of the universe, as signed 64-bit words.

    ``words`` is a power of two; the XOR of the two halves of a sketch is the sketch of half the words.
    """
    part = (mixed(elements + _M1) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def long_sketch(elements: np.ndarray) -> np.ndarray | None:
    """A sketch with a bit or more for each element, where the common one has fewer."""
    n = len(elements)
    return sketch(elements, 1 << (n - 1).bit_length() - 6) if n > 64 * SKETCH_WORDS else None


# -- tables -------------------------------------------------------------

PARITY = [f"p{i}" for i in range(SKETCH_WORDS)]


def _may_link(threshold: Threshold, a: str, b: str):
    """Condition on sizes and sketches of two nodes, whose columns begin with ``a`` and ``b``: it never excludes linked sets."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITY])
    sized = F.lit(threshold.num) * F.greatest(na, nb) <= F.lit(threshold.den) * F.least(na, nb)
    return sized & _near(threshold, apart, na + nb)


def _near(threshold: Threshold, apart, elements):
    """Whether sets of so many elements together can be linked if they differ in ``apart`` elements or more."""
    return apart * F.lit(threshold.num + threshold.den) <= F.lit(threshold.den - threshold.num) * elements


def _refined(pairs: DataFrame, sketches: DataFrame, threshold: Threshold) -> DataFrame:
    """The (a, b) of ``pairs`` without those of two larger sets whose long sketches exclude a link."""
    side = lambda x: sketches.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("long").alias(f"{x}_long"))
    held = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    words = F.least(F.size("a_long"), F.size("b_long"))

    def folded(x):  # lengths are powers of two; pairs that differ by more than one doubling stay
        return F.when(F.size(x) == words, F.col(x)).otherwise(F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q)))

    apart = F.aggregate(F.zip_with(folded("a_long"), folded("b_long"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    unsure = F.col("a_long").isNull() | F.col("b_long").isNull() | (F.greatest(F.size("a_long"), F.size("b_long")) > 2 * words)
    return held.where(unsure | _near(threshold, apart, F.col("a_n") + F.col("b_n"))).select("a", "b")


def _sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, mark, n, sid, chk, sketch words, long): size and two hashes of the set; sid is null where there is nothing to link."""

    def run(batches):
        make = Shingler(shingle, seed)
        for b in batches:
            n, sid, chk, marks, longs = [], [], [], [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = make(text)
                n.append(len(s))
                both = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
                some = len(s) and name is not None
                sid.append((both & (1 << 64) - 1) - (1 << 63) if some else None)
                chk.append((both >> 64) - (1 << 63) if some else None)
                marks.append(sketch(s))
                longs.append(long_sketch(s) if some else None)
            words = np.array(marks, np.int64).reshape(-1, SKETCH_WORDS).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n, sid, chk, *words)), pa.array(longs, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "sid", "chk", *PARITY, "long"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n long, sid long, chk long, " + ", ".join(f"{p} long" for p in PARITY) + ", long array<long>")


def _index(docs: DataFrame, shingle: int, seed: int, threshold: Threshold, edges: list[int], bands: list[Band]) -> DataFrame:
    """(sig, sid, drop) rows; a set that a task has seen already is not indexed again.

    They leave a task in batches of about ``INDEX_ROWS``, whatever the number and length of the texts that come in at once.
    """

    def run(batches):
        make, seen, held, size = Shingler(shingle, seed), set(), [], 0
        for b in batches:
            for text in b.column(0):
                s = make(text.as_py())
                if not len(s):
                    continue
                sid = (xxhash.xxh3_128_intdigest(s.tobytes(), seed) & (1 << 64) - 1) - (1 << 63)
                if sid in seen:
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(sid)
                k, drop = all_signatures(s, edges, bands, threshold)
                if len(k):
                    held.append((k.view(np.int64), np.full(len(k), sid, np.int64), drop))
                    size += len(k)
                if size >= INDEX_ROWS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["sig", "sid", "drop"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "sig long, sid long, drop int")


def _without_frequent(index: DataFrame) -> DataFrame:
    """(sig, sid) without the ``drop`` most frequent keys of each set in each band; keys that only one set has are gone already.

    All sets order keys alike, by the rows held and the key, and linked sets
    share more keys of a band than either may drop, so the least frequent shared
    key stays in both.
    """
    # bands whose numbers have the same low bits differ too much in size to hold one set
    band = F.col("sig").bitwiseAND(F.lit((1 << BAND_BITS) - 1))
    frequent = Window.partitionBy("sid", "band").orderBy(F.desc("held"), "sig")
    ranked = index.withColumn("band", band.cast("int")).withColumn("_at", F.row_number().over(frequent))
    return ranked.where(F.col("_at") > F.col("drop")).select("sig", "sid")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, seed: int, threshold: Threshold) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked.  Only texts of sets in pairs travel."""
    nodes = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = stored(reps.join(nodes, "sid").select("sid", F.col("rep").alias("doc_id")), "nodes")
    texts = docs.join(F.broadcast(wanted) if fits(wanted, BROADCAST_ROWS) else wanted, "doc_id").select("sid", "text")
    # an id that repeats may stand for several texts: only the one that makes the set counts, which run() checks
    held = pairs.join(texts.withColumnsRenamed({"sid": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"sid": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        make, last = Shingler(shingle, seed), (None, None, False)
        sid = lambda s: (xxhash.xxh3_128_intdigest(s.tobytes(), seed) & (1 << 64) - 1) - (1 << 63)
        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != a or last[3] != ta:
                    s = make(ta)
                    last = (a, s, sid(s) == a, ta)
                ok.append(last[2] and threshold.linked(last[1], s := make(tb)) and sid(s) == b)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return held.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(sid, label): the smallest node reachable from each node of the (a, b) edges, by smallest labels and pointer jumps."""
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    held = labels = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = labels.join(around, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("u").alias("m"), F.col("l").alias("to"))
        new = stored(lower.join(jump, "m").select("u", F.least("m", "to").alias("l"), (F.least("m", "to") != F.col("l")).alias("moved")), "labels")
        discard(held)
        held, labels = new, new.select("u", "l")
        if not new.where("moved").limit(1).count():
            return labels.select(F.col("u").alias("sid"), F.col("l").alias("label"))


def linked_documents(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, mark, component) for every row.

    component_id is the smallest doc_id reachable by links; ``component`` tells
    components apart even where ids repeat, and is null for rows that link with
    nothing by definition; ``mark``, a hash of the text, tells rows apart that
    repeat an id.
    """
    threshold = Threshold(num, den)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    for seed in range(0, 100, 10):
        sets = stored(_sets(docs, shingle, seed), "sets")
        grouped = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("chk").alias("c1"), F.max("chk").alias("c2"), *[F.max(p).alias(p) for p in PARITY])
        grouped = stored(grouped, "distinct-sets")
        if not grouped.where("c1 <> c2").limit(1).count():
            break
    reps, thin = grouped.select("sid", "rep", "n"), grouped.select("sid", "n", *PARITY)
    ends = lambda side: thin.select(F.col("sid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *PARITY)])
    most = reps.agg(F.max("n")).first()[0] or 0
    edges = band_edges(most)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n"))) - 1
    held = {r.band: r["count"] for r in reps.groupBy(at.alias("band")).count().collect()}  # one row a band
    bands = [plan_band(lo, hi - 1, threshold, held.get(i, 0) + held.get(i - 1, 0)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]

    bucket = Window.partitionBy("sig")
    index = _index(docs, shingle, seed, threshold, edges, bands)
    index = index.withColumn("lo", F.min("sid").over(bucket)).withColumn("hi", F.max("sid").over(bucket)).withColumn("held", F.count("*").over(bucket))
    index = held_keys = stored(index.where("lo <> hi").drop("lo", "hi").dropDuplicates(["sig", "sid"]), "shared-keys")
    centre = F.min(F.struct(F.xxhash64("sid", "sig").alias("_order"), F.col("sid"))).over(bucket)
    index = _without_frequent(index).withColumn("lo", F.min("sid").over(bucket)).withColumn("hi", F.max("sid").over(bucket)).withColumn("c", centre["sid"])
    index = stored(index.where("lo <> hi").drop("lo", "hi"), "buckets")
    discard(held_keys)
    nodes = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    star = nodes(index.where("c <> sid"), "c", "sid").join(ends("b"), "b").join(ends("a"), "a").where(_may_link(threshold, "a_", "b_"))
    sketches = stored(sets.where("long is not null").select("sid", "n", "long").dropDuplicates(["sid"]), "long-sketches")
    star = stored(star.select("a", "b"), "stars")
    links = stored(_verified(stored(_refined(star, sketches, threshold), "refined"), docs, reps, shingle, seed, threshold), "links")
    comp = components(links)

    labelled = index.select("sig", "sid").join(comp, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    labelled = labelled.withColumn("l1", F.min("label").over(bucket)).withColumn("l2", F.max("label").over(bucket)).where("l1 <> l2").select("sig", "sid", "label")
    open_rows = stored(labelled.join(thin, "sid"), "open-buckets")
    side = lambda x: open_rows.select("sig", F.col("sid").alias(x), F.col("label").alias(f"{x}_label"), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *PARITY)])
    left, right = side("a"), side("b")
    across = left.join(right, (left["sig"] == right["sig"]) & (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")) & _may_link(threshold, "a_", "b_")).select("a", "b").distinct()
    across = stored(_refined(stored(across.join(star, ["a", "b"], "left_anti"), "across"), sketches, threshold), "refined")
    more = stored(_verified(across, docs, reps, shingle, seed, threshold), "links")
    if more.limit(1).count():
        comp = components(links.unionByName(more))

    named = reps.join(comp, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    roots = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("sid", "component_id", F.col("label").alias("component"))
    return sets.join(roots, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark", "component")
