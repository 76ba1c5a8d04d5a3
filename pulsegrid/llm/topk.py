"""Exact top-k search by inner product with a bit-sliced index (operator 4).

Method: vectors are quantised to integers and cut into segments of rows.  In a
segment every dimension's high bits are stored as bitmaps, one for each bit
(slice).  For a block of queries the weighted slices are added with carry-save
adders on bitmaps, giving a coarse score in bit-sliced form.  The k-th largest
coarse score is found from the most significant slice downward; the low bits
left out bound the error, so the rows that may still belong to the top k are
known, and these boundary rows get their exact integer scores.  A task keeps
the k best rows of each query over all its segments; the k-th bounds what
later segments must reach.

Segments are built where the rows are and stay there: no vector is shuffled.
Queries go to the segments in broadcasts of about ``QUERY_VALUES`` components,
one pass over the index each; a task sends on k rows a query at most.

Vectors whose products could leave 64 bits are kept apart, as doubles; pairs
with one of them get exact scores in integers of any length.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do null ids; all other finite components count,
however large; vectors of different lengths don't meet; a query meets every row
but its own, so a repeated row meets its repeats, and each repeat of a query has
rows of its own; fewer than k candidates give fewer rows; ties go to the smaller
id; scores beyond 64 bits are ranked exactly and shown as the nearest long;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import nsmallest
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SEGMENT_ROWS = 8192
QUERY_ROWS = 128
QUERY_VALUES = 1 << 20
DROPPED_BITS = 3
#: Bits of a component that are sliced, at most; rows with larger ones are decided more often by exact scores.
SLICES = 12
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, x array<double>) of the rows that take part; ``row`` tells repeated rows apart once it is stored."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def exact(v: float, scale: int) -> int:
    """floor(scale * v) of a finite double, also where the product is no double."""
    return floor(scale * v) if abs(v) < 1e300 else int(v) * scale


def split_wide(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(quantised rows as doubles, whether a row is wide): products of rows that are not wide sum to less than 2^61."""
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    return q, np.abs(q).max(axis=1) > isqrt((1 << 61) // x.shape[1])


def slices(x: np.ndarray, dropped: int) -> tuple[np.ndarray, int]:
    """Bitmaps of the high bits of x - min(x): (dims, bits, words); and the minimum."""
    low = int(x.min())
    high = (x - low) >> dropped
    bits = max(1, int(high.max()).bit_length())
    rows = -(-len(x) // 64) * 64
    out = np.zeros((x.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((x.shape[1], rows), np.uint8)
        plane[:, : len(x)] = ((high >> b) & 1).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out, low


def coarse_sum(index: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Bit-sliced sums over dimensions of |q| * high, with high complemented where q < 0: a (queries, words) bitmap a bit."""
    size, sign = np.abs(q), np.where(q < 0, _ALL, np.uint64(0))
    waiting: list[list[np.ndarray]] = []

    def put(at: int, bitmap: np.ndarray) -> None:
        while True:
            while len(waiting) <= at:
                waiting.append([])
            held = waiting[at]
            held.append(bitmap)
            if len(held) < 3:
                return
            a, b, c = held
            half = a ^ b
            waiting[at] = [half ^ c]
            bitmap, at = (a & b) | (half & c), at + 1

    for d in range(index.shape[0]):
        masks = [(j, np.where((size[:, d] >> j) & 1, _ALL, np.uint64(0))[:, None]) for j in range(int(size[:, d].max()).bit_length())]
        masks = [(j, m) for j, m in masks if m.any()]
        for b in range(index.shape[1]):
            own = index[d, b][None, :] ^ sign[:, d][:, None]
            for j, mask in masks:
                put(b + j, own & mask)
    out, at = [], 0
    zero = np.zeros((len(q), index.shape[2]), np.uint64)
    while at < len(waiting):
        held = waiting[at]
        if len(held) == 2:  # a half adder ends each position
            waiting[at] = [held[0] ^ held[1]]
            put(at + 1, held[0] & held[1])
            held = waiting[at]
        out.append(held[0] if held else zero)
        at += 1
    return out or [zero]


def _popcount(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)


def kth_largest(sums: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest coarse score of each query among ``alive`` rows, from the most significant slice downward."""
    equal, above = np.repeat(alive[None, :], len(sums[0]), 0), np.zeros(len(sums[0]), np.int64)
    value = np.zeros(len(sums[0]), np.int64)
    for p in range(len(sums) - 1, -1, -1):
        ones = equal & sums[p]
        n = _popcount(ones)
        take = above + n >= k
        value += take.astype(np.int64) << p
        above += np.where(take, 0, n)
        equal = np.where(take[:, None], ones, equal & ~sums[p])
    return value


def at_least(sums: list[np.ndarray], alive: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose coarse score is ``value`` or more."""
    equal, above = np.repeat(alive[None, :], len(sums[0]), 0), np.zeros_like(sums[0])
    for p in range(len(sums) - 1, -1, -1):
        bit = ((value >> p) & 1).astype(bool)[:, None]
        above |= np.where(bit, np.uint64(0), equal & sums[p])
        equal &= np.where(bit, sums[p], ~sums[p])
    return above | equal


def block_top(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, index: np.ndarray, low: int, dropped: int, qrows: np.ndarray, q: np.ndarray, best: list[list[tuple[int, int, int]]], k: int) -> None:
    """Merge the rows of one segment into ``best``, the k best (-score, vec_id, row) of each query of a block."""
    alive = np.packbits(np.arange(index.shape[2] * 64) < len(x), bitorder="little").view(np.uint64)
    sums = coarse_sum(index, q)
    kth = kth_largest(sums, alive, min(len(x), k + 1))  # the query's own row goes later
    # each low part is between 0 and 2^dropped - 1, so exact scores differ from coarse ones by less than this many units
    up, down = np.where(q > 0, q, 0).sum(axis=1), np.where(q < 0, -q, 0).sum(axis=1)
    bound = np.maximum(kth - up - down, 0)
    for i, held in enumerate(best):
        if len(held) == k and (reach := -held[-1][0]) > LEAST // 2:
            # score = low * sum(q) + (coarse - what complements added) * 2^dropped + less than up * 2^dropped
            added = int(down[i]) * ((1 << index.shape[1]) - 1)
            bound[i] = max(int(bound[i]), min(added + (min(reach, MOST // 2) - low * int(q[i].sum()) >> dropped) - int(up[i]), MOST))
    near = at_least(sums, alive, bound) & np.where(bound >> len(sums) > 0, np.uint64(0), _ALL)[:, None]
    for i in np.flatnonzero(near.any(axis=1)):
        at = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), count=len(x), bitorder="little"))
        at = at[rows[at] != qrows[i]]
        score = x[at].astype(np.int64) @ q[i]
        first = np.lexsort((ids[at], -score))[:k]
        best[i] = nsmallest(k, best[i] + [(-int(score[j]), int(ids[at[j]]), int(rows[at[j]])) for j in first])


def exact_top(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, qrow: int, q: np.ndarray, best: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """The same for one query in integers of any length; x and q hold Python integers."""
    scores = x @ q
    return nsmallest(k, best + [(-s, i, r) for s, i, r in zip(scores.tolist(), ids.tolist(), rows.tolist(), strict=True) if r != qrow])


def _order(score: int) -> str:
    """Tells scores apart that are shown as the same long: a larger score has the larger text."""
    if LEAST <= score <= MOST:
        return ""
    digits = f"{abs(score):x}"
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99_999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


SEGMENT = "dims long, wide boolean, rows binary, ids binary, x binary, kind string, low long, dropped long, slices binary, bits long"


def segments(rows: DataFrame, scale: int, segment_rows: int = SEGMENT_ROWS, dropped_bits: int = DROPPED_BITS) -> DataFrame:
    """The index of ``usable`` rows: a row for each segment, built without a shuffle."""

    def pack(dims: int, wide: bool, part: list) -> pa.RecordBatch:
        rows = np.array([p[0] for p in part], np.int64)
        ids = np.array([p[1] for p in part], np.int64)
        x = np.array([p[2] for p in part], np.float64)
        low = dropped = bits = 0
        index, kind = b"", "f8"
        if not wide:
            x = x.astype(np.int64)
            dropped = max(dropped_bits, int(x.max() - x.min()).bit_length() - SLICES)
            planes, low = slices(x, dropped)
            index, bits = planes.tobytes(), planes.shape[1]
            kind = np.promote_types(np.min_scalar_type(int(x.min())), np.min_scalar_type(-abs(int(x.max())) - 1)).str[1:]
        values = (dims, wide, rows.tobytes(), ids.tobytes(), x.astype(kind).tobytes(), kind, low, dropped, index, bits)
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[f.split(" ")[0] for f in SEGMENT.split(", ")])

    def run(batches):
        held = defaultdict(list)
        for b in batches:
            x = b.column(2)
            flat, size = x.flatten().to_numpy(), np.diff(x.offsets.to_numpy())
            ends = np.cumsum(size)
            names, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                own = flat[(ends[at] - dims)[:, None] + np.arange(dims)]
                q, wide = split_wide(own, scale)
                for i, r, f, w in zip(at, own, q, wide, strict=True):
                    part = held[dims, bool(w)]
                    part.append((names[i], ids[i], r if w else f))
                    if len(part) == segment_rows:
                        yield pack(dims, bool(w), held.pop((dims, bool(w))))
            while sum(map(len, held.values())) > 4 * segment_rows:
                key = max(held, key=lambda k: len(held[k]))
                yield pack(*key, held.pop(key))
        for key, part in held.items():
            yield pack(*key, part)

    return rows.mapInArrow(run, SEGMENT)


def _query_blocks(got: pa.Table, scale: int, query_rows: int) -> list[tuple]:
    """(dims, wide, rows, ids, vectors) blocks of queries of one length."""
    by, out = defaultdict(list), []
    for row, name, x in zip(got["row"].to_pylist(), got["vec_id"].to_pylist(), got["x"], strict=True):
        x = x.values.to_numpy()
        q, wide = split_wide(x[None], scale)
        by[len(x), bool(wide[0])].append((row, name, x if wide[0] else q[0]))
    for (dims, wide), part in by.items():
        for lo in range(0, len(part), query_rows):
            block = part[lo : lo + query_rows]
            x = np.array([p[2] for p in block], np.float64)
            out.append((dims, wide, np.array([p[0] for p in block], np.int64), [p[1] for p in block], x if wide else x.astype(np.int64)))
    return out


def _integers(x: np.ndarray, wide: bool, scale: int) -> np.ndarray:
    """Vectors as Python integers."""
    if not wide:
        return x.astype(object)
    return np.array([[exact(v, scale) for v in r] for r in x.tolist()], object).reshape(x.shape)


FOUND = "query_row long, query_id long, vec_id long, score long, beyond string"


def top_k(df: DataFrame, queries, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS, dropped_bits: int = DROPPED_BITS, query_values: int = QUERY_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of ``df`` that satisfies ``queries``, a condition on vec_id."""
    spark = df.sparkSession
    rows = stored(usable(df, id_col, vec_col), "vectors")
    index = stored(segments(rows, scale, segment_rows, dropped_bits), "bit-slices")
    asked = rows.where(queries)
    passes = max(1, -(-(asked.agg(F.sum(F.size("x"))).first()[0] or 0) // query_values))

    def search(held):
        def run(batches):
            blocks, best = held.value, [[[] for _ in b[2]] for b in held.value]
            for batch in batches:
                for r in batch.to_pylist():
                    x = np.frombuffer(r["x"], r["kind"]).reshape(-1, r["dims"])
                    ids, names = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                    planes = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], -1) if not r["wide"] else None
                    whole = None
                    for (dims, wide, qrows, _, q), own in zip(blocks, best, strict=True):
                        if dims != r["dims"]:
                            continue
                        if not wide and not r["wide"]:
                            block_top(ids, names, x, planes, r["low"], r["dropped"], qrows, q, own, k)
                            continue
                        whole = _integers(x, r["wide"], scale) if whole is None else whole
                        for i, one in enumerate(_integers(q, wide, scale)):
                            own[i] = exact_top(ids, names, whole, int(qrows[i]), one, own[i], k)
            for (_, _, qrows, qids, _), own in zip(blocks, best, strict=True):
                out = [(int(n), q, i, min(max(-s, LEAST), MOST), _order(-s)) for n, q, top in zip(qrows, qids, own, strict=True) for s, i, _ in top]
                if out:
                    types = [*[pa.int64()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split(" ")[0] for f in FOUND.split(", ")])

        return run

    found = []
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).toArrow()  # about query_values components
        held = spark.sparkContext.broadcast(_query_blocks(own, scale, query_rows))
        found.append(stored(index.mapInArrow(search(held), FOUND), "found"))
        held.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), F.asc("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
