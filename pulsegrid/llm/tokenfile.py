"""Token-id files with an adaptive context-mixing range coder (operator 2).

Method: ids are cut into blocks.  Each block starts from a reset model and has
a CRC-32 of its ids.  In a block the order-2 context (two ids before) and the
order-1 context (one id before) each predict one id.  Whether the order-2
prediction holds is coded with a probability mixed, in the logistic domain and
with weights learned as it goes, from three adaptive predictors: confidence of
order 2, confidence of order 1, and how often the predicted id has occurred
(order 0), the first two each with their agreement.  If it fails the order-1
prediction is tried; if that fails too the id itself is coded by adaptive
order-0 distributions, four bits at a time.  All arithmetic is in integers, so
every machine decodes alike.  Ids may have up to 28 bits; larger ones are an
error.

Tables are coded by the JVM, a block at a time: ``tokencode.java``, which Spark's
own compiler (Janino) compiles once an application.  The same coder is here in
NumPy for files outside of Spark and for tests; blocks are independent, so there
one NumPy operation serves one position of all blocks of a group.

A file holds groups of blocks, then an index of (doc_id, number of ids) with a
checksum of its own.  Files are in ascending doc_id order inside and among each
other; the manifest gives the number of the first id of each.  A task starts
another file after ``FILE_IDS`` ids, and readers hold one group at a time, so
memory depends neither on the corpus nor on the number of partitions.

The ids are the library's.  It is asked once for each run without white space
(see ``Memo``), since runs repeat, and under the splitting rule in ``FINE`` once
for each word, digit or group of signs of ASCII and Latin-1 letters (see
``Split`` in ``tokencode.java``); tests compare with whole texts over all code points.

Defined cases: null and empty texts hold the end id only; rows without an id
come first; rows that repeat an id follow one another in the order of their
texts; an empty table gives no file; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import exp, log
from string import Template

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, planned_bytes, stored

MAGIC = b"PGTOKEN2"
#: A group has at most so many blocks of so many ids; its model takes 77 KB a block.
LANES, BLOCK_IDS, LEAST_BLOCK = 1024, 4096, 512
GROUP_IDS = LANES * BLOCK_IDS
#: A file ends with the documents that reach one of these.
FILE_IDS, FILE_DOCS = 8 * GROUP_IDS, 1 << 20
#: The memo of runs starts anew beyond so many runs or characters; texts are encoded in lots of about so many characters.
CACHE_RUNS, CACHE_CHARS, LOT_CHARS = 250_000, 16 << 20, 2 << 20
#: A task's numbers of runs start anew beyond so many runs, or CACHE_CHARS bytes of them.
TASK_RUNS = 1 << 19
#: Tables are coded in groups of so many ids: few enough for rows of a table; the JVM needs no lanes.
ROW_IDS = 1 << 18
#: The rule under which runs may be cut into words, digits and other signs, and ASCII letters made small, before the library is asked.
FINE = (
    ["NFC", ("Replace", "\\s+", " "), "Lowercase"],
    [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "Removed", True), ("ByteLevel", False, False)],
)
#: Between runs that the library encodes together: a sign that is a piece of its own, and whose id no run has that is without it.
MARK, MARKED = "\x01", 500
#: Bytes of input (as the planner estimates it) a partition.
PARTITION_BYTES = 32 << 20

# -- model --------------------------------------------------------------

PAIR_BITS, LAST_BITS, OFTEN_BITS, DEEP_BITS = 12, 12, 10, 10
#: Logistic domain: stretch(p) for 12-bit p, and its inverse for -2047..2047.
STRETCH = np.array([max(-2047, min(2047, round(256 * log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
SQUASH = np.array([max(64, min(65472, round(65536 / (1 + exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
#: Distributions of four bits: their whole, and by depth how fast they learn and the least width of a digit.
WHOLE, RATES, WIDTHS = 1 << 14, (5, 5, 4, 3), (4, 4, 8, 24)
TARGETS = [np.array([[i * w if i <= d else WHOLE - (16 - i) * w for i in range(17)] for d in range(16)], np.int16) for w in WIDTHS]
ROW = np.dtype("V34")
TARGET_ROWS = [t.view(ROW)[:, 0] for t in TARGETS]
_K1, _K2, _K3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_S16, _S28, _S32, _LEAST, _LOW = np.uint64(16), np.uint64(28), np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)


class _Lanes:
    """Models of a group of blocks, one lane each, and the width of each coder's interval."""

    def __init__(self, n: int, levels: int):
        self.n, self.levels, self.row = n, levels, np.arange(n)
        self.pair, self.single = np.zeros(n << PAIR_BITS, np.int32), np.zeros(n << LAST_BITS, np.int32)
        self.often, self.second = np.zeros(n << OFTEN_BITS, np.uint8), np.full(n * 64, 1 << 14, np.int32)
        self.odds, self.weight = np.full(n * 48, 1 << 15, np.int32), np.full((3, n), 22_000, np.int32)
        self.odds_at = self.row * 48 + np.array([[0], [16], [32]])
        self.bits = [min(4 * k, DEEP_BITS) for k in range(levels)]
        # a distribution is one item of 34 bytes, which NumPy gathers and scatters faster than a row of 17 numbers
        self.digits = [np.tile((np.arange(17) * (WHOLE // 16)).astype(np.int16), (n << b, 1)).view(ROW)[:, 0] for b in self.bits]
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.range = np.full(n, (1 << 48) - 1, np.uint64)

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes only: the others have ended."""
        self.n, self.row, self.weight, self.odds_at = n, self.row[:n], self.weight[:, :n], self.odds_at[:, :n]
        self.last, self.before, self.range = self.last[:n], self.before[:n], self.range[:n]

    def predict(self) -> None:
        """Guesses g2 and g1, and their probabilities p2 and p1 in units of 2^-16; p1 is 0 where the guesses agree."""
        row, h = self.row, self.last * _K1
        self.at1 = (row << LAST_BITS) + (h >> np.uint32(32 - LAST_BITS))
        self.at2 = (row << PAIR_BITS) + ((h ^ self.before * _K2) * _K3 >> np.uint32(32 - PAIR_BITS))
        e2, e1 = self.pair[self.at2], self.single[self.at1]
        self.g2, self.g1, self.s2, self.s1 = e2 >> 3, e1 >> 3, e2 & 7, e1 & 7
        self.other = self.g1 != self.g2
        self.at0 = (row << OFTEN_BITS) + (self.g2.astype(np.uint32) * _K1 >> np.uint32(32 - OFTEN_BITS))
        at = self.odds_at.copy()
        at[0] += (self.s2 << 1) + self.other
        at[1] += (self.s1 << 1) + self.other
        at[2] += self.often[self.at0]
        self.odd, self.p = at, self.odds[at]
        self.inputs = STRETCH[self.p >> 4]
        self.p2 = SQUASH.take(((self.inputs * self.weight).sum(0) >> 16) + 2047, mode="clip")
        self.at3 = (row << 6) + (self.s1 << 3) + self.s2
        self.q = self.second[self.at3]
        self.p1 = ((65_536 - self.p2) * (self.q >> 8) >> 8) * self.other

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        target = hit2.astype(np.int32) * 65_535
        error = target - self.p2
        self.weight += self.inputs * error >> 14
        self.odds[self.odd] = self.p + (target - self.p >> 5)
        ask = np.flatnonzero(~hit2 & self.other)
        q = self.q[ask]
        self.second[self.at3[ask]] = q + (hit1[ask] * 59_392 + 2_048 - q >> 5)
        new = ids << 3
        for table, at, guess, sure in ((self.pair, self.at2, self.g2, self.s2), (self.single, self.at1, self.g1, self.s1)):
            kept = (guess << 3) + np.where(guess == ids, np.minimum(sure + 1, 7), sure >> 1)
            table[at] = np.where((sure == 0) & (guess != ids), new, kept)
        own = ids.astype(np.uint32)
        at = (self.row << OFTEN_BITS) + (own * _K1 >> np.uint32(32 - OFTEN_BITS))
        self.often[at] = np.minimum(self.often[at] + np.uint8(1), np.uint8(15))
        self.before, self.last = self.last, own

    def place(self, level: int, lanes: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Where the distribution of the next four bits is, after the bits ``upper``; deep ones share places by a hash."""
        b = self.bits[level]
        return (lanes << b) + (upper if 4 * level <= DEEP_BITS else upper.astype(np.uint32) * _K1 >> np.uint32(32 - b))

    def rows(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.digits[level].take(at).view(np.int16).reshape(-1, 17)

    def renew(self, level: int, at: np.ndarray, rows: np.ndarray, digit: np.ndarray) -> None:
        k = min(level, 3)
        new = TARGET_ROWS[k].take(digit).view(np.int16).reshape(-1, 17)
        new -= rows
        new >>= RATES[k]
        new += rows
        self.digits[level][at] = new.view(ROW)[:, 0]


def _levels(ids: np.ndarray) -> int:
    """How many digits of four bits the ids need: an even number, since two are coded at once."""
    most = int(ids.max(initial=0))
    if most >> 28 or int(ids.min(initial=0)) < 0:
        raise ValueError("ids must be between 0 and 2^28 - 1")
    return 4 if most < 1 << 16 else 6 if most < 1 << 24 else 8


def encode_blocks(blocks: list[np.ndarray], levels: int = 4) -> list[bytes]:
    """Code each block of ids; blocks must be ordered by length, longest first."""
    if not blocks:
        return []
    sizes, n = [len(b) for b in blocks], len(blocks)
    lanes, most = _Lanes(n, levels), sizes[0]
    ids = np.zeros((most, n), np.int32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    # words of 16 bits; a 17th bit is a carry into the word before, which is settled at the end
    words, count, low = np.zeros((n, most + 512), np.uint32), np.zeros(n, np.int64), np.zeros(n, np.uint64)

    def shift(at: np.ndarray | None = None) -> None:
        at = np.flatnonzero(lanes.range < _LEAST) if at is None else at[lanes.range[at] < _LEAST]
        while len(at):
            rest, c = low[at], count[at]
            words[at, c] = rest >> _S32
            count[at] = c + 1
            low[at] = (rest & _LOW) << _S16
            wide = lanes.range[at] << _S16
            lanes.range[at] = wide
            at = at[wide < _LEAST]

    for t in range(most):
        while sizes[n - 1] <= t:
            n -= 1
        if n < lanes.n:
            lanes.narrow(n)
        if not t % 32 and count.max() + 32 * (levels + 1) + 8 > words.shape[1]:
            words = np.concatenate([words, np.zeros((len(blocks), most // 2 + 512), np.uint32)], axis=1)
        own = ids[t, :n]
        lanes.predict()
        hit2 = lanes.g2 == own
        hit1 = (lanes.g1 == own) & lanes.other
        rest = lanes.p2 + lanes.p1
        part = lanes.range >> _S16
        low[:n] += part * np.where(hit2, 0, np.where(hit1, lanes.p2, rest)).astype(np.uint64)
        lanes.range = part * np.where(hit2, lanes.p2, np.where(hit1, lanes.p1, 65_536 - rest)).astype(np.uint64)
        shift()
        at = np.flatnonzero(~(hit2 | hit1))
        if len(at):
            value, each = own[at], np.arange(0, 17 * len(at), 17)
            for k in range(0, levels, 2):
                ends = []
                for j in (k, k + 1):
                    digit, place = value >> 4 * (levels - 1 - j) & 15, lanes.place(j, at, value >> 4 * (levels - j))
                    rows = lanes.rows(j, place)
                    flat, edge = rows.reshape(-1), each + digit
                    ends.append((flat.take(edge).astype(np.int64), flat.take(edge + 1).astype(np.int64)))
                    lanes.renew(j, place, rows, digit)
                (a, b), (c, d) = ends
                part = lanes.range[at] >> _S28
                low[at] += part * ((a << 14) + (b - a) * c).astype(np.uint64)
                lanes.range[at] = part * ((b - a) * (d - c)).astype(np.uint64)
                shift(at)
        lanes.learn(own, hit2, hit1)
    each = np.arange(len(blocks))
    if int(count.max()) + 3 > words.shape[1]:
        words = np.concatenate([words, np.zeros((len(blocks), 8), np.uint32)], axis=1)
    for i, s in enumerate((_S32, _S16, np.uint64(0))):
        words[each, count + i] = (low >> s) & (_LOW if i == 0 else np.uint64(0xFFFF))
    for j in range(int(count.max()) + 2, 0, -1):
        words[:, j - 1] += words[:, j] >> np.uint32(16)
    return [(words[i, : c + 3] & np.uint32(0xFFFF)).astype("<u2").tobytes() for i, c in enumerate(count.tolist())]


def decode_blocks(data: list[bytes], sizes: list[int], levels: int = 4) -> list[np.ndarray]:
    """The inverse of ``encode_blocks`` for the same order of blocks."""
    if not data:
        return []
    n = len(data)
    lanes, most = _Lanes(n, levels), sizes[0]
    words = np.zeros((n, max(map(len, data)) // 2 + 16), np.uint16)
    for i, d in enumerate(data):
        words[i, : len(d) // 2] = np.frombuffer(d, "<u2", len(d) // 2)
    wide = lambda col: words[:, col].astype(np.uint64)
    code, taken = (wide(0) << _S32) | (wide(1) << _S16) | wide(2), np.full(n, 3)
    ids, end = np.zeros((most, n), np.int32), words.shape[1] - 1

    def shift(at: np.ndarray | None = None) -> None:
        at = np.flatnonzero(lanes.range < _LEAST) if at is None else at[lanes.range[at] < _LEAST]
        while len(at):
            c = taken[at]
            code[at] = (code[at] << _S16) | words[at, np.minimum(c, end)]
            taken[at] = c + 1
            got = lanes.range[at] << _S16
            lanes.range[at] = got
            at = at[got < _LEAST]

    for t in range(most):
        while sizes[n - 1] <= t:
            n -= 1
        if n < lanes.n:
            lanes.narrow(n)
            code, taken = code[:n], taken[:n]
        lanes.predict()
        part = lanes.range >> _S16
        goal, rest = np.minimum(code // part, np.uint64(65_535)).astype(np.int64), lanes.p2 + lanes.p1
        hit2 = goal < lanes.p2
        hit1 = ~hit2 & (goal < rest)
        code -= part * np.where(hit2, 0, np.where(hit1, lanes.p2, rest)).astype(np.uint64)
        lanes.range = part * np.where(hit2, lanes.p2, np.where(hit1, lanes.p1, 65_536 - rest)).astype(np.uint64)
        shift()
        own = np.where(hit2, lanes.g2, lanes.g1)
        at = np.flatnonzero(~(hit2 | hit1))
        if len(at):
            value, each = np.zeros(len(at), np.int32), np.arange(0, 17 * len(at), 17)
            for k in range(0, levels, 2):
                part = lanes.range[at] >> _S28
                goal = np.minimum(code[at] // part, np.uint64((1 << 28) - 1)).astype(np.int64)
                start, size = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
                for j, bits in ((k, 14), (k + 1, 0)):
                    place = lanes.place(j, at, value)
                    rows = lanes.rows(j, place)
                    # the last end of all is above any goal; of the 16 truth values in two words their set bits are counted
                    goal16 = (goal >> bits if bits else (goal - start) // size).astype(np.int16)
                    below = np.bitwise_count((rows[:, 1:] <= goal16[:, None]).view(np.uint64))
                    digit = (below[:, 0] + below[:, 1]).astype(np.int64)
                    flat, edge = rows.reshape(-1), each + digit
                    a, b = flat.take(edge).astype(np.int64), flat.take(edge + 1).astype(np.int64)
                    start, size = start + size * (a << bits), size * (b - a)
                    lanes.renew(j, place, rows, digit)
                    value = (value << 4 | digit).astype(np.int32)
                code[at] -= part * start.astype(np.uint64)
                lanes.range[at] = part * size.astype(np.uint64)
                shift(at)
            own[at] = value
        ids[t, :n] = own
        lanes.learn(own, hit2, hit1)
    return [ids[:s, i].copy() for i, s in enumerate(sizes)]


# -- file ---------------------------------------------------------------


def crc(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), before)


def group_bytes(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """One group: numbers of blocks and of digits, a (ids, bytes, crc) row for each block, then their data."""
    size, levels = min(block_ids, max(LEAST_BLOCK, -(-len(ids) // LANES))), _levels(ids)
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    data = encode_blocks(blocks, levels)
    head = np.array([(len(b), len(d), crc(b)) for b, d in zip(blocks, data, strict=True)], "<u4")
    return np.array([len(blocks), levels], "<u4").tobytes() + head.tobytes() + b"".join(data)


class Writer:
    """One file: lots of (doc_ids, ids of each, all their ids) in order.  Holds one group of ids in a typed buffer."""

    def __init__(self, out):
        self.out, self.at, self.docs, self.ids, self.nulls, self.held = out, len(MAGIC), 0, 0, 0, 0
        self.names, self.sizes, self.groups = [], [], []
        self.buffer = np.empty(GROUP_IDS, np.int32)
        out.write(MAGIC)

    def note(self, names: list[int | None], sizes: np.ndarray) -> None:
        """Documents for the index."""
        self.nulls += names.count(None)
        self.names.append(np.array([n or 0 for n in names], "<i8"))
        self.sizes.append(sizes.astype("<i8"))
        self.docs, self.ids = self.docs + len(names), self.ids + int(sizes.sum())

    def add(self, names: list[int | None], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.note(names, sizes)
        while len(flat):
            part = flat[: GROUP_IDS - self.held]
            self.buffer[self.held : self.held + len(part)] = part
            self.held, flat = self.held + len(part), flat[len(part) :]
            if self.held == GROUP_IDS:
                self._close_group()

    def _close_group(self) -> None:
        self.put(group_bytes(self.buffer[: self.held]))
        self.held = 0

    def put(self, data: bytes) -> None:
        """A whole group."""
        self.out.write(data)
        self.groups.append(self.at)
        self.at += len(data)

    def full(self) -> bool:
        return self.ids >= FILE_IDS or self.docs >= FILE_DOCS

    def close(self) -> int:
        """Write the index; returns the size of the file."""
        if self.held:
            self._close_group()
        index = b"".join(x.tobytes() for x in (*self.names, *self.sizes, np.array(self.groups, "<i8")))
        self.out.write(index)
        foot = np.array([self.docs, self.nulls, len(self.groups), self.at, zlib.crc32(index)], "<i8").tobytes() + MAGIC
        self.out.write(foot)
        return self.at + len(index) + len(foot)


def read_groups(f) -> Iterator[tuple[bytes, list[tuple[int | None, int, bool]]]]:
    """Each group of a seekable file with (doc_id, number of its ids there, whether they are its last) of its documents.

    Raises ValueError where the file is cut off or the index damaged.
    """
    foot = 40 + len(MAGIC)
    size = f.seek(0, io.SEEK_END) or f.tell()
    f.seek(0)
    head = f.read(len(MAGIC))
    f.seek(max(0, size - foot))
    tail = f.read(foot)
    if size < foot + len(MAGIC) or head != MAGIC or tail[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a token file, or cut off")
    docs, nulls, n_groups, at, check = np.frombuffer(tail[: -len(MAGIC)], "<i8").tolist()
    if not 0 <= at <= size - foot:
        raise ValueError("index place")
    f.seek(at)
    index = f.read(size - foot - at)
    if zlib.crc32(index) != check:
        raise ValueError("index checksum")
    names, sizes, groups = np.split(np.frombuffer(index, "<i8"), [docs, 2 * docs])
    ends = [*groups.tolist()[1:], at][:n_groups]
    named = ((None if i < nulls else n, s) for i, (n, s) in enumerate(zip(names.tolist(), sizes.tolist(), strict=True)))
    name, left = next(named, (None, -1))
    for a, b in zip(groups.tolist(), ends, strict=True):
        f.seek(a)
        data = f.read(b - a)
        room, own = int(_head(data)[1][:, 0].sum(dtype=np.int64)), []
        while left >= 0 and room:
            own.append((name, min(left, room), left <= room))
            room, left = room - own[-1][1], left - own[-1][1]
            if own[-1][2]:
                name, left = next(named, (None, -1))
        if room:
            raise ValueError("more ids than the index has")
        yield data, own
    own = [(name, left, True)] if left >= 0 else []
    own += [(n, s, True) for n, s in named]
    if any(s for _, s, _ in own):
        raise ValueError("fewer ids than the index has")
    if own:  # empty ones at the end
        yield b"", own


def read_pieces(f) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, some of its ids, whether they are its last) of a seekable file, one group in memory.

    Raises ValueError where a checksum fails.
    """
    for data, own in read_groups(f):
        ids, at = _group(data) if data else np.zeros(0, np.int32), 0
        for name, n, last in own:
            yield name, ids[at : at + n], last
            at += n


def _head(data: bytes) -> tuple[int, np.ndarray]:
    """Number of digits, and (ids, bytes, crc) of each block of a group."""
    n, levels = np.frombuffer(data, "<u4", 2).tolist()
    head = np.frombuffer(data, "<u4", 3 * n, 8).reshape(n, 3)
    if levels not in (4, 6, 8) or 8 + 12 * n + int(head[:, 1].sum(dtype=np.int64)) != len(data) or int(head[:, 0].max(initial=0)) > GROUP_IDS:
        raise ValueError("blocks of a group")
    return levels, head


def _group(data: bytes) -> np.ndarray:
    levels, head = _head(data)
    ends = 8 + 12 * len(head) + np.cumsum(head[:, 1], dtype=np.int64)
    parts = [data[e - s : e] for e, s in zip(ends.tolist(), head[:, 1].tolist(), strict=True)]
    blocks = decode_blocks(parts, head[:, 0].tolist(), levels)
    for b, want in zip(blocks, head[:, 2].tolist(), strict=True):
        if crc(b) != want:
            raise ValueError("block checksum")
    return np.concatenate(blocks)


def read_file(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a seekable file."""
    return _whole(read_pieces(f))


def _whole(pieces: Iterator[tuple[int | None, np.ndarray, bool]]) -> Iterator[tuple[int | None, np.ndarray]]:
    held = []
    for name, ids, last in pieces:
        held.append(ids)
        if last:
            yield name, held[0] if len(held) == 1 else np.concatenate(held)
            held = []


# -- tokenizer and tables -----------------------------------------------


class _Slots(dict):
    """Numbers runs in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, run: str) -> int:
        self.fresh.append(run)
        self[run] = n = len(self)
        return n


class Memo:
    """The library's ids, asked for once for each run without white space.

    Pieces of the vocabulary's splitting rule never cross white space, and its
    normaliser doesn't join letters across it, so the ids of a text are those of
    its runs; texts with special tokens, or with white space that str.split()
    sees otherwise, go to the library whole.  The memo is bounded by runs and by
    characters.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        # a task has one core; the library's threads cost more time than they save
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + list("\x1c\x1d\x1e\x1f")
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and fine(path) else None
        self.held, self.old, self.held_chars = {}, {}, 0
        self._start()

    def ask(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, all ids).  Runs go to the library together, apart by a mark: a call a run costs half as much again."""
        if self.mark is None or any(MARK in r for r in runs):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            return np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], np.int32)
        lots = [f" {MARK} ".join(runs[i : i + MARKED]) + f" {MARK}" for i in range(0, len(runs), MARKED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lots, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(runs):
            raise ValueError("the vocabulary joins runs across white space")
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.mark]

    def recall(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs in UTF-8; ids are held from task to task, in two generations of the memo's bounds: those still in use move on."""
        if len(self.held) > CACHE_RUNS or self.held_chars > CACHE_CHARS:
            self.old, self.held, self.held_chars = self.held, {}, 0
        held, old, new = self.held, self.old, []
        for r in dict.fromkeys(runs):
            if r not in held:
                self.held_chars += len(r)
                if r in old:
                    held[r] = old[r]
                else:
                    new.append(r)
        if new:
            sizes, ids = self.ask([r.decode() for r in new])
            data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            held.update((r, data[a:b]) for r, a, b in zip(new, [0, *ends], ends, strict=False))
        got = [held[r] for r in runs]
        return np.array([len(g) >> 2 for g in got], np.int64), np.frombuffer(b"".join(got), np.int32)

    def _start(self) -> None:
        self.slots, self.chars = _Slots(), 0
        self.slots[None] = 0  # ends a document
        self.ids, self.begin, self.size = np.array([self.end_id], np.int32), np.array([0]), np.array([1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end id, all ids)."""
        if len(self.slots) > CACHE_RUNS or self.chars > CACHE_CHARS:
            self._start()
        runs, last = [], []
        for t in texts:
            runs += [t] if any(o in t for o in self.odd) else t.split()
            runs.append(None)
            last.append(len(runs))
        at = np.fromiter(map(self.slots.__getitem__, runs), np.int64, len(runs))
        if self.slots.fresh:
            size, ids = self.ask(self.slots.fresh)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            self.chars += sum(map(len, self.slots.fresh))
            self.slots.fresh = []
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.diff(ends[np.array(last, np.int64) - 1], prepend=0), flat


@lru_cache(maxsize=2)
def memo(path: str, end_id: int) -> Memo:
    return Memo(path, end_id)


def fine(path: str) -> bool:
    """Whether the vocabulary has the splitting rule and normaliser of ``FINE``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        nfc, replace, lower = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        own = (
            [nfc["type"], (replace["type"], replace["pattern"]["Regex"], replace["content"]), lower["type"]],
            [(split["type"], split["pattern"]["Regex"], split["behavior"], split["invert"]), (level["type"], level["add_prefix_space"], level["use_regex"])],
        )
    except (KeyError, TypeError, ValueError):
        return False
    return own == FINE


class Runs:
    """The ids of one task's texts, from the numbers that ``Split`` gives their runs."""

    def __init__(self, own: Memo):
        self.own = own
        self._start()

    def _start(self) -> None:
        self.begin, self.size, self.ids = np.array([0], np.int32), np.array([1], np.int32), np.array([self.own.end_id], np.int32)

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end id, all ids)."""
        out, at, fresh = [], [], []
        for row in rows:
            known, new, n = np.frombuffer(row, "<i4", 3).tolist()
            if known != len(self.size) - 1 + len(fresh):
                if known:
                    raise ValueError("runs are not in the order of their numbers")
                if at:
                    out.append(self._ids(at, fresh))
                    at, fresh = [], []
                self._start()
            if new:
                ends = (12 + 4 * (new + n) + np.cumsum(np.frombuffer(row, "<i4", new, 12))).tolist()
                fresh += [row[a:b] for a, b in zip([12 + 4 * (new + n), *ends], ends, strict=False)]
            at.append(np.frombuffer(row, "<i4", n, 12 + 4 * new))
        out.append(self._ids(at, fresh))
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if len(out) > 1 else out[0]

    def _ids(self, at: list[np.ndarray], fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if fresh:
            size, ids = self.own.recall(fresh)
            self.begin = np.concatenate([self.begin, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
            self.size = np.concatenate([self.size, size.astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids])
        last = np.cumsum([len(x) for x in at]) - 1
        at = np.concatenate(at)
        size = self.size.take(at)
        ends = np.cumsum(size, dtype=np.int32)
        place = np.repeat(self.begin.take(at) - ends + size, size)
        place += np.arange(len(place), dtype=np.int32)
        return np.diff(ends[last].astype(np.int64), prepend=0), self.ids.take(place)


# -- code of the JVM -----------------------------------------------------

_classes: dict[str, str] = {}


def _hex(numbers) -> str:
    return "".join(f"{int(x) & 0xFFFF:04x}" for x in np.asarray(numbers).reshape(-1))


def _package(spark: SparkSession) -> str:
    """The package of the classes of ``tokencode.java``, compiled for this application and known to its executors."""
    app = spark.sparkContext.applicationId
    if app not in _classes:
        with open(os.path.join(os.path.dirname(__file__), "tokencode.java"), encoding="utf-8") as f:
            source = f.read()
        values = {
            "PAIR_BITS": PAIR_BITS, "LAST_BITS": LAST_BITS, "OFTEN_BITS": OFTEN_BITS, "DEEP_BITS": DEEP_BITS, "WHOLE": WHOLE,
            "STRETCH": _hex(STRETCH), "SQUASH": _hex(SQUASH), "RATES": _hex(RATES), "TARGETS": _hex(TARGETS), "TASK_RUNS": TASK_RUNS, "CACHE_CHARS": CACHE_CHARS,
        }
        package = "pulsegrid_" + hashlib.sha256((source + repr(values)).encode()).hexdigest()[:16]
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Template(source).substitute(values, PACKAGE=package))
        code = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="pulsegrid-"), f"{package}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in code.keySet():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code[name]))
        spark._jsparkSession.sessionState().resourceLoader().addJar(f"file://{jar}")  # the driver hands it to executors
        _classes[app] = package
    return _classes[app]


def _instance(spark: SparkSession, name: str):
    return spark._jsparkSession.sharedState().jarClassLoader().loadClass(f"{_package(spark)}.TokenCode${name}").newInstance()


def _called(spark: SparkSession, instance, column: str) -> Column:
    """``instance`` on a column of binaries, once a row and in the order of rows."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_seq

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named, types, values = jvm.java.lang.Class.forName, gateway.new_array(jvm.java.lang.Class, 2), gateway.new_array(jvm.java.lang.Object, 2)
    types[0], types[1] = named("org.apache.spark.sql.api.java.UDF1"), named("org.apache.spark.sql.types.DataType")
    values[0], values[1] = instance, jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    # by its signature: from among the functions named udf the gateway takes any that fits
    function = named("org.apache.spark.sql.functions").getMethod("udf", types).invoke(None, values)
    return Classic(function.asNondeterministic().apply(_to_seq(spark.sparkContext, [F.col(column)._jc])))


# -- tables --------------------------------------------------------------


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, runs) of rows that have about ``LOT_CHARS`` runs together."""
    for b in batches:
        names, rows, size = [], [], 0
        for name, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            names.append(name)
            rows.append(row.as_py())
            size += len(rows[-1])
            if size > 4 * LOT_CHARS:
                yield names, rows
                names, rows, size = [], [], 0
        if names:
            yield names, rows


def write_ids(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and write files in ascending id order.

    Returns the stored manifest: file, part, number, first_id, docs, ids, bytes,
    start.  An attempt writes files of its own names; only manifest files are read.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, planned_bytes(docs) // PARTITION_BYTES))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    split = _instance(spark, "Split")
    with open(path, encoding="utf-8") as f:
        for token in json.load(f).get("added_tokens") or []:
            split = split.whole(bytearray(token["content"].encode()))
    split = split.fine() if fine(path) else split
    kind, types = "names array<long>, sizes array<long>, ids binary, full boolean", [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.bool_()]

    def ids(batches):
        """Groups of ids, and the documents that end in them; the last group of a file is marked."""
        runs, names, sizes, held, size, docs, total = Runs(memo(path, end_id)), [], [], [], 0, 0, 0

        def group(n, full):
            nonlocal names, sizes, held, size
            flat = np.concatenate(held) if len(held) > 1 else held[0]  # of a long document the rest is not copied again and again
            own, held, size = flat[:n], [flat[n:]], size - n
            data = np.array([_levels(own), BLOCK_IDS], "<i4").tobytes() + own.astype("<i4", copy=False).tobytes()
            row = [pa.array([x], t) for x, t in zip((names, sizes, data, full), types, strict=True)]
            names, sizes = [], []
            return pa.RecordBatch.from_arrays(row, names=["names", "sizes", "ids", "full"])

        for own, rows in _lots(batches):
            each, flat = runs.encode(rows)
            names, held, size = names + own, [*held, flat], size + len(flat)
            sizes += each.tolist()
            docs, total = docs + len(own), total + len(flat)
            full = total >= FILE_IDS or docs >= FILE_DOCS
            while size > ROW_IDS:
                yield group(ROW_IDS, False)
            if full:
                yield group(size, True)
                docs = total = 0
        if size:
            yield group(size, True)

    def run(batches):
        part, done, writer = TaskContext.get().partitionId(), [], None
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for row in b.to_pylist():
                if writer is None:
                    name = f"ids-{uuid.uuid4().hex}.bin"
                    writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None))
                    done.append([f"{folder}/{name}", part, len(done), row["names"][0]])
                writer.note(row["names"], np.array(row["sizes"], "<i8"))
                writer.put(row["ids"])
                if row["full"]:
                    size = writer.close()
                    writer.out.close()
                    done[-1] += [writer.docs, writer.ids, size]
                    writer = None
        if done:
            types = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["file", "part", "number", "first_id", "docs", "ids", "bytes"])

    groups = rows.select("doc_id", _called(spark, split, "text").alias("runs")).mapInArrow(ids, kind)
    groups = groups.select("names", "sizes", _called(spark, _instance(spark, "Encode"), "ids").alias("ids"), "full")
    manifest = stored(groups.mapInArrow(run, "file string, part long, number long, first_id long, docs long, ids long, bytes long"), "token-manifest")
    # one row a file: the running sum over files is small whatever the corpus
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(manifest: DataFrame, rows: Callable[[Iterator[tuple[int | None, np.ndarray, bool]], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``rows`` on the pieces of each file (as of ``read_pieces``) and the number of its first id; a task holds one file open."""
    spark = manifest.sparkSession

    def groups(batches):
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    first = True
                    for data, own in read_groups(f):
                        row = (start, first, *map(list, zip(*own, strict=True)), data or group_bytes(np.zeros(0, np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["start", "first", "names", "sizes", "last", "data"])
                        first = False

    def run(batches):
        def own():
            """Rows of groups, file by file."""
            for b in batches:
                for i in range(b.num_rows):
                    yield {c: b.column(k)[i] for k, c in enumerate(b.schema.names)}

        def pieces():
            nonlocal row
            while row is not None:
                if not row["data"].is_valid:
                    raise ValueError("block checksum")
                ids, at = np.frombuffer(row["data"].as_buffer(), "<i4"), 0
                for name, n, last in zip(row["names"].as_py(), row["sizes"].as_py(), row["last"].as_py(), strict=True):
                    yield name, ids[at : at + n], last
                    at += n
                row = next(every, None)
                if row is None or row["first"].as_py():
                    return

        every = own()
        row = next(every, None)
        while row is not None:
            yield from rows(pieces(), row["start"].as_py())

    n = max(1, min(manifest.count(), 100_000))
    read = manifest.select("file", "start").repartition(n).mapInArrow(groups, "start long, first boolean, names array<long>, sizes array<long>, last array<boolean>, data binary")
    read = read.select("start", "first", "names", "sizes", "last", _called(spark, _instance(spark, "Decode"), "data").alias("data"))
    return read.mapInArrow(run, schema)


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document, decoded from the files."""

    def rows(pieces, start):
        held, size = [], 0
        for name, ids in _whole(pieces):
            held.append((name, start, ids))
            start, size = start + len(ids), size + len(ids)
            if size > 500_000:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)

    return _read(manifest, rows, "doc_id long, start long, ids array<int>")


def _rows(held: list) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(x[2]) for x in held]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[2] for x in held]), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), ids], names=["doc_id", "start", "ids"])


def read_checksums(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    CRC-32 of all its ids as little-endian unsigned 32-bit integers; ids stay in
    the task, and a document longer than a group is not put together.
    """

    def rows(pieces, start):
        held, n, sum_ = [], 0, 0
        for name, ids, last in pieces:
            n, sum_ = n + len(ids), crc(ids, sum_)
            if last:
                held.append((name, start, n, sum_))
                start, n, sum_ = start + n, 0, 0
                if len(held) == 10_000:
                    yield digest_rows(held)
                    held = []
        if held:
            yield digest_rows(held)

    def digest_rows(held):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
