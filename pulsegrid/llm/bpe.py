"""BPE encoding and decoding (operator 8).

Method: contiguous rank array.  A short word is held as a list of part ids and
a parallel list with the merge rank of each adjacent pair.  The smallest rank
(leftmost on ties) is found by a scan, its boundary is deleted, and only the
two neighbouring ranks are refreshed.  Words repeat, so finished words are
memoised per Python worker, in two generations of bounded size: a full one
becomes the old one, and words still in use move on to the new one.

Very long words (over ``SCAN_LIMIT`` parts) would make repeated scans
quadratic; they use a heap over the same merge order with the same result.
Words of more than ``MEMO_CHARS`` characters are not memoised, so the memo is
bounded in bytes too.

Letters, numbers and white space are the library's: where the tables of this
module's regular expressions may be newer, the library is asked (``rule``).

Defined cases: a null or empty text has no ids and decodes to the empty text;
rows with equal texts get equal rows; null ids columns pass through; extra
columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN_LIMIT = 256
CACHE_WORDS = 220_000
MEMO_CHARS = 256
NO_RANK = 1 << 60
ID_BITS = 20
#: White space for str.split() that the vocabulary's white space rule does not split at.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def _ranges(points: list[int]) -> str:
    """A regular expression's set of code points."""
    out, start = [], None
    for i, c in enumerate(points):
        start = c if start is None else start
        if i + 1 == len(points) or points[i + 1] != c + 1:
            out.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def rule(path: str) -> tuple[regex.Pattern, dict[int, str]]:
    """The vocabulary's splitting rule with the character classes that the library has, and letters that only it makes lower case.

    Code points that are a letter, number or space here but not assigned in
    ``unicodedata``, whose tables are older, are given to the library's own
    splitter and normaliser; those that it sees otherwise leave their class.
    """
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))["pre_tokenizer"]["pretokenizers"]
    text = next(p for p in spec if p["type"] == "Split")["pattern"]["Regex"]
    library, lower = Tokenizer.from_file(path), {}
    split, normal = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, pieces in (("L", 1), ("N", 3), ("s", 1)):
        own = "\\s" if name == "s" else f"\\p{{{name}}}"
        doubtful = [c for c in regex.findall(own, points) if unicodedata.category(c) == "Cn"]
        # "a" and twice the character: a letter joins it (one piece), numbers stand alone (three), others run together (two)
        wrong = [ord(c) for c in doubtful if len(split(f"a{c}{c}")) != pieces]
        lower.update({ord(c): low for c in doubtful if name == "L" and (low := normal(c)) != c})
        if wrong:
            text = text.replace(own, f"[{own}--[{_ranges(wrong)}]]")
    return regex.compile(text, regex.V1), lower


class BpeCodec:
    """Encoder and decoder for a vocabulary file with word ends, NFC, lower case and byte-level letters."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        #: For each left id, the right ids that merge with it: rank and merged id in one integer, so that min() finds both.
        self.merges: dict[int, dict[int, int]] = {i: {} for i in self.tokens}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a]][vocab[b]] = rank << ID_BITS | vocab[a + b]
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.pieces, self.lower = rule(path)
        self.newer = re.compile("[" + _ranges(sorted(self.lower)) + "]") if self.lower else None
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache_words = cache_words
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._old_chunks: dict[str, tuple[int, ...]] = {}
        self._old_words: dict[str, tuple[int, ...]] = {}

    # -- one word -------------------------------------------------------

    def word(self, text: str) -> list[int]:
        """Ids of one word, already normalised and split off."""
        data = text.encode("utf-8")
        parts = [self.inner[b] for b in data]
        parts[-1] = self.final[data[-1]]
        return self._heap(parts) if len(parts) > SCAN_LIMIT else self._scan(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        merges, none, mask = self.merges, NO_RANK, (1 << ID_BITS) - 1
        ranks = [merges[a].get(b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] = new = low & mask
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges[parts[i - 1]].get(new, none)
            if i < len(ranks):
                ranks[i] = merges[new].get(parts[i + 1], none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, merges, mask = len(parts), self.merges, (1 << ID_BITS) - 1
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges[parts[i]].get(parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = m & mask, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (m := merges[parts[x]].get(parts[after[x]])):
                    heapq.heappush(heap, (m, x, parts[x], parts[after[x]]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    # -- texts ----------------------------------------------------------

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids = self._old_chunks.get(chunk)
        if ids is None:
            words = self.pieces.findall(chunk)
            ids = self._word(words[0]) if len(words) == 1 else tuple(i for w in words for i in self._word(w))
        if len(chunk) > MEMO_CHARS:
            return ids
        if len(self._chunks) >= self.cache_words:
            self._old_chunks = self._chunks.copy()
            self._chunks.clear()  # in place: encode() holds its get()
        self._chunks[chunk] = ids
        return ids

    def _word(self, w: str) -> tuple[int, ...]:
        ids = self._words.get(w)
        if ids is None:
            ids = self._old_words.get(w) or tuple(self.word(w))
            if len(w) > MEMO_CHARS:
                return ids
            if len(self._words) >= self.cache_words:
                self._old_words, self._words = self._words, {}
            self._words[w] = ids
        return ids

    def _section(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at a sigma's neighbours; the vocabulary's rule does not
                text = "".join(c.lower() for c in text)
            if self.newer is not None and self.newer.search(text):
                text = text.translate(self.lower)
        get, miss = self._chunks.get, self._chunk
        text = text.lower()
        for chunk in _SPACE.split(text) if _ODD_SPACE.search(text) else text.split():
            out += get(chunk) or miss(chunk)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.cut is None or "<" not in text:
            self._section(text, out)
            return out
        at = 0
        for m in self.cut.finditer(text):
            self._section(text[at : m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._section(text[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by one space; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec for each vocabulary and Python worker."""
    return BpeCodec(path)


def _arrays(docs: DataFrame, id_col: str, text_col: str, path: str, decode: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "ids"] + ["decoded"] * decode
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decode)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of ``docs``; one narrow pass, no shuffle."""
    return _arrays(docs, id_col, text_col, path, False)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row of ``docs``."""
    return _arrays(docs, id_col, text_col, path, True)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) from a column of ids; null ids decode to the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and SHA-256 digests of ids and decoded text, derived from the operator's outputs."""
    return encode_decode(docs, path, id_col, text_col).select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
