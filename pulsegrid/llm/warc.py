"""WARC archives with revisit records, and a salvage reader (operator 5).

Writing: each record is a gzip member of its own.  Of pages with equal payloads
of at least ``min_bytes`` bytes the one with the largest id is written as
``response``; the others are ``revisit`` records that refer to it.

Reading: every record is checked (member, version line, lengths, block digest).
After a failed check the reader searches for the next member or version line
that passes, goes on there, and logs the bytes between as a quarantined gap.

Defined cases: null html is the empty payload; pages without an id are always
responses and come back without one; repeated rows are written again; a null
URL has no header, control characters in URLs are percent-encoded; an empty
table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fits, fresh_path, stored

ARCHIVE_BYTES = 32 << 20
MIN_BYTES = 1000
BROADCAST_ROWS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_URN = "urn:pulsegrid:page:"


# -- one record ---------------------------------------------------------


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(data).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """The bytes of an uncompressed record; a revisit carries the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    own = f"{_URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Broken(ValueError):
    """A record that fails a check; the text says which."""


def parse(raw: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    end = raw.find(b"\r\n\r\n", at)
    if not raw.startswith(b"WARC/1.", at) or end < 0:
        raise Broken("version line or header")
    head = {}
    for line in bytes(raw[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise Broken("content length")
    size = int(head["content-length"])
    block = bytes(raw[end + 4 : end + 4 + size])
    if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise Broken("record length")
    if (want := head.get("warc-block-digest")) and want != _b32(hashlib.sha1(block).digest()):
        raise Broken("block digest")
    return head, block, end + 8 + size


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and its end; fed in pieces, so that nothing behind it is copied."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = data[pos : pos + 16384]
            if not piece:
                raise Broken("member is cut off")
            out.append(unpack.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Broken("member") from e
    return b"".join(out), pos - len(unpack.unused_data)


def _one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    if data.startswith(b"\x1f\x8b", at):
        raw, end = _inflate(data, at)
        head, block, used = parse(raw)
        if used != len(raw):
            raise Broken("more than one record in a member")
        return head, block, end
    return parse(data, at)


def _stated_end(data: bytes, at: int) -> int | None:
    """Where the record at ``at`` ends by its own header, if this is whole and an end of record is there."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or end < 0:
        return None
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)\s", data[at : end + 2])
    stop = end + 8 + int(size[1]) if size and len(size[1]) < 19 else None
    return stop if stop is not None and data[stop - 4 : stop] == b"\r\n\r\n" else None


def _next_record(data: bytes, at: int) -> int | None:
    """The next place where a record passes all checks.

    Version lines count after an empty line only, as records end in one.  A
    block may quote a record; so one that is followed by another record or the
    end of the data goes first, and others count only if there is no such one.
    """
    other = None
    for m in _MARK.finditer(data, at):
        place = m.start()
        if m[0] == b"WARC/1." and data[place - 4 : place] != b"\r\n\r\n":
            continue
        try:
            end = _one(data, place)[2]
        except Broken:
            continue
        if end == len(data) or _MARK.match(data, end):
            return place
        other = place if other is None else other
    return other


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason) items that cover ``data``.

    A record whose header is whole but whose block fails its check ends where
    the header says, so that nothing inside of its block is taken for a record.
    """
    at, size = 0, len(data)
    while at < size:
        try:
            head, block, end = _one(data, at)
        except Broken as e:
            start, reason = at, str(e)
            found = _stated_end(data, at)
            found = _next_record(data, at + 1) if found is None else found
            at = size if found is None else found
            yield "gap", start, at, reason
            continue
        yield "record", at, end, (head, block)
        at = end


def page_row(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, record_type, payload or None, payload_bytes, sha1 hex, refers_to)."""
    number = lambda v: int(v[1:-1].removeprefix(_URN)) if v.startswith(f"<{_URN}") else None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "revisit":
        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        return number(head["warc-record-id"]), head.get("warc-target-uri"), "revisit", None, size, digest, number(head["warc-refers-to"])
    if hashlib.sha1(payload).hexdigest() != digest:
        raise Broken("payload digest")
    return number(head["warc-record-id"]), head.get("warc-target-uri"), "response", payload, len(payload), digest, None


# -- tables -------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only ids and digests are shuffled.  The groups of equal payloads, one row
    each, are broadcast if there are few; else they are joined by a shuffle,
    where AQE splits a hot digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select("digest", "last"), "payload-groups")
    joined = rows.join(F.broadcast(groups) if fits(groups, BROADCAST_ROWS) else groups, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` into archives in the shared folder; returns the manifest (archive, records, bytes).

    An attempt writes files of its own names; only those in the manifest, which
    is stored, are read.  So a task that runs again leaves no double records.
    """
    folder = fresh_path(rows.sparkSession, "warc")

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []

        def close():
            if out is not None:
                out.close()

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or done[-1][2] >= archive_bytes:
                    close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                data = member(record(page_id, url, payload, bytes.fromhex(digest), refers_to))
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return stored(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


ROW = "archive string, start long, end long, gap string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record, and one with ``gap`` set to the reason for each quarantined gap.  A task holds one archive at a time."""
    names = [f.split(" ")[0] for f in ROW.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def rows(archive: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(archive)
        with fs.open_input_stream(path, compression=None) as f:
            data = f.read()
        for kind, start, end, got in salvage(data):
            if kind == "record":
                try:
                    row = page_row(*got)
                    yield (archive, start, end, None, *row[:3], row[3] if payload else None, *row[4:])
                    continue
                except (Broken, KeyError, ValueError, TypeError) as e:
                    got = f"not a page record: {e}"
            yield (archive, start, end, got, *[None] * 7)

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(archive):
                    held.append(row)
                    size += len(row[7] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 4096, 16 * spark.sparkContext.defaultParallelism))
    return manifest.select("archive").repartition(n).mapInArrow(run, ROW)
