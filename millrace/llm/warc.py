"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

The reader checks each record: the member's CRC, the version line, the declared length, the record's end and
its payload digest. After a failed check it searches for the next valid gzip member or version line, goes on
there, and reports the bytes between as a quarantined gap. Every byte of an archive lies in a record or a gap.
A gzip member may hold any number of records; inside it, the search goes on in its decompressed bytes, which are
read a window at a time. From a member that fails as a whole, the records whose payload digests hold are still
recovered, with a warning, and the member is reported as a gap all the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, tune, written

SEGMENT = 1 << 20  # compressed bytes after which a new archive begins
LEVEL = 3
LEAST = 100  # bytes of a payload from which an equal one is stored as a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:millrace:page:"
MAGIC = b"\x1f\x8b\x08"
STEP, WINDOW = 1 << 16, 1 << 20  # bytes that are given to the decompressor, and that it gives back, at once
HEADER, MOST = 1 << 20, 1 << 29  # bytes of a record's header, and of a record inside a gzip member, from which it is damage
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
RESUME = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, as a gzip member. A revisit keeps the HTTP header, with the length of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Part:
    """A stretch of an archive: a record, or a gap and what was wrong there.

    inside: where it lies in the decompressed bytes of the gzip member from start to end, unless it is all of these.
    warning: why a record's member failed, though the record itself did not.
    """

    start: int
    end: int
    error: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    inside: tuple[int, int] | None = None
    warning: str | None = None

    def payload(self) -> bytes:
        """The block without its HTTP header, if it has one."""
        if "application/http" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def payload_length(self) -> int:
        """Of the full payload: what the HTTP header declares for a revisit."""
        if self.headers.get("warc-type") == "revisit":
            m = re.search(rb"(?i)^content-length:\s*(\d+)", self.block, re.MULTILINE)
            return int(m[1]) if m else 0
        return len(self.payload())


def digest_holds(headers: dict[str, str], payload: bytes) -> bool | None:
    """Whether the payload has the declared digest; None where none is declared that can be checked."""
    kind, _, want = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() not in ("sha1", "sha256") or headers.get("warc-type") == "revisit":
        return None
    found = hashlib.new(kind.lower(), payload)
    return want.lower() == found.hexdigest() or want.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def _headers(lines: str) -> dict[str, str] | None:
    """Names in lower case with their values, lines that begin with white space going on with the one before; None if a line has no colon."""
    out: dict[str, str] = {}
    name = None
    for line in filter(None, re.split(r"\r?\n", lines)):
        if line[0] in " \t" and name is not None:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return None
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def parse(data: bytes | bytearray, start: int, whole: bool = True) -> Part | int:
    """The record whose version line begins at start; its error says which check failed.

    Where data is not the whole yet and the record may end behind it: how many bytes of data are needed to go on.
    """
    m = VERSION.match(data, start)
    if not m:
        return Part(start, start, "no version line")
    head_end = data.find(b"\r\n\r\n", m.end() - 2, m.end() + HEADER)
    if head_end < 0:
        if not whole and len(data) < m.end() + HEADER:
            return min(len(data) + WINDOW, m.end() + HEADER)
        return Part(start, start, "header without an end")
    headers = _headers(data[m.end() : head_end].decode("utf-8", "replace"))
    if headers is None:
        return Part(start, start, "header line without a colon")
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        return Part(start, start, "no content length")
    if not all(headers.get(x) for x in ("warc-type", "warc-record-id", "warc-date")):
        return Part(start, start, "a required header is missing")
    block_at = head_end + 4
    end = block_at + int(headers["content-length"])
    if end + 4 > len(data):
        if not whole and end - start <= MOST:
            return end + 4
        return Part(start, start, "shorter than its content length" if whole else f"longer than {MOST} bytes")
    if data[end : end + 4] != b"\r\n\r\n":
        return Part(start, start, "no end after its content length")
    part = Part(start, end + 4, None, headers, bytes(data[block_at:end]))
    if digest_holds(headers, part.payload()) is False:
        part.error = "payload digest differs"
    return part


class Inflate:
    """The decompressed bytes of the gzip member that begins at start, in pieces; after these, its end or its error."""

    def __init__(self, data: bytes, start: int) -> None:
        self.data, self.start, self.end, self.error = data, start, None, None

    def __iter__(self) -> Iterator[bytes]:
        unpack, at = zlib.decompressobj(31), self.start
        while True:
            piece = unpack.unconsumed_tail
            if not piece:
                piece = self.data[at : at + STEP]
                at += len(piece)
            try:
                out = unpack.decompress(piece, WINDOW)
            except zlib.error as e:
                self.error = f"gzip: {e}"
                return
            if out:
                yield out
            if unpack.eof:
                self.end = at - len(unpack.unused_data)
                return
            if not piece and not out:
                self.error = "gzip member without an end"
                return


def remains(data: bytes, start: int, step: int = 256) -> Iterator[bytes]:
    """What can be decompressed of a damaged gzip member, without its checks."""
    try:
        flags, at = data[start + 3], start + 10
        if flags & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for flag in (8, 16):
            if flags & flag:
                at = data.index(b"\0", at) + 1
    except (IndexError, ValueError):
        return
    at += 2 * bool(flags & 2)
    unpack = zlib.decompressobj(-15)
    while not unpack.eof:
        piece = unpack.unconsumed_tail
        if not piece:
            piece = data[at : at + step]
            at += len(piece)
        try:
            out = unpack.decompress(piece, WINDOW)
        except zlib.error:
            return
        if out:
            yield out
        if not piece and not out:
            return


def within(pieces: Iterator[bytes]) -> Iterator[Part]:
    """Records and gaps of a stream of bytes, in order. No more than a record and a window are held."""
    held, base, done = bytearray(), 0, False
    at, gap, why = 0, -1, None

    def fill(size: int) -> None:
        nonlocal done
        while not done and len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                done = True
            else:
                held.extend(piece)

    while True:
        fill(at - base + 32)
        if at >= base + len(held):
            break
        part = parse(held, at - base, done)
        while isinstance(part, int):
            fill(part)
            part = parse(held, at - base, done)
        if part.error is None:
            if gap >= 0:
                yield Part(gap, at, why)
                gap = -1
            yield Part(at, base + part.end, None, part.headers, part.block)
            at = base + part.end
            del held[: at - base]
            base = at
            continue
        if gap < 0:
            gap, why = at, part.error
        m = VERSION.search(held, at + 1 - base)
        while not m and not done:
            cut = max(0, len(held) - 32)  # a version line may have begun
            del held[:cut]
            base += cut
            fill(len(held) + WINDOW)
            m = VERSION.search(held, max(0, at + 1 - base))
        at = base + (m.start() if m else len(held))
    if gap >= 0:
        yield Part(gap, base + len(held), why)


def salvage(data: bytes) -> Iterator[Part]:
    """Records and gaps of an archive in order, gzip members and plain records in any mixture."""
    at, gap, why = 0, -1, None
    while at < len(data):
        if data.startswith(MAGIC, at):
            source, first, size = Inflate(data, at), [], 0
            for piece in source:  # its checks come last, so a long member is read twice
                size += len(piece)
                if size <= WINDOW:
                    first.append(piece)
            if source.error is None:
                waiting = None  # a gap at the member's beginning, until there is a record
                found = False
                for p in within(iter(first) if size <= WINDOW else iter(Inflate(data, at))):
                    own = Part(at, source.end, p.error, p.headers, p.block, None if (p.start, p.end) == (0, size) else (p.start, p.end))
                    if not found and p.error is not None:
                        waiting = own
                        continue
                    if not found:
                        found = True
                        if gap >= 0:
                            yield Part(gap, at, why)
                            gap = -1
                        if waiting:
                            yield waiting
                    yield own
                if not found and gap < 0:
                    gap, why = at, waiting.error if waiting else "an empty gzip member"
                at = source.end
                continue
            error, after = source.error, at + 1
            for p in within(remains(data, at)):
                if p.error is None and digest_holds(p.headers, p.payload()):
                    yield Part(at, at, None, p.headers, p.block, (p.start, p.end), error)
        else:
            part = parse(data, at)
            if part.error is None:
                if gap >= 0:
                    yield Part(gap, at, why)
                    gap = -1
                yield part
                at = part.end
                continue
            # a failed plain record may reach over later ones, so the search goes on right behind its first byte
            error, after = part.error, at + 1
        if gap < 0:
            gap, why = at, error
        m = RESUME.search(data, after)
        at = m.start() if m else len(data)
    if gap >= 0:
        yield Part(gap, len(data), why)


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(key, url, payload, digest, refers_to) of every row: which are stored and which refer to an equal one.

    Of the rows whose payloads of LEAST or more bytes are equal, those with the smallest key are stored, the
    others refer to it. Payloads are UTF-8; a null text is an empty payload, a null url stays null. Rows with a
    null key come after all others. Repeated rows with the smallest key are all stored.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # the payloads stay where they are: digests alone are counted, and only those that occur again are joined
    again = rows.filter(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "least")
    again = written(again, "warc-again")  # its size is known now: the join broadcasts it only where it is small
    joined = rows.join(again, "digest", "left")
    return joined.select("key", "url", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def write(planned: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, data): archives of whole gzip members, of about SEGMENT bytes; written to shared storage."""
    tune(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, parts = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            out = pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])
            made, held = made + 1, 0
            parts.clear()
            return out

        for batch in batches:
            for part in slices(batch, 2):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    parts.append(record(*row, date=date))
                    held += len(parts[-1])
                    if held >= SEGMENT:
                        yield flush()
        if parts:
            yield flush()

    return written(planned.select("key", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, data binary"), "warc", compression="uncompressed")


PARTS = "archive string, start long, end long, inner_start long, inner_end long, error string, warning string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def read(archives: DataFrame) -> DataFrame:
    """One row per record or quarantined gap of (archive, data) rows.

    start and end are bytes of the archive. Records and gaps inside a gzip member that holds more than one record
    have the member's start and end, and inner_start and inner_end in its decompressed bytes. Of a gap, error says
    which check failed first and the record's columns are null; of a record, error is null. A record with a warning
    was recovered from a member that fails as a whole, which the warning tells; its start and end are where the member
    begins, and the member's bytes are in a gap. A null or empty archive has no row.
    """
    tune(archives.sparkSession)
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PARTS.split(", ")]

    def row(archive: str, p: Part) -> tuple:
        place = archive, p.start, p.end, *(p.inside or (None, None)), p.error, p.warning
        if p.error is not None:
            return *place, *[None] * 7
        h = p.headers
        return *place, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), p.payload_length(), p.payload()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for p in salvage(data.as_py() or b""):
                    rows.append(row(name, p))
                    held += len(p.block)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("archive", "data").mapInArrow(run, PARTS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The same for .warc and .warc.gz files; each file is read whole, as one row, so it must fit in a task's memory."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data")))
