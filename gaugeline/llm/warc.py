"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

Records are gzip members. Of the records with equal payloads of at least ``least`` bytes, the one with the largest page id is
written as a response, the others as revisits that refer to it; the groups are found on (page id, digest) alone, without the
payloads. Files are written under a temporary name in the shared folder and renamed, so a task that runs twice leaves one file.

The reader checks lengths and payload digests. After a failed check it searches for the next gzip member that starts with a
version line, or in plain archives the next version line, goes on from there, and reports the byte gap with the reason.

Defined results: a null payload is empty; null or unusable urls have no target header; null page ids are kept as null; rows
that share the group's largest page id are all responses; an empty table gives no file and no rows; a payload of any length is one record; columns other than page id, url and html are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.storage import keep, open_fs, small, work_folder

LEAST = 1000
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Archives have no dates of their own here; a fixed one makes equal input give equal bytes.
DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------ records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record, uncompressed."""
    block = HTTP + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{kind}/{digest}")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url and not re.search(r"[\x00-\x20]", url):
        head.append(f"WARC-Target-URI: {url}")
    if kind == "revisit":
        refers = uuid.uuid5(uuid.NAMESPACE_OID, f"{refers_to}/response/{digest}")
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Damaged(Exception):
    """A record or a member that fails a check."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def parse(raw: bytes) -> tuple[Record, int]:
    """The record at the start of ``raw`` and its length with the two line ends after it."""
    start = VERSION.match(raw)
    if not start:
        raise Damaged("no version line")
    end = re.compile(rb"\r?\n\r?\n").search(raw, start.end() - 1)
    if not end:
        raise Damaged("header doesn't end")
    headers: dict[str, str] = {}
    # Lines end at line feeds only, and only blanks and tabs surround values: a url may hold other line ends and spaces of Unicode.
    for line in re.split(r"\r?\n", raw[start.end() : end.start()].decode("utf-8", "replace")):
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.strip(" \t").lower()] = value.strip(" \t")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    block = raw[end.end() : end.end() + int(length)]
    if len(block) < int(length):
        raise Damaged("block is cut short")
    tail = re.compile(rb"\r?\n\r?\n").match(raw, end.end() + int(length))
    if not tail:
        raise Damaged("block is followed by something else")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        _, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("no end of HTTP header")
    found = Record(headers, payload)
    stated = headers.get("warc-payload-digest", "")
    if stated.startswith("sha1:") and headers.get("warc-type") != "revisit":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated[5:]:
            raise Damaged("payload digest differs")
    return found, tail.end()


# ------------------------------------------------------------------ salvage reader


@dataclass
class Gap:
    """Bytes start to end (exclusive) of the archive that hold nothing readable."""

    start: int
    end: int
    reason: str


class Source:
    """Reads a file by position through one buffer."""

    def __init__(self, f) -> None:
        self.f, self.size = f, f.size() if callable(getattr(f, "size", None)) else f.seek(0, 2)
        self.at, self.buffer = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.buffer):
            self.f.seek(at)
            self.at, self.buffer = at, self.f.read(max(n, CHUNK))
        return self.buffer[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int) -> int:
        """Position of the next occurrence from ``at``, or the end of the file."""
        while at < self.size:
            some = self.read(at, CHUNK)
            k = some.find(pattern)
            if k >= 0:
                return at + k
            at += max(1, len(some) - len(pattern) + 1)
        return self.size


def _unpack(source: Source, at: int) -> tuple[bytes, int]:
    """The gzip member at this position, unpacked, and where it ends."""
    opened, out, begin = zlib.decompressobj(31), [], at
    step = 1 << 16
    while not opened.eof:
        some = source.read(at, min(step, source.size - at))
        if not some:
            raise Damaged("member is cut short")
        try:
            out.append(opened.decompress(some))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from e
        if at == begin and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
            raise Damaged("member isn't a record")
        at += len(some) - len(opened.unused_data)
    return b"".join(out), at


def _plain(source: Source, at: int) -> tuple[bytes, int]:
    """Enough bytes for the plain record at this position: its header and as many as the header states."""
    n = 1 << 16
    while True:
        some = source.read(at, min(n, source.size - at))
        end = re.search(rb"\r?\n\r?\n", some)
        if end or at + n >= source.size:
            break
        n *= 2
        if n > 1 << 24:
            raise Damaged("header doesn't end")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", some[: end.start()]) if end else None
    if not length:
        raise Damaged("no content length")
    want = end.end() + int(length[1]) + 4
    if at + end.end() + int(length[1]) > source.size:
        raise Damaged("block is cut short")
    return source.read(at, min(want, source.size - at)), at


def salvage(f) -> Iterator[tuple[int, Record] | Gap]:
    """Records with their positions, and the gaps between them, of a plain or compressed archive, in order."""
    source = Source(f)
    at, bad, reason = 0, None, ""
    # Where each pattern comes next: searched for again only when that place is passed, so the file is gone through once for each.
    ahead = {GZIP: -1, b"WARC/1.": -1}
    while at < source.size:
        packed = source.read(at, 3) == GZIP
        try:
            if packed:
                raw, end = _unpack(source, at)
                found, used = parse(raw)
                if used != len(raw):
                    raise Damaged("more than a record in a member")
            else:
                if source.read(at, 5) != b"WARC/":
                    raise Damaged("neither a member nor a version line")
                raw, _ = _plain(source, at)
                found, used = parse(raw)
                end = at + used
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            ahead = {pattern: place if place > at else source.find(pattern, at + 1) for pattern, place in ahead.items()}
            at = min(ahead.values())
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield at, found
        at = end
    if bad is not None:
        yield Gap(bad, source.size, reason)


# ------------------------------------------------------------------ distributed writing and reading


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """digest, refers_to: for each payload that occurs more than once, the page that carries it."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("n")).filter(F.col("n") >= least)
    return slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write archives into ``folder`` and return their manifest: path, n_records, n_bytes.

    The table of repeated payloads is written first; it is broadcast only if a count shows that it is small, else joined by
    a shuffle in which Spark splits the partitions of hot payloads.
    """
    repeated = small(keep(roles(pages, id_col, payload_col, least), "warc-roles"))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "refers_to")
    manifest = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, number, out = TaskContext.get().partitionId(), 0, None
        records = size = 0

        def close() -> pa.RecordBatch:
            out.close()
            target = f"pages-{part:05d}-{number:03d}.warc.gz"
            fs.move(temporary, f"{base}/{target}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{target}"], "n_records": [records], "n_bytes": [size]}, manifest)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    temporary = f"{base}/{uuid.uuid4().hex}.part"
                    out, records, size = fs.open_output_stream(temporary), 0, 0
                revisit = refers_to is not None and page_id != refers_to
                raw = member(record("revisit" if revisit else "response", page_id, url, payload, digest, refers_to if revisit else None))
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return keep(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


COLUMNS = "path string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string"


def read(files: DataFrame, payloads: bool = False, whole: bool = False) -> DataFrame:
    """A row for each record of the archives in column ``path``, and for each quarantined gap (column gap: the reason, else null).

    Digest and length of a revisit's payload are those its record states; those of other records are taken from the bytes,
    and checked against the record. With ``payloads``, column payload has the bytes. With ``whole``, files is a manifest, and an
    archive with a gap or another number of records than it states is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, stated in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    rows: list[tuple] = []
                    size = records = 0
                    for found in salvage(f):
                        if whole and isinstance(found, Gap):
                            raise Damaged(f"{path}, bytes {found.start} to {found.end}: {found.reason}")
                        records += 1
                        rows.append(_row(path, found, payloads))
                        size += len(rows[-1][-1] or b"") if payloads else 0
                        if len(rows) >= 4096 or size >= 4 << 20:
                            yield _batch(rows, payloads)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, payloads)
                    if whole and records != stated:
                        raise Damaged(f"{path}: {records} records of {stated}")

    # A task for each archive.
    place = (F.row_number().over(Window.orderBy("path")) - 1).alias("place")
    spread = files.select("path", F.col("n_records") if whole else F.lit(None).cast("long").alias("n_records"), place).repartitionById(max(1, files.count()), F.col("place"))
    return spread.mapInArrow(run, COLUMNS + (", payload binary" if payloads else ""))


def _row(path: str, found: tuple[int, Record] | Gap, payloads: bool) -> tuple:
    if isinstance(found, Gap):
        row = (path, found.start, found.end, None, None, None, None, None, None, found.reason)
        return (*row, None) if payloads else row
    at, rec = found
    h = rec.headers
    number = lambda name: int(h[name]) if re.fullmatch(r"-?\d+", h.get(name, "")) else None
    revisit = h.get("warc-type") == "revisit"
    stated = h.get("warc-payload-digest", "")
    digest = base64.b32decode(stated[5:]).hex() if revisit and stated.startswith("sha1:") else hashlib.sha1(rec.payload).hexdigest()
    size = number("warc-payload-length") if revisit else len(rec.payload)
    row = (path, at, None, number("warc-page-id"), h.get("warc-target-uri"), size, digest, h.get("warc-type"), number("warc-refers-to-page-id"), None)
    return (*row, None if revisit else rec.payload) if payloads else row


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in COLUMNS.split(", ")] + (["payload"] if payloads else [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=False)], names)


def page_rows(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to new archives in the shared folder and return what the archives hold of each page; if one can't be read, that is an error."""
    found = read(write(pages, work_folder(spark, "warc")), whole=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
