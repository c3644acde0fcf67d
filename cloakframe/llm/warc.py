"""WARC archives: written by tasks, read back sequentially and verified.

Every record is a gzip member of its own. Tasks write archives of about ``ARCHIVE_BYTES`` under
names nobody else uses and report them in a manifest that Spark commits; archives of a lost
or repeated task are in no manifest and are never read. The folder must be one that all
executors share (any file system that pyarrow can open; local paths, HDFS and object stores).

Reading goes through an archive in chunks: members are inflated piece by piece, headers are
parsed, exactly Content-Length bytes belong to the block, and block and payload digests
are computed on the way. A reader holds one chunk and, if asked for, one payload.

Of equal payloads (of ``least`` bytes or more) the one with the least page_id is stored as a
response; the others become revisit records that name it. Definite results: null html is empty;
null ids come last in their group; rows that repeat the least id are all responses; if no row
of a group has an id, all are responses. An empty table gives no records; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import new_scratch

ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own


class BadRecord(ValueError):
    """An archive that breaks the format or a digest that does not match."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _one_line(value: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in value or "")


def member(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    first = VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode()
    return pack.compress(first) + pack.compress(block) + pack.compress(END) + pack.flush()


def page_record(page_id, url, html: bytes, digest: bytes, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else html)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": _one_line(url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": "sha1:" + base32_sha1(hashlib.sha1(block).digest()),
        "WARC-Payload-Digest": "sha1:" + base32_sha1(digest),
    }
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    return member(headers, block)


class _Archives:
    """The archives one task writes, a new one after ARCHIVE_BYTES."""

    def __init__(self, folder: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.base, self.folder = path, folder.rstrip("/")
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def write(self, data: bytes) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.name, self.records, self.size = f"{self.folder}/{name}", 0, 0
            self.out = self.system.open_output_stream(f"{self.base}/{name}", compression=None)
            info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _DATE}
            self._put(member(info | {"Content-Type": "application/warc-fields"}, b"format: WARC\r\n"))
        self._put(data)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write page_id, url, html as archives; returns their manifest: path, records, bytes."""
    spark = pages.sparkSession
    folder = folder or new_scratch(spark, "warc")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.unhex(F.sha1("html")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"))

    def write(batches):
        archives = _Archives(folder)
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = len(html) >= least and first is not None and page_id != first
                archives.write(page_record(page_id, url, html, digest, first, revisit))
        archives.close()
        columns = list(zip(*archives.done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
            ["path", "records", "bytes"],
        )

    joined = rows.join(firsts, "digest").select("page_id", "url", "html", "digest", "first")
    manifest = f"{folder}/manifest"
    joined.mapInArrow(write, "path string, records long, bytes long").write.parquet(manifest)
    return spark.read.schema("path string, records long, bytes long").parquet(manifest)


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class _Member:
    """One gzip member as a stream of bytes."""

    def __init__(self, source, rest: bytes):
        self.source, self.pending = source, rest
        self.inflate = zlib.decompressobj(31)
        self.ready = bytearray()

    def more(self) -> bool:
        """Inflate a little more; False at the end of the member."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.pending or self.source.read(CHUNK)
            if not self.inflate.unconsumed_tail:
                self.pending = b""
            if not data:
                raise BadRecord("the archive ends inside a record")
            out = self.inflate.decompress(data, CHUNK)
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise BadRecord("a record without the end of its headers")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise BadRecord("a block shorter than its Content-Length")
            piece = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(piece)
            yield piece


def read_archive(path: str, keep_payload: bool = True) -> Iterator[Record]:
    """The records of one archive in order, verified."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as source:
        rest = source.read(CHUNK)
        while rest:
            part = _Member(source, rest)
            yield _record(part, keep_payload)
            rest = part.inflate.unused_data or part.pending or source.read(CHUNK)


def _record(part: _Member, keep_payload: bool) -> Record:
    first, _, head = part.until(END).partition(b"\r\n")
    if first != VERSION:
        raise BadRecord(f"not a record: {first[:40]!r}")
    record = Record(_headers(head))
    length = int(record.headers["content-length"])
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    if record.headers.get("content-type", "").startswith("application/http"):
        http = part.until(END)
        length -= len(http) + len(END)
        block.update(http + END)
        record.http = _headers(http.partition(b"\r\n")[2])
    for piece in part.pieces(length):
        block.update(piece)
        payload.update(piece)
        record.payload_bytes += len(piece)
        if keep_payload:
            kept.append(piece)
    if b"".join(part.pieces(len(END))) != END or part.more() or part.ready:
        raise BadRecord("a block longer than its Content-Length")
    stated = record.headers.get("warc-block-digest")
    if stated and stated != "sha1:" + base32_sha1(block.digest()):
        raise BadRecord("block digest does not match")
    record.payload_digest = base32_sha1(payload.digest())
    stated = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if record.headers.get("warc-type") == "revisit":
        # the payload is elsewhere: its length and digest are those stated
        record.payload_bytes = int(record.http["content-length"])
        record.payload_digest = stated
    elif stated and stated != record.payload_digest:
        raise BadRecord("payload digest does not match")
    elif keep_payload:
        record.payload = b"".join(kept)
    return record


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number not in ("", "none") else None


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row for each response or revisit in the archives of a manifest."""
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long" + (", payload binary" if keep_payload else "")
    )
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    width = 7 if keep_payload else 6

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names[:width]
        )

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for r in read_archive(path, keep_payload):
                    kind = r.headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    rows.append(
                        (
                            _page(r.headers.get("warc-record-id")),
                            r.headers.get("warc-target-uri"),
                            r.payload_bytes,
                            r.payload_digest,
                            kind,
                            _page(r.headers.get("warc-refers-to")),
                            r.payload,
                        )[:width]
                    )
                    size += len(r.payload or b"")
                    if len(rows) >= 4096 or size > 16_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    # a task for each archive, up to ten thousand tasks
    n = min(max(manifest.count(), 1), 10_000)
    return manifest.select("path").repartition(n, "path").mapInArrow(read, schema)
