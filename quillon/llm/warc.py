"""WARC records in ZIP packages: written by Spark tasks, read back by ranges without extraction.

A package is a ZIP file with two stored (uncompressed) members: archive/data.warc.gz, in which every record is
a gzip member of its own, and indexes/index.cdxj, a line for each record with its offset and length.  The reader
parses the end of the file, the ZIP64 locator and directory if there is one, and the central directory; it
takes the index from its member and reads each record as a range of the package.  Stores that only Spark reads have no ranges for
Python, so a task gets a package of PACKAGE bytes and the ranges are of those.

Of records with equal payloads the one with the smallest page_id is a response, the others are revisits that
refer to it; payloads under `least_bytes` are all responses.  A null html is an empty payload; a null url is written, and read back,
as an empty one.  A null page_id is a response, or a revisit of none.  Rows that
repeat page_id and html are equal captures and share a type.  Tasks write whole files of at most about PACKAGE
bytes through Spark's committing writer: a lost executor leaves no partial package.  Extra columns are not
written; an empty table gives no packages and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import materialise, tidied

PACKAGE = 6 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP message, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def page_of(urn: str | None) -> int | None:
    tail = urn[len("<urn:page:") : -1] if urn else "None"
    return None if tail == "None" else int(tail)


# ---------------------------------------------------------------- ZIP packages


def zip_stored(members: list[tuple[str, bytes]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 writes 64-bit sizes and offsets even where 32 bits would do."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, big = len(out), zlib.crc32(data), zip64 or len(data) >= 0xFFFFFFFF
        far = zip64 or at >= 0xFFFFFFFF
        size = 0xFFFFFFFF if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0, 0, 0, 0x21, crc, size, size, len(name), len(extra)) + name.encode() + extra + data
        wide = (struct.pack("<QQ", len(data), len(data)) if big else b"") + (struct.pack("<Q", at) if far else b"")
        extra = struct.pack("<HH", 1, len(wide)) + wide if wide else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else at)
        central += name.encode() + extra
    start, n = len(out), len(members)
    out += central
    if zip64 or start >= 0xFFFFFFFF or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    else:
        size = len(central)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, len(comment)) + comment
    return bytes(out)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipPackage:
    """The directory of a ZIP file behind a function read(offset, length), and ranges of its stored members."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        reach = min(size, 22 + 0xFFFF)
        tail = read(size - reach, reach)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == n or 0xFFFFFFFF in (length, start):
            place = size - reach + at - 20
            sign, _, where, _ = struct.unpack("<IIQI", read(place, 20))
            if sign != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            sign, *_, n, length, start = struct.unpack("<IQHHIIQQQQ", read(where, 56))
            if sign != 0x06064B50:
                raise ValueError("no ZIP64 end of central directory")
        self.members: dict[str, Member] = {}
        raw, at = read(start, length), 0
        for _ in range(n):
            sign, *_rest = struct.unpack_from("<I", raw, at)
            if sign != 0x02014B50:
                raise ValueError("broken central directory")
            method, _, _, _, stored, whole, name_n, extra_n, note_n = struct.unpack_from("<HHHIIIHHH", raw, at + 10)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + name_n].decode()
            extra, e = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while e + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                    whole = next(wide) if whole == 0xFFFFFFFF else whole
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + m
            self.members[name] = Member(name, method, whole, stored, header)
            at += 46 + name_n + extra_n + note_n

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin: after its local header."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; ranges need a stored member")
        sign, *_, name_n, extra_n = struct.unpack("<IHHHHHIIIHH", self.read(member.header, 30))
        if sign != 0x04034B50:
            raise ValueError("broken local header")
        return member.header + 30 + name_n + extra_n

    def range(self, name: str, offset: int, length: int) -> bytes:
        member = self.members[name]
        if offset < 0 or offset + length > member.size:
            raise ValueError("range outside of its member")
        return self.read(self.begin(name) + offset, length)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name].size)


def index_lines(package: ZipPackage) -> Iterator[dict]:
    for line in package.whole(INDEX).decode().split("\n")[:-1]:
        yield json.loads(line.split(" ", 2)[2])


def records(package: ZipPackage) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Every record that the index lists, each read as a range."""
    base = package.begin(DATA)
    for entry in index_lines(package):
        raw = package.read(base + entry["offset"], entry["length"])
        yield parse_record(gzip.decompress(raw))


# ---------------------------------------------------------------- Spark


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null: a response).

    Digests go to a table without html, and the smallest page_id of each repeated one to another, so that a digest which very many
    pages share can be split where both meet.  Pages that a filter of the revisits says nothing about are responses and don't
    shuffle; the others meet the revisits.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    light = materialise(rows.where(F.length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("digest")), "digests")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last").drop("last")
    again = materialise(light.join(materialise(firsts, "firsts"), "digest").where("page_id <> refers_to").distinct(), "again")
    filters = bloom.members(again, "page_id")
    key = lambda batch: batch.column("page_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    maybe = bloom.picked(rows, filters, key, True).withColumn("digest", F.sha1("payload")).join(again, ["page_id", "digest"], "left")
    alone = bloom.picked(rows, filters, key, False).withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "url", "payload", "refers_to"]
    return alone.select(names).unionByName(maybe.select(names))


def write_packages(found: DataFrame, path: str, package_bytes: int = PACKAGE) -> None:
    """Rows of captures() as packages; a package's comment is the line feed that Spark's text writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def package() -> pa.RecordBatch:
            lines = "".join(sorted(index)).encode()
            made = zip_stored([(DATA, bytes(data)), (INDEX, lines)], comment=b"\n")[:-1]
            data.clear()
            index.clear()
            return pa.record_batch([pa.array([made], pa.binary())], ["package"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                body = payload.as_py()
                raw = gzip.compress(record(page_id, url, body, refers_to), 1, mtime=0)
                entry = {"page_id": page_id, "offset": len(data), "length": len(raw), "digest": "sha1:" + payload_digest(body)}
                uri = (url or "-").replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A") or "-"
                index.append(f"{uri} {DATE} {json.dumps(entry)}\n")
                data.extend(raw)
                if len(data) >= package_bytes:
                    yield package()
        if index:
            yield package()

    made = found.mapInArrow(tidied(run), "package binary")
    made.select(F.col("package").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                package = ZipPackage(lambda at, n, view=view: bytes(view[at : at + n]), len(view))
                out = []
                for fields, http, payload in records(package):
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
                    if kind == "response" and (payload_digest(payload) != told or len(payload) != size):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
                    out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, told, kind, page_of(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                for i in range(0, len(out), 500):
                    cols = list(zip(*out[i : i + 500], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, ARROW, strict=True)], [n for n, _ in ARROW])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(tidied(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


ARROW = [
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
    ("payload", pa.binary()),
]
