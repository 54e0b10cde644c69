"""Web archives in ZIP packages, read in place.

A package holds `archive/data.warc.gz` (one gzip member for each WARC 1.1 record) and `indexes/index.cdxj` (a line with
the offset and length of each record). Both are stored, not compressed again, so a record is read with a single range
read: the reader takes the end record, the ZIP64 end record where there is one and the central directory, finds where
a member's data begin from its local header, and never extracts anything.

Records of equal payloads of at least 100 bytes are kept once: the one with the smallest page id is a `response`, the
others are `revisit` records that refer to it and carry the HTTP header alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, saved, scratch

LEAST_REVISIT = 100
SALTS = 32
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


class Package:
    """The members of a ZIP file, from its central directory; file is an open pyarrow file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail_at = max(0, size - 65557)
        tail = file.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and end + tail_at >= 20:
            locator = file.read_at(20, tail_at + end - 20)
            if locator[:4] == b"PK\6\7":
                record = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
                if record[:4] != b"PK\6\6":
                    raise ValueError("broken ZIP64 end record")
                count, length, at = struct.unpack_from("<QQQ", record, 32)
        directory, self.members, here = file.read_at(length, at), {}, 0
        for _ in range(count):
            if directory[here : here + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, stored, whole, n, extra, comment, begin = struct.unpack_from("<10xH8xIIHHH8xI", directory, here)
            name = directory[here + 46 : here + 46 + n].decode()
            more, field = directory[here + 46 + n : here + 46 + n + extra], 0
            while field + 4 <= extra:
                kind, wide = struct.unpack_from("<HH", more, field)
                if kind == 1:  # ZIP64: eight bytes for each value that is all ones above, in this order
                    values = iter(struct.unpack_from(f"<{wide // 8}Q", more, field + 4))
                    whole = next(values) if whole == 0xFFFFFFFF else whole
                    stored = next(values) if stored == 0xFFFFFFFF else stored
                    begin = next(values) if begin == 0xFFFFFFFF else begin
                field += 4 + wide
            self.members[name] = Member(name, method, whole, stored, begin)
            here += 46 + n + extra + comment

    def data_at(self, name: str) -> int:
        """Where the bytes of a stored member begin in the file."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in place")
        header = self.file.read_at(30, member.header_at)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"broken local header of {name}")
        return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))

    def read(self, name: str) -> bytes:
        return self.file.read_at(self.members[name].size, self.data_at(name))


def _block(lines: list[str]) -> bytes:
    return "\r\n".join([*lines, "", ""]).encode()


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record as one gzip member; with refers_to, a revisit without payload."""
    url = "".join(c if c >= " " else "%{:02X}".format(ord(c)) for c in url)
    http = _block(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"]
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(_block([*head, f"Content-Length: {len(body)}"]) + body + b"\r\n\r\n") + packer.flush()


@dataclass(frozen=True)
class Record:
    kind: str
    page_id: int | None
    url: str
    payload: bytes | None  # None in a revisit
    payload_bytes: int
    digest: str
    refers_to: int | None


def parse_record(raw: bytes) -> Record:
    """A Record from one gzip member; for a response, length and digest are those of the payload itself."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version!r}")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(field["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(x) if x else None
    common = {"kind": field["WARC-Type"], "page_id": number(field["X-Page-ID"]), "url": field["WARC-Target-URI"], "refers_to": number(field.get("X-Refers-To-Page-ID", ""))}
    if common["kind"] == "revisit":
        length = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
        return Record(payload=None, payload_bytes=length, digest=field["WARC-Payload-Digest"].partition(":")[2], **common)
    return Record(payload=payload, payload_bytes=len(payload), digest=hashlib.sha256(payload).hexdigest(), **common)


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to (null for a response).

    Only payloads that repeat are matched; their smallest ids are salted so that a payload with a third of all pages
    is spread over SALTS keys. Pages without id are never referred to, and stay responses if no page of theirs has one;
    of rows that share the smallest id, all are responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    firsts = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("_digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    rows = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")), "left")
    other = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    return rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """The manifest (path, records, bytes) of packages below the shared folder, one for each partition with rows.

    Null html counts as empty, a null url as empty. Each try of a task writes a file of its own; the manifest, which
    Spark commits, names those that count. Repeated rows and rows without page_id are records of their own; columns other
    than page_id, url and html are ignored, whatever their names; of a table without rows the manifest is empty. Payloads of
    any length are written whole.
    """
    spark = pages.sparkSession
    root = scratch(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        filesystem, folder = pafs.FileSystem.from_uri(root)
        filesystem.create_dir(folder)
        name, index, at = f"part-{uuid.uuid4().hex}.wacz", [], 0
        with filesystem.open_output_stream(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            stamp = (1980, 1, 1, 0, 0, 0)
            with package.open(zipfile.ZipInfo(DATA, stamp), "w", force_zip64=True) as data:
                for batch in (b for own in ((first,), batches) for b in own):
                    for i in range(batch.num_rows):
                        page_id, url, payload, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                        raw = make_record(page_id, url, payload, digest, refers)
                        data.write(raw)
                        index.append(json.dumps({"url": url, "offset": at, "length": len(raw), "page_id": page_id}))
                        at += len(raw)
            package.writestr(zipfile.ZipInfo(INDEX, stamp), "\n".join(index))
        yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return saved(mark_revisits(pages).mapInArrow(write, "path string, records long, bytes long"), "archive-manifest")


def read_archives(manifest: DataFrame, content: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record in the packages.

    An empty manifest gives no rows.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * content

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (x for b in batches for x in b.column(0).to_pylist()):
            filesystem, path = pafs.FileSystem.from_uri(uri)
            package = Package(filesystem.open_input_file(path))
            begin, lines = package.data_at(DATA), package.read(INDEX).decode().split("\n")
            for i in range(0, len(lines), 256):
                found = []
                for line in map(json.loads, lines[i : i + 256]):
                    found.append(parse_record(package.file.read_at(line["length"], begin + line["offset"])))
                columns = [pa.array([x.page_id for x in found], pa.int64()), pa.array([x.url for x in found], pa.string()), pa.array([x.payload_bytes for x in found], pa.int64()),
                    pa.array([x.digest for x in found], pa.string()), pa.array([x.kind for x in found], pa.string()), pa.array([x.refers_to for x in found], pa.int64())]
                columns += [pa.array([x.payload for x in found], pa.binary())] * content
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(columns)])

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(read, schema)
