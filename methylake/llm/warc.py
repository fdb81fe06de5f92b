"""Operator 6, WARC: records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file (as web archive collections use) of two stored members: archive/data.warc.gz, one gzip
member a record, and indexes/index.cdxj, a line of JSON for each record with its offset and length in the former.
The reader parses the end records, ZIP64 ones too, and the central directory, finds the members' data from their
local headers and reads only the ranges it needs.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import attempt_name, filesystem, fresh_dir, map_arrow, write_file, written

#: Compressed bytes after which an archive is closed, by default; a task holds one at a time.
ARCHIVE_BYTES = 32 << 20
#: Bytes of neighbouring records read at once.
RANGE_BYTES = 1 << 20
#: Repeated payloads, some 60 bytes each, up to which they are broadcast and no payload is shuffled.
BROADCAST_REPEATS = 500_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record: a revisit when refers_to is given, else a response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str
    record_type: str
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse_record(raw: bytes) -> Record:
    """Checks lengths and digests; a revisit's payload is empty, payload_bytes and payload_digest are the original's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(field["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or field["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"broken record {field.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    sha1 = field["warc-payload-digest"].removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"broken payload in {field.get('warc-record-id')}")
    number = lambda v: None if v == "<urn:page:none>" else int(v[len("<urn:page:") : -1])
    return Record(number(field["warc-record-id"]), field["warc-target-uri"], kind, payload, size, sha1, number(field["warc-refers-to"]) if kind == "revisit" else None)


class ArchiveWriter:
    """Gathers records; close() gives the ZIP file's bytes."""

    def __init__(self):
        self.data, self.lines, self.count = io.BytesIO(), [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        at = self.data.tell()
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.data.write(pack.compress(record) + pack.flush())
        self.lines.append(json.dumps({"page": page_id, "offset": at, "length": self.data.tell() - at}))
        self.count += 1

    def close(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((DATA, self.data.getvalue()), (INDEX, "\n".join(self.lines).encode())):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                with z.open(info, "w", force_zip64=zip64) as member:
                    member.write(data)
        return out.getvalue()


class ZipRanges:
    """Members of a ZIP file, over anything with size and read_at(n, offset), without reading whole members."""

    def __init__(self, size: int, read_at):
        self.size, self.read_at = size, read_at
        tail = read_at(min(size, 22 + 65535 + 20), max(0, size - 22 - 65535 - 20))
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            where = struct.unpack_from("<Q", tail, at - 12)[0]
            end = read_at(56, where)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # name: local header, stored size, method
        table, p = read_at(length, start), 0
        for _ in range(count):
            if table[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", table, p + 8)
            packed, full = struct.unpack_from("<II", table, p + 20)
            n, m, c = struct.unpack_from("<HHH", table, p + 28)
            offset = struct.unpack_from("<I", table, p + 42)[0]
            name = table[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = table[p + 46 + n : p + 46 + n + m], 0
            while e + 4 <= len(extra):
                tag, k = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = iter(struct.unpack(f"<{k // 8}Q", extra[e + 4 : e + 4 + k // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                e += 4 + k
            self.members[name] = (offset, packed, method)
            p += 46 + n + m + c

    def data_start(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes."""
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is packed; only stored members can be read by range")
        head = self.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n + m, size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.data_start(name)
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError("range outside the member")
        return self.read_at(length, start + offset)


def read_archive(size: int, read_at) -> Iterator[Record]:
    """All records, by the index; neighbouring ranges are read together up to RANGE_BYTES."""
    z = ZipRanges(size, read_at)
    entries = [json.loads(x) for x in z.read(INDEX).decode().split("\n") if x]
    i = 0
    while i < len(entries):
        j, first = i, entries[i]["offset"]
        while j + 1 < len(entries) and entries[j + 1]["offset"] == entries[j]["offset"] + entries[j]["length"] and entries[j + 1]["offset"] + entries[j + 1]["length"] - first <= RANGE_BYTES:
            j += 1
        run = z.read(DATA, first, entries[j]["offset"] + entries[j]["length"] - first)
        for e in entries[i : j + 1]:
            yield parse_record(zlib.decompress(run[e["offset"] - first : e["offset"] - first + e["length"]], 31))
        i = j + 1


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row into archives in the shared folder; (path, records) of each, a finished table.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are responses and the others
    revisits of it; smaller payloads are all responses. A null payload is an empty one. Rows with null ids are never
    referred to; where a payload has only such rows, all are responses. Rows that repeat the smallest id are
    responses too. Table and files together survive lost executors: every attempt writes names of its own, and only
    those of finished tasks are in the table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    repeats = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null")
    repeats = written(repeats.select("sha", "n", "first"), "warc-repeats")
    few = repeats.count() <= BROADCAST_REPEATS
    # else both sides are shuffled by payload, and adaptive execution splits the rows of a very common one
    decided = rows.join(F.broadcast(repeats) if few else repeats, ["sha", "n"], "left")
    decided = decided.select("id", "url", "payload", "sha", F.when(F.col("first") != F.coalesce("id", F.col("first") - 1), F.col("first")).alias("refers"))
    folder = fresh_dir(df.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive, done = attempt_name(), ArchiveWriter(), []

        def close() -> None:
            nonlocal archive
            path = f"{folder}/{name}-{len(done):06d}.wacz"
            write_file(path, archive.close())
            done.append((path, archive.count))
            archive = ArchiveWriter()

        for batch in batches:
            for page, url, payload, sha, refers in zip(*batch.columns, strict=True):
                page = page.as_py()
                archive.add(page, build_record(page, url.as_py(), payload.as_py(), base64.b32encode(sha.as_py()).decode(), refers.as_py(), date))
                if archive.data.tell() >= archive_bytes:
                    close()
        if archive.count:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return written(map_arrow(decided, write, "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives (path): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if payloads, payload (binary; null for revisits). url is what the record says: urn:none for a null url,
    control characters and spaces as escapes. A page without an id has a null one, records of repeated rows all come,
    an empty table of archives gives an empty one, and a broken archive is an error."""
    spark = archives.sparkSession
    paths = archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = filesystem(path)
                with system.open_input_file(name) as f:
                    held: list[Record] = []
                    for r in read_archive(f.size(), f.read_at):
                        held.append(r)
                        if len(held) == 256:
                            yield pack(held)
                            held = []
                    yield pack(held)

    def pack(rs: list[Record]) -> pa.RecordBatch:
        columns = {
            "page_id": pa.array([r.page_id for r in rs], pa.int64()), "url": pa.array([r.url for r in rs], pa.string()), "payload_bytes": pa.array([r.payload_bytes for r in rs], pa.int64()), "payload_digest": pa.array([r.payload_digest for r in rs], pa.string()),
            "record_type": pa.array([r.record_type for r in rs], pa.string()), "refers_to": pa.array([r.refers_to for r in rs], pa.int64()),
        }
        if payloads:
            columns["payload"] = pa.array([r.payload if r.record_type == "response" else None for r in rs], pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_arrow(paths, read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def warc_round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes the rows of df as archives and reads all records back: see write_archives and read_archives."""
    return read_archives(write_archives(df, **options))
