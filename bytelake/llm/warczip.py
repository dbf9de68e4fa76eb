"""WARC records in ZIP packages: writing them, and reading records by range without extraction.

A package is a ZIP file whose members are stored, not deflated: archive/data-NNNNN.warc.gz (WARC records, each a gzip
member of its own, as archives usually are) and indexes/data-NNNNN.cdxj (a line of JSON for each record: offset and length
within that member). Members named .warc, with plain records, are read as well. The reader fetches the
end of the file, the ZIP64 end record where there is one, and the central directory, then the indexes, then exactly
the ranges of the records. Files are opened through pyarrow's file systems, so a store it knows serves as well as a
shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.shared import bounded_batches, cut, fresh_dir

MEMBER = 8 << 20  #: bytes of records that make a member; larger single records make larger ones
BATCH = 4 << 20  #: bytes of records that a reader hands over at once


_BREAKS = re.compile(r"[\r\n]+[ \t]*")  # a value that went on in another line could be read as other fields


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str | None, payload: bytes, fields: dict[str, str]) -> bytes:
    """A WARC 1.1 record. A revisit has no block; its payload's digest and length stand in its header."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url or "", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Payload-Length": str(len(payload)), **fields}
    block = b"" if kind == "revisit" else payload
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head |= {"Content-Type": "text/html", "Content-Length": str(len(block))}
    clean = "".join(f"{k}: {_BREAKS.sub(' ', v).strip()}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{clean}\r\n".encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """One gzip member, the same for equal data."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record, plain or a gzip member."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    return fields, block


class Package:
    """Writes a ZIP of stored members to a stream, front to back; ZIP64 fields wherever a number needs them (or always)."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, big, at, raw = zlib.crc32(data), self.zip64 or len(data) >= 0xFFFFFFFF, self.at, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = 0xFFFFFFFF if big else len(data)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            wide = [x for x in (size, size, at) if self.zip64 or x >= 0xFFFFFFFF] if not self.zip64 else [size, size, at]
            s, o = (0xFFFFFFFF if self.zip64 or size >= 0xFFFFFFFF else size), (0xFFFFFFFF if self.zip64 or at >= 0xFFFFFFFF else at)
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= 0xFFFF or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, start, 0))


def directory(f, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, offset of the data, stored size, crc) of each member, from the central directory alone and the local
    headers' lengths. f has seek and read; comments after the end record are allowed."""

    def at(pos, n):
        f.seek(pos)
        return f.read(n)

    back = min(size, 22 + 0xFFFF)
    tail = at(size - back, back)
    k = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))  # the record has 22 bytes at least
    while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
        k = tail.rfind(b"PK\5\6", 0, k)
    if k < 0:
        raise ValueError("not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if n == 0xFFFF or 0xFFFFFFFF in (length, start):
        sig, _, where, _ = struct.unpack("<4sIQI", at(size - back + k - 20, 20))
        if sig == b"PK\6\7":
            n, length, start = struct.unpack_from("<QQQ", at(where, 56), 32)
    raw, out, pos = at(start, length), [], 0
    for _ in range(n):
        sig, _, _, _, method, _, _, crc, stored, full, ln, le, lc, _, _, _, local = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, pos)
        if sig != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        name, extra, p = raw[pos + 46 : pos + 46 + ln].decode(), raw[pos + 46 + ln : pos + 46 + ln + le], 0
        while p + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, p)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, p + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            p += 4 + m
        a, b = struct.unpack_from("<HH", at(local, 30), 26)
        out.append((name, method, local + 30 + a + b, stored, crc))
        pos += 46 + ln + le + lc
    return out


def open_uri(uri: str):
    uri = re.sub("^s3[an]://", "s3://", uri)  # Spark's names of that store
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))
    return fs, path


def write_packages(pages: DataFrame, folder: str, member: int = MEMBER, zip64: bool = False) -> DataFrame:
    """Write (page_id, url, payload, record_type, refers_to) rows, a package for each partition with rows; (path, n_records).

    A package is written under a name of its own and renamed when whole, so a task that is lost or run twice leaves
    no half a package under a name that anything returns. The result is checkpointed: it is written once."""

    def run(batches):
        fs, base = open_uri(folder)
        name, n, held, index, out, package = f"{uuid.uuid4().hex}.zip", 0, [], [], None, None

        def flush():
            package.add(f"archive/data-{flush.k:05}.warc.gz", b"".join(held))
            package.add(f"indexes/data-{flush.k:05}.cdxj", "".join(json.dumps(x) + "\n" for x in index).encode())
            flush.k, flush.size = flush.k + 1, 0
            held.clear()
            index.clear()

        flush.k = flush.size = 0
        for b in batches:
            for row in range(b.num_rows):
                page_id, url, payload, kind, refers = (b.column(c)[row].as_py() for c in ("page_id", "url", "payload", "record_type", "refers_to"))
                if package is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/.{name}")
                    package = Package(out, zip64)
                r = gzipped(record(kind, url, payload, {k: str(v) for k, v in (("WARC-Page-ID", page_id), ("WARC-Refers-To-Page", refers)) if v is not None}))
                index.append({"offset": flush.size, "length": len(r), "page": page_id})
                held.append(r)
                flush.size += len(r)
                n += 1
                if flush.size >= member:
                    flush()
        if package is not None:
            if held:
                flush()
            package.close()
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "n_records": pa.array([n], pa.int64())})

    bounded_batches(pages.sparkSession)
    return cut(pages.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, n_records long"))


def _ranges(batches):
    """Batches of (path, start, length) from batches with a column path."""
    for b in batches:
        for uri in b.column("path").to_pylist():
            fs, path = open_uri(uri)
            with fs.open_input_file(path) as f:
                members = {m[0]: m for m in directory(f, f.size())}
                for name, (_, method, start, size, _) in members.items():
                    if not name.endswith(".cdxj"):
                        continue
                    base = name.replace("indexes/", "archive/").removesuffix(".cdxj")
                    data = members.get(f"{base}.warc.gz") or members[f"{base}.warc"]
                    if method or data[1]:
                        raise ValueError(f"{uri}: {name} isn't stored")
                    f.seek(start)
                    rows = [json.loads(x) for x in f.read(size).splitlines()]
                    yield pa.RecordBatch.from_pydict({"path": [uri] * len(rows), "start": pa.array([data[2] + r["offset"] for r in rows], pa.int64()), "length": pa.array([r["length"] for r in rows], pa.int64())})


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
RECORD_SQL = "page_id long, url string, payload binary, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _records(batches, payloads: bool = True):
    """Batches of RECORD from batches of ranges; `payloads`: whether they go into the result (they are read and verified anyway)."""
    uri, f = None, None
    for b in batches:
        rows, size = [], 0
        for own, start, length in zip(*(b.column(c).to_pylist() for c in ("path", "start", "length"))):
            if own != uri:
                if f:
                    f.close()
                fs, path = open_uri(uri := own)
                f = fs.open_input_file(path)
            f.seek(start)
            head, block = parse(f.read(length))
            said = head["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = head["WARC-Type"]
            if kind != "revisit" and sha1_base32(block) != said:
                raise ValueError(f"{uri}: a payload doesn't match its digest")
            page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
            held = block if payloads and kind != "revisit" else None
            rows.append((page and int(page), head["WARC-Target-URI"], held, kind, refers and int(refers), int(head["WARC-Payload-Length"]) if kind == "revisit" else len(block), said))
            size += len(held or b"") + 200
            if size > BATCH:
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], RECORD)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], RECORD)
    if f:
        f.close()


def locate(packages: DataFrame) -> DataFrame:
    """(path, start, length): where each record of the packages (column path) lies in its file, from the stored indexes."""
    return packages.select("path").mapInArrow(_ranges, "path string, start long, length long")


def read_records(ranges: DataFrame) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to, payload_bytes, payload_digest) of records by range. The payload of
    a revisit is null; its length and digest are those that its header states. Stored digests are verified."""
    return ranges.select("path", "start", "length").mapInArrow(_records, RECORD_SQL)


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """read_records over locate in one pass, so that a task has one Python process; without `payloads`, payload is null."""
    return packages.select("path").mapInArrow(lambda bs: _records(_ranges(bs), payloads), RECORD_SQL)


def warc_round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write a record for each page and read the packages back; the columns of read_records (payload null without `payloads`).

    Among equal payloads of `least` bytes or more, the smallest page_id is the response and the others revisit it;
    rows that repeat that page_id are responses too, a row with a null page_id revisits it, and where every page_id
    is null all are responses. Null html is an empty payload, a null url an empty one. Payloads are held equal by
    SHA-256 and length. Other columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("d", F.sha2("payload", 256))
    firsts = cut(rows.select("page_id", "d").groupBy("d").agg(F.min("page_id").alias("first")))  # a table of its own: the join may then split a payload that many pages have
    joined = rows.join(firsts, "d")
    revisit = (F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    return read_packages(write_packages(marked, folder or fresh_dir(pages.sparkSession, "warc")), payloads)
