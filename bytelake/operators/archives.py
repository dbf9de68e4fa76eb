"""Archives as rows (path, content): their formats, members, deflate blocks and decoded bytes. One pass over each row."""

from __future__ import annotations

import bz2
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.functions import deflate, formats

MEMBERS = pa.schema([
    ("path", pa.string()), ("member_no", pa.int32()), ("header_bits", pa.int64()), ("data_bits", pa.int64()), ("end_bits", pa.int64()), ("decoded_offset", pa.int64()), ("decoded_size", pa.int64()),
    ("mtime", pa.int64()), ("os", pa.int16()), ("xfl", pa.int16()), ("file_name", pa.string()), ("comment", pa.string()), ("extra", pa.binary()), ("hcrc", pa.int32()),
    ("crc32", pa.int64()), ("isize", pa.int64()), ("adler32", pa.int64()), ("metadata", pa.map_(pa.string(), pa.int64())), ("valid", pa.bool_()),
])
BLOCKS = pa.schema([
    ("path", pa.string()), ("block_no", pa.int32()), ("member_no", pa.int32()), ("encoded_bits", pa.int64()), ("header_end_bits", pa.int64()), ("encoded_size_bits", pa.int64()), ("decoded_offset", pa.int64()), ("decoded_size", pa.int64()),
    ("btype", pa.string()), ("is_final", pa.bool_()), ("literals", pa.int64()), ("references", pa.int64()), ("copied", pa.int64()), ("farthest", pa.int64()), ("window_symbols", pa.int64()),
    ("precode", pa.list_(pa.int16())), ("literal_lengths", pa.list_(pa.int16())), ("distance_lengths", pa.list_(pa.int16())), ("matches", pa.list_(pa.struct([("place", pa.int64()), ("length", pa.int32()), ("distance", pa.int32())]))),
])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.int16(): "short", pa.binary(): "binary", pa.bool_(): "boolean"}


def sql_schema(schema: pa.Schema) -> str:
    nested = {"metadata": "map<string,long>", "precode": "array<short>", "literal_lengths": "array<short>", "distance_lengths": "array<short>", "matches": "array<struct<place:long,length:int,distance:int>>"}
    return ", ".join(f"{f.name} {nested.get(f.name) or _SQL[f.type]}" for f in schema)


def _flat(archives: DataFrame, rows, schema: pa.Schema, size: int = 4096) -> DataFrame:
    """rows(path, content) -> tuples, as a DataFrame; a null content gives none."""

    def run(batches):
        for b in batches:
            held = []
            for path, content in zip(b.column("path"), b.column("content")):
                for row in rows(path.as_py(), content.as_py()) if content.is_valid else ():
                    held.append(row)
                    if len(held) >= size:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
                        held = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    return archives.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, sql_schema(schema))


TYPES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("file_type", pa.string()), ("first_block_bits", pa.int64())])


def file_types(archives: DataFrame) -> DataFrame:
    """(path, length, file_type, first_block_bits): format by content, not name; NONE with a null bit where none is known."""
    small = archives.select("path", F.octet_length("content").cast("long").alias("length"), F.substring("content", 1, 1 << 16).alias("head"), F.substring("content", -28, 28).alias("tail"))

    def run(batches):
        for b in batches:
            found = [(formats.detect(h, t) if h is not None else None) or ("NONE", None) for h, t in zip(b.column("head").to_pylist(), b.column("tail").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], TYPES.names)

    return small.mapInArrow(run, sql_schema(TYPES))


def _members(path: str, data: bytes, strict: bool = True):
    found = formats.detect(data[: 1 << 16], data[-28:])
    if found is None:
        return
    kind, at, no, offset = found[0], 0, 0, 0
    if kind == "BZIP2":
        out = decode_bytes(data)
        yield (path, 0, 0, 32, 8 * len(data), 0, len(out), *[None] * 11, True)
        return
    while True:
        head = formats.gzip_header(data, at) if kind in ("GZIP", "BGZF") else formats.zlib_header(data, at) if kind == "ZLIB" else None
        if head is None and (no or kind != "DEFLATE"):
            return
        start = head.end if head else 0
        size, crc, adler, foot = 0, 0, 1, None
        try:
            for got in deflate.stream(data, 8 * start, len(data)):
                if isinstance(got, bytes):
                    size, crc, adler = size + len(got), zlib.crc32(got, crc), zlib.adler32(got, adler)
                else:
                    foot = got
        except zlib.error as e:
            raise deflate.Corrupt(f"{path}: {e}") from None
        if foot is None:
            raise deflate.Corrupt(f"{path}: member {no} is cut short")
        said = said_size = said_adler = None
        if kind in ("GZIP", "BGZF"):
            if (footer := formats.gzip_footer(data, foot)) is None:
                raise deflate.Corrupt(f"{path}: no footer")
            (said, said_size), end = footer, foot + 8
            valid = said == crc and said_size == size & 0xFFFFFFFF
        elif kind == "ZLIB":
            said_adler, end = int.from_bytes(data[foot : foot + 4], "big"), foot + 4
            valid = said_adler == adler
        else:
            end, valid = foot, True
        if strict and not valid:
            raise deflate.Corrupt(f"{path}: member {no} has another checksum or size than its footer states")
        h = head if isinstance(head, formats.GzipHeader) else None
        yield (path, no, 8 * at, 8 * start, 8 * end, offset, size, *((h.mtime, h.os, h.xfl, h.name, h.comment, h.extra, h.hcrc) if h else [None] * 7), said, said_size, said_adler, list(formats.extra_fields(h.extra).items()) if h else None, valid)
        at, no, offset = end, no + 1, offset + size
        if kind not in ("GZIP", "BGZF") or at >= len(data):
            return


def members(archives: DataFrame, strict: bool = True) -> DataFrame:
    """One row per stream of each archive, with headers, footers and whether checksums hold (`strict`: an error where not)."""
    return _flat(archives, lambda p, c: _members(p, c, strict), MEMBERS)


def _blocks(path: str, data: bytes):
    no = 0
    for m in _members(path, data, strict=False):
        kind = formats.detect(data[: 1 << 16])
        if kind[0] == "BZIP2":
            raise deflate.Corrupt(f"{path}: bzip2 has no deflate blocks")
        for b in deflate.walk(data, m[3]):
            farthest, used = 0, set()
            each = iter(b.flat if b.decoded else ())  # a stream's first block has nothing before it
            for at, n, d in zip(each, each, each):
                if d > at:
                    farthest = max(farthest, d - at)
                    used.update(range(d - at, max(d - at - n, 0), -1))
            yield (path, no, m[1], b.start, b.header_end, b.end - b.start, m[5] + b.decoded, b.size, b.kind, b.final, b.literals, len(b.flat) // 3, b.size - b.literals, farthest, len(used),
                   b.precode, b.literal_lengths if b.kind == "DYNAMIC" else [], b.distance_lengths if b.kind == "DYNAMIC" else [], b.flat)
            no += 1


BATCH_ROWS, BATCH_MATCHES = 256, 1 << 16  #: blocks and matches that a batch of block rows holds, about


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(BLOCKS)
    flat = np.fromiter(chain.from_iterable(columns[-1]), np.int64).reshape(-1, 3)
    names, kinds = zip(*((f.name, f.type) for f in BLOCKS.field("matches").type.value_type))
    matches = pa.StructArray.from_arrays([pa.array(flat[:, k]).cast(t) for k, t in enumerate(kinds)], names)
    offsets = pa.array(np.cumsum([0, *map(len, columns[-1])]) // 3, pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:-1], BLOCKS)), pa.ListArray.from_arrays(offsets, matches)], schema=BLOCKS)


def blocks(archives: DataFrame) -> DataFrame:
    """One row per deflate block, symbols counted. A walk in Python: for analysis, not for decoding."""

    def run(batches):
        for b in batches:
            held, n = [], 0
            for path, content in zip(b.column("path"), b.column("content")):
                for row in _blocks(path.as_py(), content.as_py()) if content.is_valid else ():
                    held.append(row)
                    n += len(row[-1]) // 3
                    if len(held) >= BATCH_ROWS or n >= BATCH_MATCHES:
                        yield _block_batch(held)
                        held, n = [], 0
            yield _block_batch(held)

    return archives.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, sql_schema(BLOCKS))


def stopping_points(archives: DataFrame) -> DataFrame:
    """(path, bits, decoded_offset, point): where headers, blocks and streams of each archive end, in the order that a reader meets them."""
    m = members(archives, strict=False)
    b = blocks(archives)
    row = lambda df, bits, at, name: df.select("path", F.col(bits).alias("bits") if isinstance(bits, str) else bits.alias("bits"), at.alias("decoded_offset"), F.lit(name).alias("point"))
    end = F.col("decoded_offset") + F.col("decoded_size")
    return (
        row(m, "data_bits", F.col("decoded_offset"), "END_OF_STREAM_HEADER")
        .unionByName(row(m, "end_bits", end, "END_OF_STREAM"))
        .unionByName(row(b, "header_end_bits", F.col("decoded_offset"), "END_OF_BLOCK_HEADER"))
        .unionByName(row(b, F.col("encoded_bits") + F.col("encoded_size_bits"), end, "END_OF_BLOCK"))
    )


def decode_bytes(data: bytes) -> bytes:
    """All decoded bytes of an archive of any format."""
    found = formats.detect(data[: 1 << 16], data[-28:])
    if found is None:
        raise deflate.Corrupt("not a known format")
    if found[0] == "BZIP2":
        out = []
        while formats.bzip2_level(data):  # what follows the last stream and is none is left out
            d = bz2.BZ2Decompressor()
            out.append(d.decompress(data))
            if not d.eof:
                raise deflate.Corrupt("the archive ends within a stream")
            data = d.unused_data
        return b"".join(out)
    if found[0] in ("ZLIB", "DEFLATE"):
        return zlib.decompress(data, 15 if found[0] == "ZLIB" else -15)
    out, at = [], 0
    while head := formats.gzip_header(data, at):
        *parts, foot = deflate.stream(data, 8 * head.end, len(data))
        got = b"".join(parts)
        if foot is None or formats.gzip_footer(data, foot) != (zlib.crc32(got), len(got) & 0xFFFFFFFF):
            raise deflate.Corrupt("a member is cut short or has another checksum than its footer states")
        out.append(got)
        at = foot + 8
    return b"".join(out)


DECODED = pa.schema([("path", pa.string()), ("data", pa.binary())])


def decoded(archives: DataFrame) -> DataFrame:
    """(path, data): small archives decoded whole, a row each."""
    return _flat(archives, lambda p, c: [(p, decode_bytes(c))], DECODED, 16)


COUNTS = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_newlines", pa.int64())])


def counts(archives: DataFrame) -> DataFrame:
    """(path, n_bytes, n_newlines) of the decoded content, which isn't kept."""

    def rows(path, content):
        d = decode_bytes(content)
        yield path, len(d), d.count(b"\n")

    return _flat(archives, rows, COUNTS)


def encoded(texts: DataFrame, codec: str = "gzip") -> DataFrame:
    """(path, content) from (path, data): archives of one codec: gzip, bgzf, zlib, deflate, bzip2, stored or none."""
    make = {
        "gzip": lambda d, p: formats.gzip_member(d, 6, p),
        "bgzf": lambda d, p: formats.bgzf(d),
        "zlib": lambda d, p: zlib.compress(d, 6),
        "deflate": lambda d, p: zlib.compress(d, 6, -15),
        "bzip2": lambda d, p: bz2.compress(d, 1),
        "stored": lambda d, p: formats.gzip_member(d, 0, p),
        "none": lambda d, p: d,
    }[codec]
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    return _flat(texts.select("path", F.col("data").cast("binary").alias("content")), lambda p, d: [(p, make(d, p))], schema, 64)
