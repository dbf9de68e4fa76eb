"""Index files of other tools, read and written: indexed_gzip, gztool (with or without lines) and bgzip's .gzi.

The formats are fixed; what follows them are plain records. In memory an index is an `Index`; as a table it has a row for
each checkpoint, as operators.parallel.build_index gives it.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from bytelake.functions import formats
from bytelake.sources.files import read_range, write_file

WINDOW = 32 << 10

# Magic bytes of the formats.
INDEXED_GZIP, GZTOOL = b"GZIDX", bytes(8) + b"gzipind"


@dataclass
class Checkpoint:
    bits: int  #: where a block begins in the archive
    offset: int  #: decoded bytes before it
    window: bytes = b""
    line: int | None = None  #: newlines before it


@dataclass
class Index:
    compressed_size: int
    uncompressed_size: int
    checkpoints: list[Checkpoint] = field(default_factory=list)
    spacing: int = 0
    has_lines: bool = False
    newline: str = "\n"


def _split_bits(bits: int) -> tuple[int, int]:
    """(byte after the bits, bits that belong before it)"""
    return -(-bits // 8), -bits % 8


def _join_bits(at: int, before: int, size: int) -> int:
    if before >= 8 or at > size or before and not at:
        raise ValueError("a checkpoint lies outside of the archive")
    return 8 * at - before


def _at_end(index: Index, c: Checkpoint) -> bool:
    return c.bits == 8 * index.compressed_size


def write_indexed_gzip(index: Index) -> bytes:
    steps = [b.offset - a.offset for a, b in zip(index.checkpoints, index.checkpoints[1:])]
    spacing = index.spacing if index.spacing >= WINDOW else max(WINDOW, min(steps, default=0))
    out = [INDEXED_GZIP, struct.pack("<BBQQIII", 1, 0, index.compressed_size, index.uncompressed_size, spacing, WINDOW, len(index.checkpoints))]
    for c in index.checkpoints:
        at, before = _split_bits(c.bits)
        out.append(struct.pack("<QQBB", at, c.offset, before, bool(c.window) and not _at_end(index, c)))
    out += [c.window[-WINDOW:].rjust(WINDOW, b"\0") for c in index.checkpoints if c.window and not _at_end(index, c)]
    return b"".join(out)


def read_indexed_gzip(data: bytes, archive_size: int | None = None) -> Index:
    if data[:5] != INDEXED_GZIP:
        raise ValueError("not an indexed_gzip index")
    version, _, compressed, uncompressed, spacing, window, n = struct.unpack_from("<BBQQIII", data, 5)
    if version > 1 or window != WINDOW:
        raise ValueError("another version or size of windows than is read")
    if archive_size is not None and archive_size != compressed:
        raise ValueError("the index is of an archive of another size")
    index, at, has = Index(compressed, uncompressed, spacing=spacing), 35, []
    for i in range(n):
        byte, offset, before = struct.unpack_from("<QQB", data, at)
        has.append(data[at + 17] if version else i > 0)
        at += 17 + version
        if offset > uncompressed:
            raise ValueError("a checkpoint lies outside of the output")
        index.checkpoints.append(Checkpoint(_join_bits(byte, before, compressed), offset))
    for c, some in zip(index.checkpoints, has):
        if some:
            if len(data) < at + WINDOW:
                raise ValueError("a window is cut short")
            c.window, at = data[at : at + WINDOW], at + WINDOW
    return index


def write_gztool(index: Index, lines: bool | None = None) -> bytes:
    lines = index.has_lines if lines is None else lines
    if lines and not index.has_lines:
        raise ValueError("the index has no lines")
    kept = list(index.checkpoints)
    while kept and kept[-1].offset == index.uncompressed_size and len(kept) > 1:
        kept.pop()
    out = [GZTOOL, b"X" if lines else b"x", struct.pack(">I", index.newline == "\r") if lines else b"", struct.pack(">QQ", len(kept), len(kept))]
    for c in kept:
        at, before = _split_bits(c.bits)
        window = zlib.compress(c.window[-WINDOW:].rjust(WINDOW, b"\0")) if c.window else b""
        out += [struct.pack(">QQII", c.offset, at, before, len(window)), window]
        if lines:
            out.append(struct.pack(">Q", c.line + 1))
    out.append(struct.pack(">Q", index.uncompressed_size))
    if lines:
        out.append(struct.pack(">Q", index.checkpoints[-1].line if index.checkpoints else 0))
    return b"".join(out)


def read_gztool(data: bytes, archive_size: int) -> Index:
    if data[:15] != GZTOOL or data[15:16] not in (b"x", b"X"):
        raise ValueError("not a gztool index")
    index, f = Index(archive_size, 0, has_lines=data[15:16] == b"X"), io.BytesIO(data[16:])

    def take(form: str):
        raw = f.read(struct.calcsize(form))
        if len(raw) < struct.calcsize(form):
            raise ValueError("the index is cut short")
        return struct.unpack(form, raw)

    if index.has_lines:
        (kind,) = take(">I")
        if kind > 1:
            raise ValueError("an unknown kind of newline")
        index.newline = "\r" if kind else "\n"
    n, expected = take(">QQ")
    if n != expected:
        raise ValueError("the index isn't complete")
    for _ in range(n):
        offset, at, before, size = take(">QQII")
        c = Checkpoint(_join_bits(at, before, archive_size), offset, zlib.decompress(f.read(size)) if size else b"")
        if index.has_lines:
            (line,) = take(">Q")
            if not line:
                raise ValueError("lines count from 1")
            c.line = line - 1
        index.checkpoints.append(c)
    (index.uncompressed_size,) = take(">Q")
    if index.has_lines:
        (last,) = take(">Q")
        if not index.checkpoints or not _at_end(index, index.checkpoints[-1]):
            index.checkpoints.append(Checkpoint(8 * archive_size, index.uncompressed_size))
        elif index.checkpoints[-1].offset != index.uncompressed_size:
            raise ValueError("the last checkpoint isn't the end")
        index.checkpoints[-1].line = last
    return index


def write_bgzi(index: Index) -> bytes:
    """Blocks of a BGZF archive after its first, the empty one at its end included; each begins 18 bytes before its deflate data."""
    rows = [(c.bits // 8 - 18, c.offset) for c in index.checkpoints[1:] if not _at_end(index, c)]
    end = (index.compressed_size - len(formats.BGZF_END), index.uncompressed_size)
    rows += [end] if not rows or rows[-1] != end else []
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<QQ", *r) for r in rows)


def read_bgzi(data: bytes, archive: str | bytes) -> Index:
    """The archive tells where the first block begins and how much its last one holds. The last of n entries is the empty block at
    the archive's end, which is no checkpoint."""
    head = archive[:64] if isinstance(archive, bytes) else read_range(archive, 0, 64)
    size = len(archive) if isinstance(archive, bytes) else len_of(archive)
    if not formats.is_bgzf_header(head):
        raise ValueError("a bgzip index of an archive that isn't BGZF")
    (n,) = struct.unpack_from("<Q", data)
    n = 0 if n == (1 << 64) - 1 else n
    if len(data) != 8 * (2 * n + 1):
        raise ValueError("not a bgzip index")
    index = Index(size, 0, [Checkpoint(18 * 8, 0)])
    for i in range(1, n):
        at, offset = struct.unpack_from("<QQ", data, 8 + 16 * (i - 1))
        c, last = Checkpoint(8 * (at + 18), offset), index.checkpoints[-1]
        if not last.bits < c.bits <= 8 * size or c.offset < last.offset:
            raise ValueError("checkpoints aren't in order")
        index.checkpoints.append(c)
    from bytelake.operators.archives import decode_bytes

    last = index.checkpoints[-1]
    tail = archive[last.bits // 8 - 18 :] if isinstance(archive, bytes) else read_range(archive, last.bits // 8 - 18, size)
    index.uncompressed_size = last.offset + len(decode_bytes(tail))
    return index


def len_of(uri: str) -> int:
    from bytelake.sources.files import opened

    with opened(uri) as f:
        return f.size()


def read_index(data: bytes, archive: str | bytes | None = None) -> Index:
    """An index of any of the formats; gztool's and bgzip's need the archive (or its bytes)."""
    size = None if archive is None else len(archive) if isinstance(archive, bytes) else len_of(archive)
    if data[:5] == INDEXED_GZIP:
        return read_indexed_gzip(data, size)
    if size is None:
        raise ValueError("this format needs the archive")
    return read_gztool(data, size) if data[:15] == GZTOOL else read_bgzi(data, archive)


WRITERS = {"indexed_gzip": write_indexed_gzip, "gztool": lambda i: write_gztool(i, False), "gztool-with-lines": lambda i: write_gztool(i, True), "bgzi": write_bgzi}


# As tables.


def export_indexes(index: DataFrame, kind: str, folder: str) -> DataFrame:
    """(path, index_path, n): write each archive's index (see build_index) as a file; a task has one archive's checkpoints at a time."""
    rows = index.select("path", "length", "start_bits", "is_last", "window", "decoded_offset", "decoded_size", "line_offset", "n_newlines").repartition("path").sortWithinPartitions("path", "start_bits")
    schema = pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n", pa.int64())])

    def run(batches):
        own: Index | None = None
        for b in batches:
            for r in b.to_pylist():
                if own is None:
                    own = Index(r["length"], 0, has_lines=True)
                own.checkpoints.append(Checkpoint(r["start_bits"], r["decoded_offset"], r["window"], r["line_offset"]))
                if r["is_last"]:
                    own.uncompressed_size = r["decoded_offset"] + r["decoded_size"]
                    own.checkpoints.append(Checkpoint(8 * own.compressed_size, own.uncompressed_size, b"", r["line_offset"] + r["n_newlines"]))
                    at = f"{folder.rstrip('/')}/{r['path'].rpartition('/')[2]}.{kind}"
                    write_file(at, WRITERS[kind](own))
                    yield pa.RecordBatch.from_pylist([{"path": r["path"], "index_path": at, "n": len(own.checkpoints)}], schema)
                    own = None

    return rows.mapInArrow(run, "path string, index_path string, n long")


def without_footers(path: str) -> bool:
    """Whether an archive is zlib or raw deflate, whose chunks end without a gzip footer."""
    length = len_of(path)
    kind = formats.detect(read_range(path, 0, 2 * formats.MOST), read_range(path, length - 28, length))
    return kind is not None and kind[0] in ("ZLIB", "DEFLATE")


def ascending(checkpoints: list[Checkpoint]) -> list[Checkpoint]:
    """The checkpoints as they are; an index whose offsets fall is refused."""
    if any(a.bits >= b.bits or a.offset > b.offset for a, b in zip(checkpoints, checkpoints[1:])):
        raise ValueError("the index's checkpoints aren't in order")
    return checkpoints


def import_indexes(pairs: DataFrame) -> DataFrame:
    """An index table from (path, index_path) rows. Newlines of chunks are known where the files tell lines, else null; `pieces` is null.

    An archive's last checkpoint that is its end becomes the size of the chunk before it."""
    names = ["path", "length", "chunk_no", "start_bits", "stop_bits", "is_last", "raw", "window", "decoded_offset", "decoded_size", "line_offset", "n_newlines"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                index, raw = read_index(read_range(r["index_path"], 0, 1 << 62), r["path"]), without_footers(r["path"])
                rows = ascending([c for c in index.checkpoints if not _at_end(index, c)])
                ends = [c for c in index.checkpoints if _at_end(index, c)]
                last_line = ends[-1].line if ends else None
                out = []
                for k, c in enumerate(rows):
                    after = rows[k + 1] if k + 1 < len(rows) else None
                    line = after.line if after else last_line
                    out.append(dict(zip(names, (r["path"], index.compressed_size, k, c.bits, after.bits if after else 8 * index.compressed_size, after is None, raw, c.window, c.offset, (after.offset if after else index.uncompressed_size) - c.offset, c.line, None if line is None or c.line is None else line - c.line))))
                yield pa.RecordBatch.from_pylist(out, schema)

    return pairs.select("path", "index_path").mapInArrow(run, "path string, length long, chunk_no long, start_bits long, stop_bits long, is_last boolean, raw boolean, window binary, decoded_offset long, decoded_size long, line_offset long, n_newlines long")


def with_lines(index: DataFrame) -> DataFrame:
    """An imported index with line_offset and n_newlines of every chunk, counted by one scan."""
    from bytelake.operators import parallel

    found = parallel.indexed_scan(index.drop("n_newlines").withColumn("line_offset", F.lit(0).cast("long")), data=False).select("path", "chunk_no", "n_newlines")
    return parallel.with_places(index.drop("line_offset", "n_newlines").join(found, ["path", "chunk_no"]))


def block_offsets(index: DataFrame) -> DataFrame:
    """(path, offsets): the map from compressed bits to decoded bytes of each archive, its end included."""
    ends = index.where("is_last").select("path", (F.col("length") * 8).alias("b"), (F.col("decoded_offset") + F.col("decoded_size")).alias("d"))
    rows = index.select("path", F.col("start_bits").alias("b"), F.col("decoded_offset").alias("d")).unionByName(ends)
    return rows.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("b", "d")))).alias("offsets"))


def pack(window: bytes, codec: str) -> bytes:
    if codec not in ("NONE", "ZLIB", "GZIP"):
        raise ValueError(f"windows can't be kept as {codec}")
    return window if codec == "NONE" else zlib.compress(window) if codec == "ZLIB" else formats.gzip_member(window)


def unpack(packed: bytes, codec: str) -> bytes:
    if codec not in ("NONE", "ZLIB", "GZIP"):
        raise ValueError(f"windows can't be kept as {codec}")
    return packed if codec == "NONE" else zlib.decompress(packed, 15 if codec == "ZLIB" else 31)


def packed_windows(index: DataFrame, codec: str | None = None) -> DataFrame:
    """An index table with `window` packed and `window_codec`: as chosen, else ZLIB where the chunk shrank to less than half, else NONE."""
    shrunk = F.col("decoded_size") * 8 > 2 * (F.col("stop_bits") - F.col("start_bits"))
    chosen = F.lit(codec) if codec else F.when(shrunk, "ZLIB").otherwise("NONE")
    return index.withColumn("window_codec", chosen).withColumn("window", _packed("window", "window_codec"))


def unpacked_windows(index: DataFrame) -> DataFrame:
    return index.withColumn("window", _unpacked("window", "window_codec")).drop("window_codec")


def _by_codec(f):
    return arrow_udf(lambda w, c: pa.array([None if x is None else f(x, y) for x, y in zip(w.to_pylist(), c.to_pylist())], pa.binary()), T.BinaryType())


_packed, _unpacked = _by_codec(pack), _by_codec(unpack)
