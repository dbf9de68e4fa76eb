"""A file-like view of an archive, decoded by Spark: positions are answered from an index, bytes from the chunks that hold them."""

from __future__ import annotations

import io
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.functions import formats
from bytelake.functions.ranges import SCHEMA, parse_ranges
from bytelake.operators import archives, parallel, selection
from bytelake.sources import files, index_files


GROUP = 256 << 20  #: decoded bytes that are read at once


class Archive(io.RawIOBase):
    """Reads decoded bytes at any position. The index is built by the first call that needs it, or imported."""

    def __init__(self, source, spark: SparkSession | None = None, chunk_size: int = parallel.SPACING, verify: bool = True, sparse: bool = True):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.sparse, self.verify, self._at, self._index, self._crcs, self._blocks = sparse, verify, 0, None, {}, None
        found = files.resolve_source(source)
        if isinstance(found, bytes):  # an object can't be shipped to tasks, a file can
            path = f"{files.shared_dir(self.spark, 'input')}/input"
            files.write_file(path, found)
        else:
            path = found if "://" in found else f"file://{os.path.abspath(found)}"
        self.path, self.length = path, index_files.len_of(path)
        self.chunk_size = max(32 << 10, chunk_size)

    # What is known of the archive.

    def file_type(self) -> str:
        found = formats.detect(files.read_range(self.path, 0, 2 * formats.MOST), files.read_range(self.path, self.length - 28, self.length))
        return found[0] if found else "NONE"

    def _files(self) -> DataFrame:
        return self.spark.createDataFrame([(self.path, self.length)], "path string, length long")

    def index(self) -> DataFrame:
        if self._index is None:
            if self.file_type() == "BZIP2":
                self._index = files.cut(parallel.decode_bzip2(self._files(), self.chunk_size, data=False))
            else:
                self._index = parallel.build_index(self._files(), parallel.chunk_size(self.length, self.spark.sparkContext.defaultParallelism, self.chunk_size), thin=self.sparse)
                if self.verify and not self.test():
                    raise archives.deflate.Corrupt(f"{self.path}: a checksum or size differs from its footer")
        return self._index

    def test(self) -> bool:
        """Whether all checksums and sizes hold; raw deflate is compared with the checksums that were set."""
        index = self.index()
        if "pieces" not in index.columns:
            return True  # bz2 has checked its blocks
        if self._crcs and self.file_type() in ("DEFLATE", "ZLIB"):
            given = self.spark.createDataFrame([(self.path, c) for c in self._crcs.values()], "path string, crc32 long")
            return parallel.verified_against(index, given).where("not valid").limit(1).count() == 0
        return parallel.verified(index, strict=False).where("not valid").limit(1).count() == 0

    def set_deflate_stream_crc32s(self, crcs: dict[int, int]) -> None:
        """Checksums of raw deflate streams by the byte where each ends."""
        self._crcs = dict(crcs)

    def add_deflate_stream_crc32(self, end: int, crc: int) -> None:
        self._crcs[end] = crc

    def size(self) -> int:
        return self.index().agg(F.max(F.col("decoded_offset") + F.col("decoded_size"))).first()[0] or 0

    def count_lines(self) -> int:
        return self.index().agg(F.sum("n_newlines")).first()[0] or 0

    def tell_compressed(self) -> int:
        """The bit of the archive where the chunk of the current position begins; its end after the last byte."""
        row = self.index().where((F.col("decoded_offset") <= self._at) & (F.col("decoded_offset") + F.col("decoded_size") > self._at)).agg(F.max("start_bits")).first()
        return 8 * self.length if row[0] is None else row[0]

    def block_offsets(self) -> dict[int, int]:
        """{compressed bit: decoded byte} of all chunks and of the end; one entry a chunk."""
        out = {r[0]: r[1] for r in self.index().select("start_bits", "decoded_offset").orderBy("start_bits").toLocalIterator()}
        return out | {8 * self.length: self.size()}

    def available_block_offsets(self) -> dict[int, int]:
        return self.block_offsets() if self.block_offsets_complete() else {}

    def block_offsets_complete(self) -> bool:
        return self._index is not None

    def set_block_offsets(self, offsets: dict[int, int]) -> None:
        """Use known offsets of bzip2 blocks."""
        if len(offsets) < 2:
            raise ValueError("a block and the end are needed at least")
        rows = sorted(offsets.items())
        self._index = self.spark.createDataFrame([(self.path, k, b, nb, d, nd - d, None, None) for k, ((b, d), (nb, nd)) in enumerate(zip(rows, rows[1:]))], "path string, block_no long, start_bits long, stop_bits long, decoded_offset long, decoded_size long, n_newlines long, line_offset long")

    def import_index(self, index_path: str) -> None:
        index_path = index_path if "://" in index_path else f"file://{os.path.abspath(index_path)}"
        pairs = self.spark.createDataFrame([(self.path, index_path)], "path string, index_path string")
        index = files.cut(index_files.import_indexes(pairs))
        self._index = files.cut(index_files.with_lines(index)) if index.where("line_offset is null or n_newlines is null").limit(1).count() else index

    def export_index(self, target: str, kind: str = "indexed_gzip") -> None:
        folder = files.shared_dir(self.spark, "export")
        at = index_files.export_indexes(self.index(), kind, folder).first()["index_path"]
        files.write_file(target if "://" in target else f"file://{os.path.abspath(target)}", files.read_range(at, 0, 1 << 62))

    # Reading.

    def read_ranges(self, expression: str):
        """The bytes of a range expression, in its order, a part at a time. Ranges are read in groups of some GROUP bytes, one
        after the other, so only a group's bytes are ever put in order."""
        parsed = parse_ranges(expression)
        if self.file_type() == "BZIP2":
            for low, high in self._bzip2_spans(parsed):
                yield from self._bzip2_bytes(self.index(), low, high)
            return
        ranges = self.spark.createDataFrame([(self.path, i, *r) for i, r in enumerate(parsed)], f"path string, {SCHEMA}")
        held, size = [], 0
        for r in selection.in_bytes(self.index(), ranges).orderBy("ordinal").collect():  # one for each range that was asked for
            for at in range(r["offset"], r["offset"] + r["size"], GROUP):
                n = min(GROUP, r["offset"] + r["size"] - at)
                held.append((self.path, len(held), at, n, False, False))
                size += n
                if size >= GROUP:
                    yield from self._group(held)
                    held, size = [], 0
        if held:
            yield from self._group(held)

    def _group(self, ranges: list):
        rows = self.spark.createDataFrame(ranges, f"path string, {SCHEMA}")
        for row in selection.read_ranges(self.index(), rows).orderBy("ordinal", "at").toLocalIterator():
            yield bytes(row["data"])

    def _bzip2_spans(self, ranges):
        """(first byte, byte after the last) of each range that the archive has."""
        total = self.size()
        for r in ranges:
            start = self._bzip2_line(r.offset) if r.offset_is_line else r.offset
            if start is None or start >= total:
                continue
            if r.size_is_line:
                first = r.offset if r.offset_is_line else self._bzip2_lines_before(start)
                stop = self._bzip2_line(first + r.size)
            else:
                stop = start + min(r.size, total)
            yield start, total if stop is None else min(stop, total)

    def _bzip2_counted(self) -> DataFrame:
        """The index with newlines; where offsets were given without them, they are counted by one scan."""
        if self.index().where("n_newlines is null").limit(1).count():
            rows = self.index().select("path", "block_no", "start_bits", "stop_bits", (F.col("decoded_size") == 0).alias("is_end"), F.array().cast("array<long>").alias("before"), F.array("stop_bits").alias("after"))
            lines = parallel.scan_bzip2(rows.repartition(max(1, rows.count()), "block_no"), data=False).select("block_no", "n_newlines")
            counted = self.index().drop("n_newlines", "line_offset").join(lines, "block_no")
            self._index = files.cut(counted.withColumn("line_offset", parallel.before("n_newlines", ["path"], ["block_no"])))
        return self._index

    def _bzip2_line(self, n: int) -> int | None:
        """The byte after the n-th newline; None if there are fewer."""
        if not n:
            return 0
        row = self._bzip2_counted().where((F.col("line_offset") < n) & (F.col("line_offset") + F.col("n_newlines") >= n)).first()
        if row is None:
            return None
        return row["decoded_offset"] + selection.nth_newline(self._bzip2_block(row), n - row["line_offset"]) + 1

    def _bzip2_lines_before(self, at: int) -> int:
        row = self._bzip2_counted().where((F.col("decoded_offset") <= at) & (F.col("decoded_offset") + F.col("decoded_size") > at)).first()
        return row["line_offset"] + self._bzip2_block(row)[: at - row["decoded_offset"]].count(b"\n")

    def _bzip2_block(self, row) -> bytes:
        base = row["start_bits"] >> 3
        return parallel.bzip2_block(files.read_range(self.path, base, -(-row["stop_bits"] // 8)), row["start_bits"] - 8 * base, row["stop_bits"] - 8 * base)

    def _bzip2_bytes(self, index: DataFrame, low: int, high: int):
        met = index.where((F.col("decoded_offset") < high) & (F.col("decoded_offset") + F.col("decoded_size") > low)).orderBy("decoded_offset")
        for r in met.select("start_bits", "stop_bits", "decoded_offset").toLocalIterator():
            yield self._bzip2_block(r)[max(0, low - r["decoded_offset"]) : high - r["decoded_offset"]]

    def read(self, n: int = -1) -> bytes:
        n = (1 << 62) if n is None or n < 0 else n
        out = b"".join(self.read_ranges(f"{n}@{self._at}")) if n else b""
        self._at += len(out)
        return out

    def readinto(self, buffer) -> int:
        got = self.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def peek(self, n: int = 1) -> bytes:
        at = self._at
        out = self.read(n)
        self._at = at
        return out

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        """The new position: never before the start, nor after the end."""
        size = self.size()
        self._at = min(size, max(0, offset + (0 if whence == io.SEEK_SET else self._at if whence == io.SEEK_CUR else size)))
        return self._at

    def tell(self) -> int:
        return self._at

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def join_threads(self) -> None:
        """Nothing runs between calls."""

    def chunks(self) -> DataFrame:
        """All decoded chunks as a table."""
        if self.file_type() == "BZIP2":
            return parallel.decode_bzip2(self._files(), self.chunk_size)
        return parallel.indexed_scan(self.index())


def open(source, spark: SparkSession | None = None, **options) -> Archive:
    return Archive(source, spark, **options)


def determine_file_type(source) -> str:
    found = files.resolve_source(source)
    length = len(found) if isinstance(found, bytes) else index_files.len_of(found)
    part = (lambda a, b: found[a:b]) if isinstance(found, bytes) else (lambda a, b: files.read_range(found, a, b))
    kind = formats.detect(part(0, 2 * formats.MOST), part(max(0, length - 28), length))
    return kind[0] if kind else "NONE"


def temporary(data: bytes) -> str:
    """A local file with these bytes, for tests and small tools."""
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(data)
    return f.name
