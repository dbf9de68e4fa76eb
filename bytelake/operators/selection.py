"""Byte and line ranges of archives: only chunks that hold a part of a range are decoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from bytelake.functions.ranges import ALL
from bytelake.operators import parallel
from bytelake.operators.checkpoints import as_of
from bytelake.sources.files import cut, read_range

CHUNK = ["path", "length", "chunk_no", "start_bits", "stop_bits", "is_last", "raw", "window"]


def nth_newline(data: bytes, n: int) -> int | None:
    """Where the n-th (from 1) newline stands; None if there are fewer, or n is 0."""
    at = -1
    for _ in range(n):
        at = data.find(b"\n", at + 1)
        if at < 0:
            return None
    return at if n else None


def _chunk(index: DataFrame) -> list[str]:
    """What decoding a chunk needs of an index."""
    return [c for c in CHUNK if c in index.columns]


nth_newline_at = arrow_udf(lambda data, n: pa.array([None if x is None else nth_newline(x, k) for x, k in zip(data.to_pylist(), n.to_pylist())], pa.int64()), T.LongType())


def _gzip_chunk(row: dict) -> bytes:
    return b"".join(p.data for p in parallel._pieces(row, row["window"]))


def _bzip2_chunk(row: dict) -> bytes:
    base = row["start_bits"] >> 3
    return parallel.bzip2_block(read_range(row["path"], base, -(-row["stop_bits"] // 8)), row["start_bits"] - 8 * base, row["stop_bits"] - 8 * base)


def _asked(rows: DataFrame, schema: pa.Schema, sql: str, answer, decode) -> DataFrame:
    """Decode each row's chunk and give answer(row, bytes); rows of the same chunk in turn decode it once."""

    def run(batches):
        key, data = None, b""
        for b in batches:
            for row in b.to_pylist():
                if (row["path"], row["chunk_no"]) != key:
                    key, data = (row["path"], row["chunk_no"]), decode(row)
                yield pa.RecordBatch.from_pylist([answer(row, data)], schema)

    return rows.repartition("path", "chunk_no").sortWithinPartitions("path", "chunk_no").mapInArrow(run, sql)


def _line_starts(index: DataFrame, wanted: DataFrame, decode) -> DataFrame:
    """(path, line, at) from (path, line): the byte after the line-th newline; no row where there is none."""
    found = as_of(wanted.where("line > 0").distinct(), index.select(*_chunk(index), "decoded_offset", "line_offset"), "line", "line_offset", ["path"], strict=True)
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), ("at", pa.int64())])

    def answer(row, data):
        at = nth_newline(data, row["line"] - row["line_offset"])
        return {"path": row["path"], "line": row["line"], "at": None if at is None else row["decoded_offset"] + at + 1}

    out = _asked(found.where("chunk_no is not null"), schema, "path string, line long, at long", answer, decode).where("at is not null")
    return out.unionByName(wanted.where("line = 0").distinct().select("path", "line", F.lit(0).cast("long").alias("at")))


def in_bytes(index: DataFrame, ranges: DataFrame, decode=_gzip_chunk) -> DataFrame:
    """(path, ordinal, offset, size) in bytes, clipped to the archive, from (path, ordinal, offset, size, offset_is_line, size_is_line).

    A line range starts after as many newlines; n lines end after n newlines or with the archive. Ranges that start past the end are left out."""
    ends = index.groupBy("path").agg(F.max(F.col("decoded_offset") + F.col("decoded_size")).alias("end"))
    rows = ranges.join(ends, "path")
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("line", pa.int64())])
    odd = rows.where("not offset_is_line and size_is_line and offset < end")
    placed = as_of(odd.select("path", "ordinal", "offset"), index.select(*_chunk(index), "decoded_offset", "line_offset"), "offset", "decoded_offset", ["path"])
    lines_at = _asked(placed, schema, "path string, ordinal int, line long", lambda r, d: {"path": r["path"], "ordinal": r["ordinal"], "line": r["line_offset"] + d[: r["offset"] - r["decoded_offset"]].count(b"\n")}, decode)
    rows = rows.join(cut(lines_at), ["path", "ordinal"], "left").withColumn("first", F.when(F.col("offset_is_line"), F.col("offset")).otherwise(F.col("line")))
    rows = rows.withColumn("stop", F.when(F.col("size_is_line"), F.col("first") + F.least(F.col("size"), F.lit(ALL >> 1) - F.col("first"))))
    lines = cut(_line_starts(index, rows.where("offset_is_line").select("path", F.col("first").alias("line")).unionByName(rows.where("size_is_line").select("path", F.col("stop").alias("line"))), decode))
    rows = rows.join(lines.select("path", F.col("line").alias("first"), F.col("at").alias("first_at")), ["path", "first"], "left").join(lines.select("path", F.col("line").alias("stop"), F.col("at").alias("stop_at")), ["path", "stop"], "left")
    begin = F.when(F.col("offset_is_line"), F.col("first_at")).otherwise(F.col("offset"))
    rows = rows.withColumn("begin", begin).where("begin is not null and begin <= end")
    stop = F.when(F.col("size_is_line"), F.coalesce("stop_at", "end")).otherwise(F.col("begin") + F.least("size", F.col("end") - F.col("begin")))
    return rows.withColumn("_stop", F.least(stop, F.col("end"))).select("path", "ordinal", F.col("begin").alias("offset"), (F.col("_stop") - F.col("begin")).alias("size")).where("size > 0")


def bzip2_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """read_ranges for the blocks of bzip2 archives (see decode_bzip2), whose block_no is named chunk_no."""
    return read_ranges(blocks, ranges, _bzip2_chunk)


def read_ranges(index: DataFrame, ranges: DataFrame, decode=_gzip_chunk) -> DataFrame:
    """(path, ordinal, at, data): the ranges' bytes, a row for each chunk that a range meets; in the order of ordinal and at they are
    the ranges as given, with all their repeats and overlaps."""
    wanted = cut(in_bytes(index, ranges, decode)).select("path", "ordinal", F.col("offset").alias("from"), (F.col("offset") + F.col("size")).alias("to"))
    places = index.select("path", F.col("chunk_no").alias("c"), "decoded_offset")
    first = as_of(wanted.withColumn("final", F.col("to") - 1), places, "from", "decoded_offset", ["path"]).withColumnRenamed("c", "c0").drop("decoded_offset")
    both = as_of(first, places, "final", "decoded_offset", ["path"])
    met = both.select("path", "ordinal", "from", "to", F.explode(F.sequence("c0", "c")).alias("chunk_no")).join(index.select(*_chunk(index), "decoded_offset"), ["path", "chunk_no"])
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("at", pa.int64()), ("data", pa.binary())])

    def answer(r, d):
        low = max(r["from"], r["decoded_offset"])
        return {"path": r["path"], "ordinal": r["ordinal"], "at": low, "data": d[low - r["decoded_offset"] : r["to"] - r["decoded_offset"]]}

    return _asked(met, schema, "path string, ordinal int, at long, data binary", answer, decode)


def total_bytes(index: DataFrame) -> DataFrame:
    """Answered from the index alone."""
    return index.groupBy("path").agg(F.max(F.col("decoded_offset") + F.col("decoded_size")).alias("n_bytes"))


def total_newlines(index: DataFrame) -> DataFrame:
    return index.groupBy("path").agg(F.max(F.col("line_offset") + F.col("n_newlines")).alias("n_newlines"))
