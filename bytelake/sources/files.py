"""Archives as files: opening them anywhere, and the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local folder serves if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='bytelake-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends there, and any executor reads it."""
    shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint(eager=True)


def file_system(uri: str):
    """(file system, path) of a URI or a local path; `file:/x` is Spark's way of writing `file:///x`."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:') if uri.startswith('file:') else os.path.abspath(uri)}"
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))  # Spark's names of that store


@contextmanager
def opened(uri: str):
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        yield f


def read_range(uri: str, start: int, stop: int) -> bytes:
    """Bytes [start, stop) of a file, fewer at its end."""
    with opened(uri) as f:
        size = f.size()
        start = min(max(0, start), size)
        return f.read_at(max(0, min(stop, size) - start), start)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def contents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content): whole files of bounded size as rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def blobs(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """(path, content) of byte strings in memory."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


def resolve_source(source) -> bytes | str:
    """A path stays one; a file descriptor, a file object (also one that can't seek, or standard input as `-`) or bytes give their bytes."""
    if isinstance(source, (bytes, bytearray, memoryview)):
        return bytes(source)
    if isinstance(source, int):
        with os.fdopen(os.dup(source), "rb") as f:
            return f.read()
    if source == "-":
        return sys.stdin.buffer.read()
    if hasattr(source, "read"):
        return source.read()
    return os.fspath(source)


class Accesses(io.RawIOBase):
    """A reader that counts what is read from another: calls, bytes and seeks."""

    def __init__(self, raw):
        self.raw, self.reads, self.bytes, self.seeks = raw, 0, 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return self.raw.seekable()

    def readinto(self, buffer) -> int:
        got = self.raw.read(len(buffer))
        buffer[: len(got)] = got
        self.reads, self.bytes = self.reads + 1, self.bytes + len(got)
        return len(got)

    def seek(self, at: int, whence: int = 0) -> int:
        self.seeks += 1
        return self.raw.seek(at, whence)

    def tell(self) -> int:
        return self.raw.tell()


def output_name(path: str) -> str:
    """Where a decoded file goes: without .gz or .bz2 in any case, else with .out."""
    stem, dot, ending = path.rpartition(".")
    return stem if dot and stem and ending.lower() in ("gz", "bz2") else f"{path}.out"


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("length", F.octet_length("content").cast("long"))
