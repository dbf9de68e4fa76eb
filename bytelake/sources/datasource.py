"""Spark data sources: `spark.read.format("bytelake")` decodes archives, `.write.format("bytelake")` writes bytes back in order.

Read options: `path` (one archive), `index` (an index file of any format; then chunks are decoded in parallel, else one
task goes through the archive), `count_only` (sizes without data). Rows: chunk_no, decoded_offset, decoded_size,
n_newlines, data. Write: rows (decoded_offset, data) go to one file at `path`, each at its offset.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class Chunk(InputPartition):
    def __init__(self, no: int, row: dict | None):
        super().__init__(no)
        self.row = row


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index, self.count_only = options["path"], options.get("index"), str(options.get("count_only", "")).lower() == "true"

    def partitions(self):
        if not self.index:
            return [Chunk(0, None)]
        from bytelake.sources.files import read_range
        from bytelake.sources.index_files import ascending, read_index, without_footers

        found = read_index(read_range(self.index, 0, 1 << 62), self.path)
        rows, raw = ascending([c for c in found.checkpoints if c.bits < 8 * found.compressed_size]), without_footers(self.path)
        stops = [c.bits for c in rows[1:]] + [8 * found.compressed_size]
        return [Chunk(k, {"path": self.path, "length": found.compressed_size, "chunk_no": k, "start_bits": c.bits, "stop_bits": stop, "is_last": k == len(rows) - 1, "raw": raw, "window": c.window, "decoded_offset": c.offset}) for k, (c, stop) in enumerate(zip(rows, stops))]

    def read(self, partition):
        from bytelake.operators import archives, parallel
        from bytelake.sources.files import read_range

        row = partition.row
        if row is None:
            data, offset, no = archives.decode_bytes(read_range(self.path, 0, 1 << 62)), 0, 0
        else:
            data, offset, no = b"".join(p.data for p in parallel._pieces(row, row["window"])), row["decoded_offset"], row["chunk_no"]
        step = 4 << 20
        for at in range(0, max(len(data), 1), step):
            part = data[at : at + step]
            yield pa.RecordBatch.from_pydict({"chunk_no": pa.array([no], pa.int64()), "decoded_offset": pa.array([offset + at], pa.int64()), "decoded_size": pa.array([len(part)], pa.int64()), "n_newlines": pa.array([part.count(b"\n")], pa.int64()), **({} if self.count_only else {"data": pa.array([part], pa.binary())})})


@dataclass
class Part(WriterCommitMessage):
    path: str
    spans: list


class BytesWriter(DataSourceWriter):
    """Where `path` is a file that tasks can write to at any position, each task writes its rows at their offsets, and the commit
    renames the file when it is whole; a task that runs twice writes the same bytes twice. In stores without such writes each
    task writes a part, and the commit puts the parts together in order."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.own = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from bytelake.sources.files import file_system

        if self._local():
            return self._at_offsets(iterator)
        fs, path = file_system(f"{self.path}.{self.own}.parts/{uuid.uuid4().hex}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        spans, at = [], 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                out.write(bytes(row["data"]))
                spans.append((row["decoded_offset"], at, len(row["data"])))
                at += len(row["data"])
        return Part(path, spans)

    def _local(self) -> bool:
        from bytelake.sources.files import file_system

        return file_system(self.path)[0].type_name == "local"

    def _at_offsets(self, iterator):
        from bytelake.sources.files import file_system

        fs, path = file_system(f"{self.path}.{self.own}.part")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        f, end = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644), 0
        try:
            for row in iterator:
                data, at = memoryview(bytes(row["data"])), row["decoded_offset"]
                while data:
                    n = os.pwrite(f, data, at)
                    data, at = data[n:], at + n
                end = max(end, at)
            os.fsync(f)
        finally:
            os.close(f)
        return Part(path, [(end, 0, 0)])

    def _drop(self, fs, path):
        if fs.get_file_info(f"{path}.{self.own}.part").type.name == "File":
            fs.delete_file(f"{path}.{self.own}.part")
        parts = f"{path}.{self.own}.parts"
        if fs.get_file_info(parts).type.name == "Directory":
            fs.delete_dir(parts)

    def commit(self, messages):
        from bytelake.sources.files import file_system

        fs, path = file_system(self.path)
        if not self.overwrite and fs.get_file_info(path).type.name != "NotFound":
            self._drop(fs, path)
            raise FileExistsError(f"{path} is there already")
        if self._local():
            if not any(messages):
                with fs.open_output_stream(f"{path}.{self.own}.part"):
                    pass
            fs.move(f"{path}.{self.own}.part", path)
            return
        spans = sorted((offset, at, n, m.path) for m in messages if m for offset, at, n in m.spans)
        with fs.open_output_stream(path) as out:
            for _, at, n, part in spans:
                with fs.open_input_file(part) as f:
                    out.write(f.read_at(n, at))
        self._drop(fs, path)

    def abort(self, messages):
        from bytelake.sources.files import file_system

        self._drop(*file_system(self.path))


class BytelakeSource(DataSource):
    @classmethod
    def name(cls):
        return "bytelake"

    def schema(self):
        rest = "" if str(self.options.get("count_only", "")).lower() == "true" else ", data binary"
        return f"chunk_no long, decoded_offset long, decoded_size long, n_newlines long{rest}"

    def reader(self, schema):
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite):
        return BytesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BytelakeSource)
