"""Archives made from tables, distributed: rows of blobs, or files in the shared folder of one group of rows each."""

from __future__ import annotations

import bz2
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.functions import formats
from bytelake.operators import archives
from bytelake.sources.files import cut, shared_dir, write_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python a few MB at a time: a worker holds a batch several times over, and a chain of steps has a worker for each.
    A limit that the session was given itself stays."""
    if spark.conf.get(BATCH_KEY) == f"{64 << 20}b":
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, data): each document's text in UTF-8, named by its id."""
    bounded_batches(spark)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def document_blobs(spark: SparkSession, sf_dir: str, codec: str = "gzip") -> DataFrame:
    return archives.encoded(document_bytes(spark, sf_dir), codec)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.encode(F.concat(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), F.lit("\n")), "UTF-8").alias("data"))


def archive_files(rows: DataFrame, group: Column, order: str, kind: str, name: str, ahead: bytes = b"") -> DataFrame:
    """(path, name, length): a file for each group of rows (`data`, each after `ahead`), in the order of `order`. kind: gzip (one member), members
    (one a row), bgzf, bzip2, zlib or deflate. A group is one archive; groups are of bounded size, so there are more of them in larger tables."""
    spark = rows.sparkSession
    folder = shared_dir(spark, name)
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64())])

    def run(key, t):
        parts = (ahead + d.as_py() for d in t.sort_by(order).column("data"))
        data = {"gzip": lambda: formats.gzip_member(parts), "members": lambda: b"".join(map(formats.gzip_member, parts)), "bgzf": lambda: formats.bgzf(b"".join(parts)), "bzip2": lambda: bz2.compress(b"".join(parts), 1), "zlib": lambda: zlib.compress(b"".join(parts), 6), "deflate": lambda: zlib.compress(b"".join(parts), 6, -15)}[kind]()
        path = f"{folder}/{key[0].as_py()}.{kind}"
        write_file(path, data)
        return pa.Table.from_pydict({"path": [path], "name": [str(key[0].as_py())], "length": [len(data)]}, schema=schema)

    return cut(rows.select(group.alias("_g"), order, "data").groupBy("_g").applyInArrow(run, "path string, name string, length long"))
