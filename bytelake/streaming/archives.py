"""New archives in a folder as a stream: each is counted and verified once, in the micro-batch that finds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelake.operators import archives


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """(path, modificationTime, length, content) of files as they come; a trigger takes a bounded number of them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def member_stream(stream: DataFrame, strict: bool = True) -> DataFrame:
    """The members of arriving archives."""
    return archives.members(stream, strict)


def count_stream(stream: DataFrame) -> DataFrame:
    return archives.counts(stream)


def windowed_sizes(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Archives and compressed bytes by time of change, closed by a watermark so that state stays bounded."""
    return stream.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", width)).agg(F.count("*").alias("archives"), F.sum("length").alias("bytes"))


def run_available(out: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to a Parquet table and stop; a next call goes on where this one ended."""
    q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return q
