"""Mergeable statistics, histograms and analyses of block tables, as aggregations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from bytelake.operators.checkpoints import merged_intervals

GRAIN = 32 << 10


def statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, max, sum, average, sample variance and standard deviation."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.avg(v).alias("average"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("deviation"))


def format_uncertain(average: float, deviation: float, least: float | None = None, most: float | None = None, sigmas: int = 1) -> str:
    """`average +- deviation` with the digits that the deviation leaves meaning to (DIN 1333): two of it if they are below 30, else one."""
    u = deviation * sigmas
    if not u or not math.isfinite(u):
        places = 6
    else:
        places = 1 - math.floor(math.log10(u))
        places -= u * 10.0**places >= 30
    show = lambda x: f"{math.copysign(math.floor(abs(x) * 10.0**places + 0.5) / 10.0**places, x) if math.isfinite(x) else x:.{max(0, places)}f}"
    text = f"{show(average)} +- {show(u)}"
    return text if least is None else f"{show(least)} <= {text} <= {show(most)}"


formatted_uncertain = arrow_udf(lambda a, d: pa.array([None if x is None or y is None else format_uncertain(x, y) for x, y in zip(a.to_pylist(), d.to_pylist())], pa.string()), T.StringType())


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, whole: bool = True) -> DataFrame:
    """(bin, low, high, n): bins of equal width over [low, high], the highest value in the last. Values outside, null or not
    finite don't count; whole numbers get no more bins than there are of them. Empty bins are there."""
    if whole:
        bins = min(bins, int(high - low) + 1)
    spark, v = rows.sparkSession, F.col(value).cast("double")
    at = F.when(v == high, bins - 1).otherwise(F.floor((v - low) / (high - low) * bins) if high > low else F.lit(0))
    found = rows.where(v.between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (high - low) / bins
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.lit(float(low)) + F.col("bin") * width).alias("low"), (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_of(rows: DataFrame, value: str, bins: int, whole: bool = True) -> DataFrame:
    """A histogram over the range that the values have; no rows if there is no value."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return histogram(rows.limit(0), value, 0, 1, bins, whole).limit(0)
    return histogram(rows, value, low, high, bins, whole)


def plotted(h: DataFrame, width: int = 20) -> DataFrame:
    """A bar for each bin, as long as its share of the fullest one, rounded down."""
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # a row a bin
    return h.withColumn("bar", F.rpad(F.repeat(F.lit("="), F.floor(F.col("n") / F.greatest(most, F.lit(1)) * width).cast("int")), width, " "))


def spacing(checkpoints: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """(keys, spacing): the widest step between decoded offsets, in whole multiples of 32 KiB."""
    step = F.lead(offset).over(Window.partitionBy(*keys).orderBy(offset)) - F.col(offset)
    return checkpoints.select(*keys, step.alias("_s")).groupBy(*keys).agg((F.floor(F.max("_s") / GRAIN) * GRAIN).cast("long").alias("spacing"))


def index_analytics(checkpoints: DataFrame, keys: list[str], encoded: str, decoded: str, line: str | None = None, window: str | None = None) -> DataFrame:
    """Steps of an index in compressed bits and decoded bytes, sizes of its windows, whether its lines are in order."""
    w = Window.partitionBy(*keys).orderBy(decoded)
    rows = checkpoints.select(*keys, (F.lead(encoded).over(w) - F.col(encoded)).alias("_e"), (F.lead(decoded).over(w) - F.col(decoded)).alias("_d"), *([(F.lag(line).over(w) > F.col(line)).alias("_f"), F.col(line).alias("_l")] if line else []), *([F.octet_length(window).alias("_w")] if window else []))
    parts = [F.count("*").alias("checkpoints")]
    for c, name in (("_e", "encoded_step"), ("_d", "decoded_step")):
        parts += [F.min(c).alias(f"{name}_min"), F.avg(c).alias(f"{name}_avg"), F.stddev_samp(c).alias(f"{name}_dev"), F.max(c).alias(f"{name}_max")]
    if line:
        parts += [(F.count_if("_f") == 0).alias("lines_sorted"), F.max("_l").alias("last_line")]
    if window:
        parts += [F.min("_w").alias("window_min"), F.max("_w").alias("window_max"), F.sum("_w").alias("window_total")]
    return rows.groupBy(*keys).agg(*parts)


# Analyses of block tables (see operators.archives.blocks).


def block_types(blocks: DataFrame) -> DataFrame:
    """(btype, n, n_final, n_bytes): how many blocks of each type there are, and what they decode to."""
    return blocks.groupBy("btype").agg(F.count("*").alias("n"), F.count_if("is_final").alias("n_final"), F.sum("decoded_size").cast("long").alias("n_bytes"))


def symbol_shares(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """How many symbols are literals and references, and the share of the output that was copied."""
    return blocks.groupBy(*keys).agg(F.sum("literals").alias("literals"), F.sum("references").alias("references"), F.sum("copied").alias("copied"), (F.sum("copied") / F.greatest(F.sum("decoded_size"), F.lit(1))).alias("copied_share"))


def code_lengths(blocks: DataFrame, lengths: str) -> DataFrame:
    """(path, block_no, length, n): how many symbols have each length, zeros left out."""
    return blocks.select("path", "block_no", F.explode(lengths).alias("length")).where("length > 0").groupBy("path", "block_no", "length").agg(F.count("*").alias("n"))


def length_counts(matches: DataFrame, length: str = "length") -> DataFrame:
    """(length, n) for every length 0 to 258, also those that nothing has."""
    found = matches.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n"))
    return matches.sparkSession.range(259).withColumnRenamed("id", "length").join(found, "length", "left").select("length", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duplicates(rows: DataFrame, coding: str | Column) -> DataFrame:
    """(duplicates): by how many rows codings occur more than once."""
    return rows.groupBy(F.col(coding) if isinstance(coding, str) else coding).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def window_reads(blocks: DataFrame) -> DataFrame:
    """(path, block_no, start, end): the parts of what precedes a block that it refers to, merged; distances back from its start."""
    m = blocks.select("path", "block_no", F.explode("matches").alias("m")).select("path", "block_no", "m.*").where("distance > place")
    m = m.select("path", "block_no", F.greatest(F.col("distance") - F.col("place") - F.col("length"), F.lit(0)).alias("start"), (F.col("distance") - F.col("place")).alias("end"))
    return merged_intervals(m, ["path", "block_no"], "start", "end")


# Frequencies of bit patterns.


def bit_patterns(archives: DataFrame, width: int) -> DataFrame:
    """(pattern, n): how often each pattern of `width` (1 to 16) bits stands at any bit of the contents, highest bits first.

    Each row (path, content) counts by itself; patterns that would go past its end don't count."""
    schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(1 << width, np.int64)
        for b in batches:
            for c in b.column("content"):
                if not c.is_valid:
                    continue
                a = np.frombuffer(c.as_py(), np.uint8).astype(np.uint32)
                a = np.concatenate([a, np.zeros(3, np.uint32)])
                word = a[:-3] << np.uint32(24) | a[1:-2] << np.uint32(16) | a[2:-1] << np.uint32(8) | a[3:]
                bits = 8 * len(word)
                for r in range(8):
                    v = word << np.uint32(r) >> np.uint32(32 - width)
                    total += np.bincount(v[: max(0, (bits - r - width) // 8 + 1)], minlength=1 << width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema.names)

    return archives.select("content").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
