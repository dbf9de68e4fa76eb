"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, last_doc), bucketed and sorted by hash. Each batch of documents is merge-anti-joined
with the runs: keys that no run has become a run of level 0, with the documents of that batch that hold them; keys
that some run has go to a run of changes, which hold what the batch adds to them. Two runs of a level are merged
into one of the next. So the runs hold each key once, and a key's documents are those of its run and of its changes.
All runs have the same buckets, so joining and compacting them moves no row of theirs. Each bucket of a run is a file, and
Hadoop's local file system starts a process for each file that it creates, which until it is running is counted with
all the executor's memory once more. So there are no more buckets than the lines are worth.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from bytelake.llm.shared import WHITE, bounded_batches, fresh_dir, partitions, remove

BATCHES = 3
BUCKET, PARTITIONS = 50_000, "spark.sql.shuffle.partitions"  #: lines to a bucket at least, where there are enough buckets for all cores
MASK, TOP = (1 << 64) - 1, 1 << 63
KEY = ["h1", "h2"]
ID, LOST = "__line_dedup_id", "__line_dedup_lost"  #: columns beside those of the documents, whatever theirs are called


def key(line: str) -> str:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.encode().strip(WHITE).lower().decode()


def digest(k: str) -> tuple[int, int]:
    h = xxh3_128_intdigest(k.encode())
    return (h >> 64) - TOP, (h & MASK) - TOP


def lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2): the keys of `least` code points or more of each row, once each."""

    def run(batches):
        for b in batches:
            ids, found, n = [], [], 0
            for i, text in enumerate(b.column("text")):
                found.extend(own := {digest(k) for line in (text.as_py() or "").split("\n") if len(line) >= least and len(k := key(line)) >= least})
                ids.append((i, len(own)))
            at = pa.array([i for i, n in ids for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["doc_id", *KEY])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h1 long, h2 long")


@contextmanager
def buckets_for(spark: SparkSession, n_lines: int) -> Iterator[int]:
    """Shuffles, and with them runs, have as many partitions here as so many lines are worth; never more than the session's own number."""
    own = partitions(spark)
    spark.conf.set(PARTITIONS, str(min(own, max(2 * spark.sparkContext.defaultParallelism, n_lines // BUCKET))))
    try:
        yield partitions(spark)
    finally:
        spark.conf.set(PARTITIONS, str(own))


class LineRuns:
    """A store of levelled runs in a folder that driver and executors share: `keys`, each key once, and `changes` to them."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.buckets = spark, path or fresh_dir(spark, "runs"), partitions(spark)
        self.keys: list[list[str]] = []
        self.changes: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        """Write (h1, h2, n_docs, last_doc) as a run. Rows that come from an aggregate or from runs are dealt as buckets are."""
        name = f"bytelake_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"drop table {name}")
            remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        self._drop([r for levels in (self.keys, self.changes) for level in levels for r in level])
        self.keys, self.changes = [], []

    def fresh(self, batch: str) -> DataFrame:
        """The rows of a batch's own run whose key no run has: a merge-anti-join with each run, bucket by bucket."""
        out = self.spark.table(batch)
        for run in (r for level in self.keys for r in level):
            out = out.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return out

    def add(self, batch: DataFrame) -> None:
        """Add (doc_id, h1, h2) rows of documents that no other batch has."""
        own = self._write(batch.distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if not self.keys:
            return self._put(self.keys, 0, own)
        fresh = self._write(self.fresh(own))
        known = self.spark.table(own).join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti")
        self._put(self.changes, 0, self._write(known))
        self._put(self.keys, 0, fresh)
        self._drop([own])

    def _put(self, levels: list[list[str]], level: int, run: str) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == 2:
            runs, levels[level] = levels[level], []
            merged = self._write(self._with(self.spark.table(runs[0]), runs[1], "full"))
            self._drop(runs)
            self._put(levels, level + 1, merged)

    def _with(self, rows: DataFrame, run: str, how: str) -> DataFrame:
        """Add up what two runs say of their keys: a merge join, bucket by bucket."""
        more = self.spark.table(run).toDF(*KEY, "more", "later").hint("merge")
        n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return rows.join(more, KEY, how).select(*KEY, n.alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))

    def known(self) -> list[DataFrame]:
        """(h1, h2, n_docs, last_doc), a frame for each run of keys: what it says, and all changes."""
        out = []
        for run in (r for level in self.keys for r in level):
            rows = self.spark.table(run)
            for changes in (r for level in self.changes for r in level):
                rows = self._with(rows, changes, "left")
            out.append(rows)
        return out


def repeated_lines(docs: DataFrame, least: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keys): the hashes of the lines that each document loses. Documents are distinct doc_ids (null is one of them)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = fresh_dir(spark, "lines")
    lines(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(at)
    all_lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(at)
    with buckets_for(spark, all_lines.count()):
        store = LineRuns(spark)
        for i in range(batches):
            store.add(all_lines.where(F.col("batch") == i).select("doc_id", *KEY))
        for rows in store.known():  # into a table of its own: the join may then split a hot key
            rows.where(F.col("n_docs") >= min_docs).write.mode("append").parquet(f"{store.path}/often")
    often = spark.read.schema("h1 long, h2 long, n_docs long, last_doc long").parquet(f"{store.path}/often")
    store.drop()
    lost = all_lines.join(often, KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc")))
    return lost.where("last_doc is not null").groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias(LOST))


def _apply(batches, least: int, extra: bool):
    for b in batches:
        out, n_lines, n_dropped = [], [], []
        for text, lost in zip(b.column("text"), b.column(LOST)):
            own = (text.as_py() or "").split("\n")
            n_lines.append(len(own))
            if lost := lost.as_py():
                gone = {(x["h1"], x["h2"]) for x in lost}
                kept = [x for x in own if len(x) < least or len(k := key(x)) < least or digest(k) not in gone]
                out.append("\n".join(kept))
                n_dropped.append(len(own) - len(kept))
            else:
                out.append(text.as_py())
                n_dropped.append(0)
        cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] not in ("text", LOST)]
        names = [x for x in b.schema.names if x not in ("text", LOST)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), *([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if extra else [])], [*names, "text", *(["n_lines", "n_dropped"] if extra else [])])


def dedup_lines(docs: DataFrame, least: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines (before), n_dropped.

    A key of `least` code points or more found in `min_docs` documents or more loses all its lines except in the
    largest doc_id that holds it. Null and empty texts are one empty line; a text that loses nothing stays as it is
    (null stays null), one that loses every line becomes empty. Documents are distinct doc_ids; rows that repeat one
    share its decisions; null doc_ids count as one document, less than every other. Other columns are not read; an
    empty table gives no rows.
    """
    lost = repeated_lines(docs, least, min_docs).withColumnRenamed("doc_id", ID)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = own.join(lost, F.col("doc_id").eqNullSafe(F.col(ID)), "left").select("doc_id", "text", LOST)
    return both.mapInArrow(lambda bs: _apply(bs, least, True), "doc_id long, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, least: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with its columns and rows, its texts without the repeated lines (see dedup_lines)."""
    lost = repeated_lines(docs, least, min_docs).withColumnRenamed("doc_id", ID)
    both = docs.join(lost, docs["doc_id"].eqNullSafe(lost[ID]), "left").drop(ID)
    order = [c for c in both.columns if c not in ("text", LOST)]
    schema = docs.select(*order, "text").schema
    return both.select(*order, "text", LOST).mapInArrow(lambda bs: _apply(bs, least, False), schema).select(*docs.columns)
