"""The training-corpus pipeline: language identification, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What a stage returns is written as
Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm import langid, lenpack, linededup, simhash
from bytelake.llm.shared import fresh_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null, empty and letterless texts, and texts of no language that it learnt.

    Columns, rows that repeat or lack a doc_id, and texts of any length: see langid.accepted. An empty table gives none."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, the one of the largest doc_id; n_chars follows the text.

    Every row stays: null texts are null still, texts that lose every line empty. Rows that repeat a doc_id share its
    decisions; null doc_ids count as one document. Other columns stay as they are; an empty table gives none."""
    return linededup.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: that of the least doc_id.

    Null, empty and blank texts are copies of each other. Rows without a doc_id stay, and so do rows that repeat one that
    stays. Columns may have any names; an empty table gives none."""
    return simhash.drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, as packed sequences (see lenpack.pack): doc_id, seq_no, start, n_tokens, padded_to, batch_no, slot.

    Null, empty and blank texts are one sequence of no tokens; repeated rows are packed each; an empty table gives none."""
    return lenpack.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_neardup", near_duplicates), ("packing", packing)]

#: A trained classifier and a dynamic program are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(at)
    return docs
