"""Packing by optimal length buckets.

Texts are cut into sequences of at most `window` tokens. A token is a word, cut at ASCII white space, or a part of one: each UNIT
bytes begun of a longer word count as one, so that texts without blanks have a length as well. A dynamic program over the global histogram of sequence lengths (at
most `window` entries, whatever the corpus) chooses the bucket boundaries that minimise padding; inside a bucket,
sequences in the order of a hash form batches of at most `budget` padded tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.shared import bounded_batches, cut

WINDOW, BUCKETS, BUDGET = 2048, 16, 65_536
UNIT = 16  #: bytes of UTF-8 that a token has at most
SHARD = 2000  #: sequences that are numbered together, about; a bucket has as many shards as its size asks for


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets with the least padding, ascending; ties to fewer buckets, then to lower ones."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    many = np.r_[0, np.cumsum(c)]
    best = np.full((min(buckets, n) + 1, n + 1), np.iinfo(np.int64).max // 4)
    best[0, 0], back = 0, np.zeros(best.shape, np.int64)
    for k in range(1, len(best)):
        for j in range(k, n + 1):  # padded size of x[i:j] is x[j - 1] each; real tokens are the same in all plans
            cost = best[k - 1, :j] + x[j - 1] * (many[j] - many[:j])
            back[k, j] = i = int(cost.argmin())
            best[k, j] = cost[i]
    k, j, out = int(best[:, n].argmin()), n, []
    while j:
        out.append(int(x[j - 1]))
        j, k = int(back[k, j]), k - 1
    return out[::-1]


def n_tokens(text: str | None) -> int:
    """A whole text's tokens."""
    words = (text or "").encode().split()
    return len(words) + sum((n - 1) // UNIT for n in map(len, words) if n > UNIT)


def sequences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, seq_no, start, n_tokens): each text's tokens in sequences of at most `window`; start counts tokens."""

    def run(batches):
        for b in batches:
            ids, cols = [], ([], [], [])
            for i, text in enumerate(b.column("text")):
                n = n_tokens(text.as_py())
                for k, at in enumerate(range(0, max(n, 1), window)):
                    ids.append(i)
                    for col, v in zip(cols, (k, at, min(window, n - at))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "seq_no", "start", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, seq_no long, start long, n_tokens long")


def pack(docs: DataFrame, window: int = WINDOW, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: doc_id, seq_no, start, n_tokens, padded_to (its bucket), batch_no (within the bucket), slot (within the batch).

    Batches of a bucket hold budget // padded_to sequences (1 at least), all but the last. A null, empty or blank text
    is one sequence of no tokens, in the bucket of the shortest; a text of any length is cut into as many sequences as it takes;
    sequences of equal length are in one bucket, in the order of a hash; repeated rows are packed each; a null doc_id is packed like others; other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    spark, rows = docs.sparkSession, cut(sequences(docs, window))
    found = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # window + 1 rows at most
    if not found:
        return spark.createDataFrame([], "doc_id long, seq_no long, start long, n_tokens long, padded_to long, batch_no long, slot long")
    ends = boundaries(np.array([r[0] for r in found]), np.array([r[1] for r in found]), buckets)
    sizes = [max(1, sum(n for x, n in found if low < x <= end) // SHARD) for low, end in zip([-1, *ends], ends)]
    which = F.element_at(F.filter(F.array(*(F.struct(F.lit(e).cast("long").alias("end"), F.lit(n).cast("long").alias("shards")) for e, n in zip(ends, sizes))), lambda e: e["end"] >= F.col("n_tokens")), 1)
    placed = rows.withColumn("w", which).withColumn("h", F.xxhash64("doc_id", "seq_no")).select("doc_id", "seq_no", "start", "n_tokens", "h", F.col("w.end").alias("padded_to"), F.pmod(F.xxhash64("h"), F.col("w.shards")).alias("shard"))
    sizes = placed.groupBy("padded_to", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("padded_to", "shard", (F.sum("n").over(Window.partitionBy("padded_to").orderBy("shard")) - F.col("n")).alias("before"))
    own = Window.partitionBy("padded_to", "shard").orderBy("h", "doc_id", "seq_no", "n_tokens")
    numbered = placed.withColumn("r", F.row_number().over(own)).join(before, ["padded_to", "shard"])
    place, many = F.col("before") + F.col("r") - 1, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    return numbered.select("doc_id", "seq_no", "start", "n_tokens", "padded_to", F.floor(place / many).cast("long").alias("batch_no"), (place % many).cast("long").alias("slot"))
