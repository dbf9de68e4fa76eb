"""A stated query set against all rows of a vector table, in bounded blocks.

Candidates are dealt to stripes and queries to batches; every stripe meets every batch in one group. A group's candidates
come first, and an index is built of them once; its queries follow and stream past that index, so a task holds one
stripe, whatever the number of queries. Rows are copied once for each batch and queries once for each stripe, so what is
shuffled grows with the square of the table over the sizes of both. Unless the caller sets them, a table has SHARE stripes, more
where one would hold over HELD components, fewer where one would be under STRIPE rows; batches are of some WIDE queries. Each group
gives at most k rows a query, and a window keeps the best k over all stripes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIPE, BATCH = 8192, 16_384
SHARE, HELD, WIDE = 64, 1 << 24, 1 << 17
SHORT = (1 << 15) - 1  #: whole numbers of this size at most are shuffled as two bytes


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector isn't null and holds only finite numbers; v is an array of doubles.
    A row with a null vec_id or an empty vector takes no part."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('inf'))")


def layout(n: int, n_queries: int, dims: int, stripe: int | None = None, batch: int | None = None) -> tuple[int, int]:
    """How many stripes and batches there are."""
    batch = batch or (BATCH if stripe else WIDE)
    stripe = stripe or max(STRIPE, min(-(-n // SHARE), HELD // dims))
    return max(1, -(-n // stripe)), max(1, -(-n_queries // batch))


def block_search(df: DataFrame, modulus: int, k: int, score_type: str, index, stripe: int | None = None, batch: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the best k over all blocks, ties to the smaller vec_id.

    `df`: (vec_id, v). Queries: rows whose vec_id is divisible by `modulus` (of repeated ids the least vector, once);
    a row that has the query's vec_id isn't its candidate. index(ids, vectors).search(query, k, query_id) gives arrays
    (vec_id, score); ids ascend. An index may have search_many(queries, k, query_ids), which gives (place of the query, vec_id, score).
    Vectors of another length than the query's are no candidates of it. Vectors of whole numbers have the score type long.
    """
    df = df.withColumn("dim", F.size("v"))
    size = F.max(F.greatest(F.array_max("v"), -F.array_min("v"))) if score_type == "long" else F.lit(None)
    n, n_queries, dims, size = df.agg(F.count("*"), F.count_if(F.col("vec_id") % modulus == 0), F.max("dim"), size).first()
    if size is not None and size <= SHORT:
        df = df.withColumn("v", F.col("v").cast("array<short>"))
    stripes, batches = layout(n, n_queries, dims or 1, stripe, batch)
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    queries = df.where(F.col("vec_id") % modulus == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    queries = queries.select("dim", every(stripes).alias("s"), F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(batches)).alias("b"), F.lit(True).alias("asks"), "vec_id", "v")
    rows = df.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(stripes)).alias("s"), every(batches).alias("b"), F.lit(False).alias("asks"), "vec_id", "v")
    as_type = {"long": pa.int64(), "double": pa.float64()}[score_type]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", as_type)])

    def run(parts):
        group, held, made = None, [], None
        for part in parts:
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "s", "b", "asks", "vec_id")]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)]) if part.num_rows else []
            out = []
            for at, end in zip(cuts, [*cuts[1:], part.num_rows]):
                own, ids = tuple(int(c[at]) for c in cols[:3]), cols[4][at:end]
                if own != group:
                    group, held, made = own, [], None
                v = part.column("v").slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(end - at, own[0])
                if not cols[3][at]:
                    held.append((ids, v))
                elif held or made:
                    if made is None:
                        made, held = index(*(np.concatenate(x) for x in zip(*held))), []
                    if hasattr(made, "search_many"):
                        place, found, scores = made.search_many(v, k, ids)
                        out.append((ids[place], found, scores))
                        continue
                    for query_id, q in zip(ids, v):
                        found, scores = made.search(q, k, query_id)
                        out.append((np.full(len(found), query_id), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    met = rows.unionByName(queries).repartition(min(20_000, 4 * stripes * batches), "dim", "s", "b")
    found = met.sortWithinPartitions("dim", "s", "b", "asks", "vec_id", "v").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[-k]
        some = np.flatnonzero(scores >= bar)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
