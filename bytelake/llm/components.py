"""Connected components by alternating large-star and small-star rounds over DataFrames; few edges in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.shared import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the edges, and the least node that is reached from it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        i, j = root[x], root[y]
        open_ = i != j
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(i, j)[open_], np.minimum(i, j)[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _alone(batches):
    cols = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if cols:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(np.concatenate(c) for c in zip(*cols)))], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of one orderable type); root is the component's least node.

    Edges stay in Spark: each round is two aggregations and joins on a node, and its result is checkpointed, so a
    lost executor costs one round at most. Self-loops, repeated and reversed edges are allowed; rows with a null end
    are ignored. No edges: no rows. More than `rounds` rounds (a chain of over 2**30 nodes) raises. Up to `few` distinct edges,
    of longs, are solved in one task instead: a round has some ten stages of all partitions, whatever it holds.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    if 0 < mark[0] <= few:
        return e.repartition(1).mapInArrow(_alone, "node long, root long")
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
