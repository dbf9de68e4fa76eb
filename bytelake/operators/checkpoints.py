"""Maps from compressed to decoded offsets, as DataFrames: prefix sums, lookups, thinning, splitting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def before(value: str | Column, keys: list[str], order: list) -> Column:
    """The sum of `value` over all earlier rows, 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(FIRST, -1)), F.lit(0)).cast("long")


def with_offsets(blocks: DataFrame, keys: list[str], order: str, size: str, out: str = "decoded_offset") -> DataFrame:
    return blocks.withColumn(out, before(size, keys, [order]))


def two_level_offsets(blocks: DataFrame, order: str, size: str, cell: int, out: str = "decoded_offset") -> DataFrame:
    """Prefix sums of one long sequence without one task for all of it: sums of cells of `order` first, then within cells."""
    rows = blocks.withColumn("_cell", F.floor(F.col(order) / cell))
    sums = rows.groupBy("_cell").agg(F.sum(size).alias("_sum"))
    starts = sums.select("_cell", before("_sum", [], ["_cell"]).alias("_start"))
    return rows.withColumn("_within", before(size, ["_cell"], [order])).join(starts, "_cell").withColumn(out, F.col("_start") + F.col("_within")).drop("_cell", "_within", "_start")


def sizes_from_offsets(checkpoints: DataFrame, keys: list[str], order: str, offset: str, end: Column, out: str = "decoded_size") -> DataFrame:
    """Sizes from the next row's offset, the last one's from `end`."""
    return checkpoints.withColumn(out, F.coalesce(F.lead(offset).over(Window.partitionBy(*keys).orderBy(order)), end) - F.col(offset))


def at_exactly(probes: DataFrame, checkpoints: DataFrame, at: list[str]) -> DataFrame:
    """Each probe with the checkpoint that stands at its very place (columns `at` of both); nulls where there is none."""
    return probes.join(checkpoints, at, "left")


def end_rows(checkpoints: DataFrame, keys: list[str], order: str, offset: str) -> DataFrame:
    """Rows that hold nothing: the next one has the same decoded offset, or there is none."""
    following = F.lead(offset).over(Window.partitionBy(*keys).orderBy(order))
    return checkpoints.withColumn("is_end", F.coalesce(following == F.col(offset), F.lit(True)))


def unsorted_pairs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, n): neighbours whose values fall; 0 where all is in order."""
    falls = F.lag(value).over(Window.partitionBy(*keys).orderBy(order)) > F.col(value)
    return rows.select(*keys, falls.alias("_f")).groupBy(*keys).agg(F.count_if("_f").alias("n"))


def as_of(probes: DataFrame, checkpoints: DataFrame, at: str, offset: str, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each probe with the last checkpoint whose offset is `at` or less (`strict`: less); nulls where there is none.

    One union sorted by offset and a running last value: no pair is formed that isn't in the result. Without `keys`, ranges of
    offsets are dealt by cells, and a cell takes the last checkpoint before it from a small table of cells."""
    keys = keys or []
    fields = [c for c in checkpoints.columns if c not in keys]
    p = probes.select(*keys, F.col(at).alias("_x"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[c for c in probes.columns if c not in keys]).alias("_p"), F.lit(None).cast(checkpoints.select(F.struct(*fields).alias("s")).schema["s"].dataType).alias("_c"))
    c = checkpoints.select(*keys, F.col(offset).alias("_x"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*fields).alias("_c"))
    both, part = p.unionByName(c), keys
    if not keys:
        n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        low, high = both.agg(F.min("_x"), F.max("_x")).first()
        width = max(1, -(-((high or 0) - (low or 0) + 1) // n))
        both, part = both.withColumn("_cell", F.floor((F.col("_x") - F.lit(low or 0)) / width)), ["_cell"]
        lasts = both.where("_c is not null").groupBy("_cell").agg(F.max_by("_c", F.col("_x")).alias("_c"))
        cells = both.select("_cell").distinct().join(lasts, "_cell", "left")  # `n` rows at most
        w = Window.orderBy("_cell").rowsBetween(FIRST, -1)
        first = cells.select("_cell", F.last("_c", True).over(w).alias("_before"))
        both = both.join(F.broadcast(first), "_cell", "left")
    w = Window.partitionBy(*part).orderBy("_x", "_side").rowsBetween(FIRST, 0)
    found = F.last("_c", True).over(w)
    if not keys:
        found = F.coalesce(found, F.col("_before"))
    out = both.withColumn("_c", found).where("_p is not null")
    names = set(probes.columns)
    return out.select(*keys, "_p.*", *[F.col(f"_c.{f}").alias(f if f not in names else f"checkpoint_{f}") for f in fields])


def thinned(checkpoints: DataFrame, keys: list[str], offset: str, spacing: int) -> DataFrame:
    """Checkpoints that are needed for chunks of `spacing` at most: one is left out when the next is within `spacing` of the last that
    was kept; the first and the last of each archive stay. Which stay depends on those before, so an archive is gone through in order."""
    schema = checkpoints.schema
    rows = checkpoints.repartition(*keys).sortWithinPartitions(*keys, offset)

    def run(batches):
        own, kept, waiting = None, 0, None  # the row that waits has no successor yet
        for b in batches:
            out = []
            values = b.column(offset).to_pylist()
            names = list(zip(*(b.column(k).to_pylist() for k in keys))) if keys else [()] * b.num_rows
            for i, (key, x) in enumerate(zip(names, values)):
                row = b.slice(i, 1)
                if key != own:
                    if waiting is not None:
                        out.append(waiting[1])
                    out.append(row)
                    own, kept, waiting = key, x, None
                    continue
                if waiting is not None and x - kept > spacing:
                    out.append(waiting[1])
                    kept = waiting[0]
                waiting = x, row
            yield from out
        if waiting is not None:
            yield waiting[1]

    return rows.mapInArrow(run, schema)


def split(boundaries: DataFrame, key: str, encoded: str, decoded: str, spacing: int) -> DataFrame:
    """(key, part, encoded_start, encoded_end, decoded_start, decoded_end): chunks cut at block boundaries so that parts have about `spacing`
    decoded bytes. A chunk of n spacings, rounded, has n - 1 ideal cuts; each takes the boundary nearest to it (the earlier of two as near,
    the last of equal ones), and what falls together is one cut. The first and last boundary of a chunk are its ends."""
    ends = boundaries.groupBy(key).agg(F.min(encoded).alias("_e0"), F.max(encoded).alias("_e1"), F.min(decoded).alias("_d0"), F.max(decoded).alias("_d1"))
    sized = ends.withColumn("_n", F.floor((F.col("_d1") - F.col("_d0")) / spacing + 0.5).cast("int"))
    ideal = sized.where("_n > 1").select(key, "_d0", F.explode(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.floor(i * (F.col("_d1") - F.col("_d0")) / F.col("_n")).cast("long"))).alias("_ideal"))
    inner = boundaries.join(ends.select(key, "_e0", "_d0"), key).where(F.col(encoded) > F.col("_e0")).groupBy(key, (F.col(decoded) - F.col("_d0")).alias("_x")).agg(F.max(encoded).alias("_e"))
    points = inner.select(key, F.col("_x"), "_e")
    low = as_of(ideal, points, "_ideal", "_x", [key])
    high = as_of(low.withColumn("_neg", -F.col("_ideal")), points.select(key, (-F.col("_x")).alias("_nx"), F.col("_x").alias("_hx"), F.col("_e").alias("_he")), "_neg", "_nx", [key])
    near = high.withColumn("_low", F.col("_x").isNotNull() & (F.col("_hx").isNull() | (F.col("_ideal") - F.col("_x") <= F.col("_hx") - F.col("_ideal"))))
    cuts = near.select(key, F.when(F.col("_low"), F.col("_x")).otherwise(F.col("_hx")).alias("_x"), F.when(F.col("_low"), F.col("_e")).otherwise(F.col("_he")).alias("_e")).where("_x > 0").distinct()
    last = sized.select(key, (F.col("_d1") - F.col("_d0")).alias("_x"), F.col("_e1").alias("_e"))
    stops = cuts.join(last.select(key, F.col("_x").alias("_end")), key).where(F.col("_x") < F.col("_end")).select(key, "_x", "_e").unionByName(last)
    w = Window.partitionBy(key).orderBy("_x")
    out = stops.join(sized.select(key, "_e0", "_d0"), key)
    return out.select(key, F.row_number().over(w).alias("part"), F.coalesce(F.lag("_e").over(w), F.col("_e0")).alias("encoded_start"), F.col("_e").alias("encoded_end"), (F.coalesce(F.lag("_x").over(w), F.lit(0)) + F.col("_d0")).alias("decoded_start"), (F.col("_x") + F.col("_d0")).alias("decoded_end"))


def grown(blocks: DataFrame, key: str, order: str, size: str, spacing: int) -> DataFrame:
    """(key, part, first, n_blocks, decoded_size): chunks cut while they are decoded. A part takes blocks until it has `spacing` decoded bytes;
    a last part of less than a quarter of that goes to the one before. `first`: `order` of a part's first block."""
    own = blocks.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("order"), F.col(size).cast("long").alias("size"))
    schema = pa.schema([(c, pa.int64()) for c in ("key", "part", "first", "n_blocks", "decoded_size")])

    def run(t: pa.Table) -> pa.Table:
        parts: list[list[int]] = []
        for at, n in sorted(zip(t.column("order").to_pylist(), t.column("size").to_pylist())):
            if not parts or parts[-1][2] >= spacing:
                parts.append([at, 0, 0])
            parts[-1][1] += 1
            parts[-1][2] += n
        if len(parts) > 1 and parts[-1][2] < spacing // 4:
            _, blocks_, bytes_ = parts.pop()
            parts[-1][1] += blocks_
            parts[-1][2] += bytes_
        name = t.column("key")[0].as_py()
        return pa.Table.from_pylist([dict(zip(schema.names, (name, k + 1, *p))) for k, p in enumerate(parts)], schema)

    return own.groupBy("key").applyInArrow(run, ", ".join(f"{c} long" for c in schema.names)).withColumnRenamed("key", key)


def within(probes: DataFrame, chunks: DataFrame, at: str, start: str, most: str, keys: list[str] | None = None) -> DataFrame:
    """Each probe with the chunk that it may name, nulls where there is none: a chunk's start is known up to a span (start to `most`, both
    of it; a null `most`: exactly its start). Spans of different chunks don't overlap."""
    out = as_of(probes, chunks, at, start, keys)
    fits = F.col(at) <= F.coalesce(F.col(most), F.col(start))
    fields = [c for c in chunks.columns if c not in (keys or [])]
    return out.select(*probes.columns, *[F.when(fits, F.col(c)).alias(c) for c in fields])


def with_parent(children: DataFrame, parents: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Each part of a chunk that was split with `parent_chunk`, the start of the chunk it was cut from; null outside of all."""
    out = as_of(children, parents.select(*(keys or []), F.col(start).alias("_start"), F.col(end).alias("_end")), at, "_start", keys)
    return out.select(*children.columns, F.when(F.col(at) < F.col("_end"), F.col("_start")).alias("parent_chunk"))


def index_of(probes: DataFrame, known: DataFrame, at: str, offset: str, spacing: int) -> DataFrame:
    """Each probe with `block_index`: that of the known block which begins there (known blocks are numbered by offset); after the last
    one, the number that the cell of `spacing` beginning there will have; null where no block can begin."""
    numbered = two_level_offsets(known.select(F.col(offset).alias("_o"), F.lit(1).alias("_one")), "_o", "_one", 1 << 16, "_index").select("_o", "_index")
    n, last = known.agg(F.count("*"), F.max(offset)).first()
    beyond = (F.col(at) > F.lit(last)) & (F.col(at) % spacing == 0)
    cell = F.lit(n) + F.floor(F.col(at) / spacing) - (0 if last is None else last // spacing + 1)
    out = probes.join(numbered, probes[at] == numbered["_o"], "left")
    return out.select(*probes.columns, F.coalesce(F.col("_index"), F.when(beyond, cell)).cast("long").alias("block_index"))


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, last, n): runs of values that rise by one each, equal ones counted once.

    One sort and two passes in its order: of each run stay its first and its last row, then the first one takes the value of the next.
    No table of values or runs is held. A key's nulls are a run of their own."""
    w, v = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(value)), F.col(value)
    opens = F.when(v.isNull(), F.row_number().over(w) == 1).otherwise(F.coalesce(v > F.lag(v).over(w) + 1, F.lag(v).over(w).isNull()))
    closes = F.when(v.isNull(), F.row_number().over(w) == 1).otherwise(F.coalesce(v < F.lead(v).over(w) - 1, F.lit(True)))
    ends = rows.select(*keys, v, opens.alias("_o"), closes.alias("_c")).where("_o or _c")
    found = ends.withColumn("_l", F.when(F.col("_c"), v).otherwise(F.lead(v).over(w))).where("_o")
    return found.select(*keys, v.alias("first"), F.col("_l").alias("last"), F.coalesce(F.col("_l") - v + 1, F.lit(1)).cast("long").alias("n"))


def adjacent_pairs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, n): neighbours of which the second is the first and one more."""
    step = F.col(value) == F.lag(value).over(Window.partitionBy(*keys).orderBy(order)) + 1
    return rows.select(*keys, step.alias("_s")).groupBy(*keys).agg(F.count_if("_s").alias("n"))


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): unions of half-open intervals that overlap or touch."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(FIRST, -1))
    opens = F.when(F.coalesce(F.col(start) > reach, F.lit(True)), 1).otherwise(0)
    return rows.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w.rowsBetween(FIRST, 0))).groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def interleaved(rows: DataFrame, list_no: str, order: str) -> DataFrame:
    """`rows` of several lists with `turn`, their place in their list from 0: in the order of turn and list_no the lists take turns."""
    return rows.withColumn("turn", (F.row_number().over(Window.partitionBy(list_no).orderBy(order)) - 1).cast("long"))


def interleaved_except(rows: DataFrame, list_no: str, order: str, known: DataFrame, on: str, n: int) -> DataFrame:
    """The first n of the interleaved rows whose `on` isn't in `known`."""
    return interleaved(rows, list_no, order).join(known, on, "left_anti").orderBy("turn", list_no).limit(n)
