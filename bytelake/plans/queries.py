"""Queries over whole tables for the byte-stream operators, each with the SQL that says the same about the plain rows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.functions import access, coding, crc, ranges, scalars
from bytelake.operators import archives, checkpoints, parallel, selection, stats
from bytelake.plans.fixtures import archive_files, document_blobs, document_bytes, order_lines, table
from bytelake.sources import datasource, index_files
from bytelake.sources.files import contents, cut, read_range, shared_dir
from bytelake.streaming import archives as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BYTES = "octet_length(encode(coalesce(text, '')))"
NEWLINES = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))"

# Scans, formats, members, integrity.


@query(f"select count(*) n_archives, sum({BYTES})::bigint n_bytes, sum({NEWLINES})::bigint n_lines from documents")
def count_bytes_lines(spark: SparkSession, sf: str) -> DataFrame:
    return archives.counts(document_blobs(spark, sf)).agg(F.count("*").alias("n_archives"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_newlines").alias("n_lines"))


@query(f"select cast(doc_id as varchar) path, {BYTES}::bigint n_bytes, md5(coalesce(text, '')) digest from documents")
def decode_bzip2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return archives.decoded(document_blobs(spark, sf, "bzip2")).select("path", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


CODECS = ["gzip", "bgzf", "zlib", "bzip2", "deflate"]


@query("""select cast(doc_id as varchar) path, ['GZIP', 'BGZF', 'ZLIB', 'BZIP2', 'DEFLATE'][(doc_id % 5 + 1)::int] file_type,
[8 * (11 + length(cast(doc_id as varchar))), 144, 16, 32, 0][(doc_id % 5 + 1)::int]::bigint first_block_bits from documents""")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_bytes(spark, sf)
    blobs = [archives.encoded(rows.where(F.col("doc_id") % 5 == k), c) for k, c in enumerate(CODECS)]
    return archives.file_types(reduce(DataFrame.unionByName, blobs)).select("path", "file_type", "first_block_bits")


@query("select cast(doc_id as varchar) path, ['GZIP', 'BGZF', 'ZLIB', 'BZIP2'][(doc_id % 4 + 1)::int] file_type from documents")
def file_types_by_magic(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_bytes(spark, sf)
    blobs = [archives.encoded(rows.where(F.col("doc_id") % 4 == k), c) for k, c in enumerate(CODECS[:4])]
    return reduce(DataFrame.unionByName, blobs).select("path", scalars.type_by_magic(F.col("content")).alias("file_type"))


@query(f"""select cast(doc_id as varchar) path, 'END_OF_STREAM' point, {BYTES}::bigint decoded_offset from documents union all
select cast(doc_id as varchar) path, 'END_OF_STREAM_HEADER' point, 0::bigint decoded_offset from documents""")
def stopping_points(spark: SparkSession, sf: str) -> DataFrame:
    return archives.stopping_points(document_blobs(spark, sf)).where("point like 'END_OF_STREAM%'").select("path", "point", "decoded_offset")


@query(f"""select cast(doc_id as varchar) path, 0 member_no, 0::bigint header_bits, (8 * (11 + length(cast(doc_id as varchar))))::bigint data_bits, cast(doc_id as varchar) file_name,
{BYTES}::bigint decoded_size, {BYTES}::bigint isize, 'Unix' system, 'none' extra_flags, true valid from documents""")
def gzip_members(spark: SparkSession, sf: str) -> DataFrame:
    m = archives.members(document_blobs(spark, sf))
    return m.select("path", "member_no", "header_bits", "data_bits", "file_name", "decoded_size", "isize", scalars.system_name(F.col("os")).alias("system"), scalars.extra_flags_name(F.col("xfl")).alias("extra_flags"), "valid")


@query(f"select cast(doc_id as varchar) path, {BYTES}::bigint n_bytes, true consistent from documents")
def symbol_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Literals and copied bytes of all blocks are what an archive decodes to; references copy three bytes or more each."""
    found = stats.symbol_shares(archives.blocks(document_blobs(spark, sf)), ["path"])
    consistent = (F.col("copied") >= 3 * F.col("references")) & (F.col("copied") <= 258 * F.col("references")) & F.col("copied_share").between(0, 1)
    return found.select("path", (F.col("literals") + F.col("copied")).cast("long").alias("n_bytes"), consistent.alias("consistent"))


@query(f"select 'UNCOMPRESSED' btype, sum({BYTES})::bigint n_bytes, count(*) n_final from documents")
def stored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Archives without compression have stored blocks alone, one of them their last."""
    return stats.block_types(archives.blocks(archives.encoded(document_bytes(spark, sf), "stored"))).select("btype", "n_bytes", "n_final")


@query(f"select cast(doc_id as varchar) path, (ceil({BYTES} / 65280.0) + 1)::bigint n_blocks, {BYTES}::bigint decoded_size from documents")
def bgzf_blocks(spark: SparkSession, sf: str) -> DataFrame:
    m = archives.members(document_blobs(spark, sf, "bgzf")).where("metadata['bgzf_block_size'] * 8 = end_bits - header_bits")
    return m.groupBy("path").agg(F.count("*").alias("n_blocks"), F.sum("decoded_size").alias("decoded_size"))


@query(f"""select (doc_id // 100)::bigint as name, (row_number() over w - 1)::int member_no, coalesce(sum({BYTES}) over (w rows between unbounded preceding and 1 preceding), 0)::bigint decoded_offset,
{BYTES}::bigint decoded_size from documents window w as (partition by doc_id // 100 order by doc_id)""")
def member_offsets(spark: SparkSession, sf: str) -> DataFrame:
    files = archive_files(document_bytes(spark, sf), F.floor(F.col("doc_id") / 100), "doc_id", "members", "members")
    return archives.members(_contents(files)).join(files, "path").select(F.col("name").cast("long").alias("name"), "member_no", "decoded_offset", "decoded_size")


def _contents(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([read_range(path, 0, n)], pa.binary())})

    return files.select("path", "length").mapInArrow(run, "path string, content binary")


@query("select (doc_id // 100)::bigint as name, true crc_equal, sum(" + BYTES + ")::bigint size from documents group by 1")
def crc_combine(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_bytes(spark, sf).select(F.floor(F.col("doc_id") / 100).alias("name"), "doc_id", "data")
    parts = rows.select("name", "doc_id", F.crc32("data").alias("crc32"), F.octet_length("data").alias("size"))
    whole = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("doc_id", "data"))).alias("l"))  # 100 documents at most
    whole = whole.select("name", F.crc32(F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["data"]))).alias("c"))
    return crc.folded_crc(parts, ["name"], "doc_id").join(whole, "name").select("name", (F.col("crc32") == F.col("c")).alias("crc_equal"), "size")


# Offsets, lookups, ordered computations.

OFFSETS = f"(select doc_id, source, {BYTES}::bigint size, {NEWLINES}::bigint lines, coalesce(sum({BYTES}) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint decoded_offset from documents)"


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("size"), scalars.newline_count(F.coalesce("text", F.lit(""))).alias("lines"))
    return checkpoints.two_level_offsets(d, "doc_id", "size", 1000)


@query(f"select doc_id, decoded_offset, size from {OFFSETS}")
def block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _offsets(spark, sf).select("doc_id", "decoded_offset", "size")


@query(f"select doc_id, coalesce(lead(decoded_offset) over (partition by source order by doc_id), 1000000000000) - decoded_offset as decoded_size from {OFFSETS}")
def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.sizes_from_offsets(_offsets(spark, sf), ["source"], "doc_id", "decoded_offset", F.lit(10**12)).select("doc_id", "decoded_size")


@query(f"select doc_id, coalesce(lead(decoded_offset) over (partition by source order by doc_id) = decoded_offset, true) is_end from {OFFSETS}")
def end_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.end_rows(_offsets(spark, sf), ["source"], "doc_id", "decoded_offset").select("doc_id", "is_end")


@query(f"select doc_id, coalesce(sum(lines) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint line_offset from {OFFSETS}")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.with_offsets(_offsets(spark, sf), ["source"], "doc_id", "lines", "line_offset").select("doc_id", "line_offset")


ASOF = "select l.l_orderkey, l.l_linenumber, o.checkpoint from (select *, 7 * l_orderkey + l_linenumber as at from lineitem) l asof left join (select 7 * o_orderkey + 3 as checkpoint from orders) o on l.at >= o.checkpoint"


def _lookup(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    """Each line's place among the orders' checkpoints, which stand seven apart at least."""
    points = table(spark, sf, "orders").select((F.col("o_orderkey") * 7 + 3).alias("checkpoint"))
    probes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("at"))
    return checkpoints.as_of(probes, points, "at", "checkpoint", strict=strict).drop("at")


@query(ASOF)
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _lookup(spark, sf)


@query(ASOF.replace(">=", ">"))
def asof_lookup_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _lookup(spark, sf, strict=True)


@query("select l_orderkey, l_linenumber, o_custkey from lineitem left join orders on l_partkey * 40 = o_orderkey")
def encoded_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact places: most probes hit a row or none, by their keys' own gaps."""
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("at"), "o_custkey")
    probes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 40).alias("at"))
    return checkpoints.at_exactly(probes, points, ["at"]).drop("at")


@query("""with k as (select 7 * o_orderkey + 3 off, row_number() over (order by o_orderkey) - 1 i from orders), s as (select count(*) n, max(off) last from k), p as (select l_orderkey, l_linenumber, 8 * l_orderkey + l_linenumber as x from lineitem)
select l_orderkey, l_linenumber, coalesce(i, case when x > last and x % 64 = 0 then n + x // 64 - (last // 64 + 1) end)::bigint block_index from p cross join s left join k on x = off""")
def offset_to_index(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").select((F.col("o_orderkey") * 7 + 3).cast("long").alias("off"))
    probes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("at"))
    return checkpoints.index_of(probes, known, "at", "off", 64).drop("at")


SPANS = "(select 7 * o_orderkey as start, case when o_custkey % 3 > 0 then 7 * o_orderkey + o_custkey % 3 end as most from orders)"


@query(f"select l_orderkey, l_linenumber, start from (select l_orderkey, l_linenumber, 7 * l_orderkey + l_linenumber - 1 as x from lineitem) left join {SPANS} on x between start and coalesce(most, start)")
def ambiguous_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose start isn't one bit but a span, as that of a stored block after padding."""
    rest = F.col("o_custkey") % 3
    chunks = table(spark, sf, "orders").select((F.col("o_orderkey") * 7).alias("start"), F.when(rest > 0, F.col("o_orderkey") * 7 + rest).alias("most"))
    probes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("at"))
    return checkpoints.within(probes, chunks, "at", "start", "most").select("l_orderkey", "l_linenumber", "start")


@query("select l_orderkey, l_linenumber, start parent_chunk from (select l_orderkey, l_linenumber, 7 * l_orderkey + l_linenumber - 1 as x from lineitem) left join (select 7 * o_orderkey as start, 7 * o_orderkey + 2 + o_custkey % 5 as stop from orders) on x >= start and x < stop")
def split_parents(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "orders").select((F.col("o_orderkey") * 7).alias("start"), (F.col("o_orderkey") * 7 + 2 + F.col("o_custkey") % 5).alias("stop"))
    children = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("at"))
    return checkpoints.with_parent(children, parents, "at", "start", "stop").drop("at")


@query("select (l_orderkey - l_orderkey % 512)::bigint bucket, count(*) n from lineitem group by 1")
def bucket_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(scalars.bucket_start(F.col("l_orderkey"), 512).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select n_nationkey, count(*) n from nation join (select event_id lo, event_id + floor(value)::bigint hi from events where value >= 0) e
on n_nationkey * 400 <= hi and lo <= n_nationkey * 400 + 150 group by 1""")
def range_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("value >= 0").select(F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value")).alias("hi"))
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey"))  # 25 nations at any scale
    return e.join(n, scalars.ranges_intersect(F.col("n_nationkey") * 400, F.col("n_nationkey") * 400 + 150, F.col("lo"), F.col("hi"))).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("""with p as (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) > value f from events) select user_id, count(*) filter (where f) n from p group by 1""")
def unsorted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.unsorted_pairs(table(spark, sf, "events"), ["user_id"], "event_id", "value")


@query("""with v as (select distinct l_suppkey, l_orderkey k from lineitem), g as (select *, k - row_number() over (partition by l_suppkey order by k) g from v)
select l_suppkey, min(k) as first, max(k) as last, count(*) n from g group by l_suppkey, g""")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.islands(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("k")), ["l_suppkey"], "k")


@query("with v as (select l_suppkey, l_orderkey k, lag(l_orderkey) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) p from lineitem) select l_suppkey, count(*) filter (where k = p + 1) n from v group by 1")
def adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.col("l_orderkey").alias("k"))
    return checkpoints.adjacent_pairs(rows, ["l_suppkey"], "o", "k")


@query("""with i as (select user_id, event_id s, event_id + 20 + floor(abs(value))::bigint e from events where value is not null), m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) p from i),
g as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by user_id order by s, e) g from m) select user_id, min(s) as start, max(e) as stop from g group by user_id, g""")
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 20 + F.floor(F.abs("value"))).alias("stop"))
    return checkpoints.merged_intervals(rows, ["user_id"], "start", "stop")


@query("select (row_number() over (partition by user_id order by event_id) - 1)::bigint turn, user_id, event_id from events")
def interleave(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.interleaved(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""with t as (select row_number() over (partition by user_id order by event_id) turn, user_id, event_id from events) select (turn - 1)::bigint turn, user_id, event_id from t where event_id % 3 <> 0 order by turn, user_id limit 40""")
def interleave_except(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id")
    return checkpoints.interleaved_except(e, "user_id", "event_id", e.where("event_id % 3 = 0").select("event_id"), "event_id", 40)


@query(f"""with recursive c as (select source, decoded_offset off, row_number() over w rn, lead(decoded_offset) over w nxt from {OFFSETS} window w as (partition by source order by doc_id)),
r as (select source, rn, off, off kept, true keep from c where rn = 1 union all
select c.source, c.rn, c.off, case when c.nxt is null or c.nxt - r.kept > 20000 then c.off else r.kept end, c.nxt is null or c.nxt - r.kept > 20000 from r join c on c.source = r.source and c.rn = r.rn + 1)
select source, off decoded_offset from r where keep""")
def index_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.thinned(_offsets(spark, sf).where("source is not null").select("source", "decoded_offset"), ["source"], "decoded_offset", 20000)


@query(f"""with b as (select doc_id // 50 g, 8 * doc_id e, decoded_offset d from {OFFSETS}), x as (select g, min(e) e0, max(e) e1, min(d) d0, max(d) d1, floor((max(d) - min(d)) / 10000.0 + 0.5)::int n from b group by g),
ideal as (select g, i, floor(i * ((d1 - d0) / n::double))::bigint pos from x, range(1, 100000) t(i) where i < n),
inside as (select b.g, d - d0 x, max(e) e from b join x using (g) where b.e > e0 group by 1, 2),
near as (select ideal.g, inside.x, inside.e, row_number() over (partition by ideal.g, i order by abs(inside.x - pos), inside.x) r from ideal join inside using (g)),
cuts as (select distinct near.g, near.x, near.e from near join x using (g) where r = 1 and near.x > 0 and near.x < d1 - d0), stops as (select * from cuts union all select g, d1 - d0, e1 from x)
select g, row_number() over w part, coalesce(lag(s.e) over w, e0) encoded_start, s.e encoded_end, (coalesce(lag(s.x) over w, 0) + d0)::bigint decoded_start, (s.x + d0)::bigint decoded_end from stops s join x using (g) window w as (partition by g order by s.x)""")
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    b = _offsets(spark, sf).select(F.floor(F.col("doc_id") / 50).alias("g"), (F.col("doc_id") * 8).alias("e"), F.col("decoded_offset").alias("d"))
    out = checkpoints.split(b, "g", "e", "d", 10000)
    return out.withColumn("part", F.col("part").cast("long"))


@query(f"""with recursive b as (select (doc_id // 50)::bigint g, doc_id, size, row_number() over (partition by doc_id // 50 order by doc_id) rn from {OFFSETS}),
r as (select g, rn, size acc, 1::bigint part from b where rn = 1 union all select b.g, b.rn, case when r.acc >= 20000 then b.size else r.acc + b.size end, r.part + (r.acc >= 20000)::bigint from r join b on b.g = r.g and b.rn = r.rn + 1),
c as (select g, part, min(doc_id) first, count(*) n, sum(size) z, max(part) over (partition by g) parts from r join b using (g, rn) group by g, part),
m as (select g, case when part = parts and part > 1 and z < 5000 then part - 1 else part end part, first, n, z from c)
select g, part, min(first)::bigint "first", sum(n)::bigint n_blocks, sum(z)::bigint decoded_size from m group by g, part""")
def grown_parts(spark: SparkSession, sf: str) -> DataFrame:
    b = _offsets(spark, sf).select(F.floor(F.col("doc_id") / 50).alias("g"), "doc_id", "size")
    return checkpoints.grown(b, "g", "doc_id", "size", 20000)


@query(f"select source, count(*) filter (where not is_end)::bigint n from (select source, coalesce(lead(decoded_offset) over (partition by source order by doc_id) = decoded_offset, true) is_end from {OFFSETS}) group by 1")
def data_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that hold data: rows without those that only mark an end."""
    return checkpoints.end_rows(_offsets(spark, sf), ["source"], "doc_id", "decoded_offset").groupBy("source").agg(F.count_if(~F.col("is_end")).alias("n"))


# Statistics.


@query(f"select source, (floor(max(s) / 32768) * 32768)::bigint spacing from (select source, lead(decoded_offset) over (partition by source order by doc_id) - decoded_offset s from {OFFSETS}) group by 1")
def spacing(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spacing(_offsets(spark, sf), ["source"], "decoded_offset")


@query("select source, count(n_chars) n, min(n_chars) least, max(n_chars) most, sum(n_chars)::bigint total, round(avg(n_chars), 4) average, round(var_samp(n_chars), 2) variance, round(stddev_samp(n_chars), 4) deviation from documents group by 1")
def statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.statistics(table(spark, sf, "documents"), ["source"], "n_chars")
    return s.withColumns({"average": F.round("average", 4), "variance": F.round("variance", 2), "deviation": F.round("deviation", 4)})


@query(f"""with s as (select source, lead(8 * doc_id) over w - 8 * doc_id e, lead(decoded_offset) over w - decoded_offset d, lag(decoded_offset) over w > decoded_offset f, decoded_offset o from {OFFSETS} window w as (partition by source order by decoded_offset, doc_id))
select source, count(*) checkpoints, min(d) decoded_step_min, round(avg(d), 3) decoded_step_avg, max(d) decoded_step_max, count(*) filter (where f) = 0 lines_sorted, max(o) last_line from s group by 1""")
def index_analytics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _offsets(spark, sf).withColumn("e", F.col("doc_id") * 8)
    a = stats.index_analytics(rows, ["source"], "e", "decoded_offset", "decoded_offset")
    return a.select("source", "checkpoints", "decoded_step_min", F.round("decoded_step_avg", 3).alias("decoded_step_avg"), "decoded_step_max", "lines_sorted", "last_line")


@query("""with b as (select min(n_chars) lo, max(n_chars) hi, least(20, max(n_chars) - min(n_chars) + 1) k from documents), f as (select case when n_chars = hi then k - 1 else floor((n_chars - lo)::double / (hi - lo) * k) end::int bin, count(*) n from documents, b where n_chars is not null group by 1)
select r.bin::int bin, coalesce(f.n, 0)::bigint n from (select unnest(range(20)) bin) r left join f on r.bin = f.bin""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram_of(table(spark, sf, "documents"), "n_chars", 20).select("bin", "n")


@query("select l.length, coalesce(n, 0)::bigint n from (select unnest(range(259)) length) l left join (select least(l_quantity * 6, 258)::bigint length, count(*) n from lineitem group by 1) f on l.length = f.length")
def length_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.length_counts(table(spark, sf, "lineitem").select(F.least(F.col("l_quantity") * 6, F.lit(258)).alias("length")))


@query("select (count(*) - count(distinct p_type))::bigint duplicates from part")
def alphabet_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return stats.duplicates(table(spark, sf, "part"), "p_type")


@query(f"select cast(doc_id as varchar) path, {BYTES}::bigint decoded_size, 1::bigint n_final, {BYTES}::bigint symbols_size, true in_order from documents")
def analyze_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = archives.blocks(document_blobs(spark, sf))
    return b.groupBy("path").agg(F.sum("decoded_size").alias("decoded_size"), F.count_if("is_final").alias("n_final"), F.sum(F.col("literals") + F.col("copied")).alias("symbols_size"), F.bool_and(F.col("header_end_bits") > F.col("encoded_bits")).alias("in_order"))


@query()
def analyze_report(spark: SparkSession, sf: str) -> DataFrame:
    b = archives.blocks(document_blobs(spark, sf))
    return b.groupBy("btype").agg(F.count("*").alias("n"), F.sum("literals").alias("literals"), F.sum("references").alias("references"), F.sum("copied").alias("copied"), F.max("farthest").alias("farthest"), F.sum("window_symbols").alias("window_symbols"), F.round(F.avg(F.col("decoded_size") * 8 / F.col("encoded_size_bits")), 3).alias("ratio"))


@query()
def analyze_code_lengths(spark: SparkSession, sf: str) -> DataFrame:
    lengths = stats.code_lengths(archives.blocks(document_blobs(spark, sf)), "literal_lengths")
    return lengths.groupBy("length").agg(F.sum("n").alias("symbols"), F.count("*").alias("blocks"))


@query()
def bit_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bit_patterns(document_bytes(spark, sf).select("path", F.col("data").alias("content")), 8)


# Ranges.


@query("""select * from (values (0, 1::bigint, 4::bigint, false, false), (1, 2048::bigint, 1000::bigint, false, false), (2, 2::bigint, 1::bigint, true, true), (3, 40::bigint, 9223372036854775807, true, false), (4, 2147483648::bigint, 1000000000::bigint, false, false))
t(ordinal, "offset", size, offset_is_line, size_is_line)""")
def range_parse(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.ranges_frame(spark, " 4@1 ,, 1 kB@ 2 kiB,1L@2L,inf@40L, 1G@2Gi ")


EXPRESSION = "10@0, 1KiB@15KiB, 100@1, 5L@20L, 3L@100, 50@7L, 1L@0, 20KiB@9000, inf@4990L, 5@1G"


def _order_archives(spark: SparkSession, sf: str, kind: str = "gzip") -> DataFrame:
    return archive_files(order_lines(spark, sf), F.floor(F.col("o_orderkey") / 5000), "o_orderkey", kind, "orders")


RANGES = ("""with o as (select (o_orderkey // 5000)::bigint as name, o_orderkey || '|' || o_custkey || '|' || o_orderstatus || chr(10) line, row_number() over (partition by o_orderkey // 5000 order by o_orderkey) i from orders),
q as (select *, coalesce(sum(length(line)) over (partition by name order by i rows between unbounded preceding and 1 preceding), 0)::bigint pos from o),
t as (select name, string_agg(line, '' order by i) s, count(*) n, sum(length(line))::bigint z from q group by 1),
r as (select * from (values (0, 'B', 0, 'B', 10), (1, 'B', 15360, 'B', 1024), (2, 'B', 1, 'B', 100), (3, 'L', 20, 'L', 5), (4, 'B', 100, 'L', 3), (5, 'L', 7, 'B', 50), (6, 'B', 0, 'L', 1), (7, 'B', 9000, 'B', 20480), (8, 'L', 4990, 'B', 999999999), (9, 'B', 1000000000, 'B', 5)) v(ordinal, k, o, m, c)),
b as (select t.name, t.s, t.z, t.n, r.*, case when k = 'B' then o when o <= n then coalesce((select pos from q where q.name = t.name and q.i = o + 1), z) end begin_at from t, r),
f as (select *, case when k = 'L' then o else (select count(*) from q where q.name = b.name and q.pos + length(q.line) <= begin_at) end lines_before from b where begin_at is not null and begin_at < z),
g as (select *, least(z, case when m = 'B' then begin_at + c when lines_before + c >= n then z else (select pos from q where q.name = f.name and q.i = lines_before + c + 1) end) end_at from f)
select name, ordinal, begin_at "offset", (end_at - begin_at)::bigint size, md5(substr(s, (begin_at + 1)::bigint, (end_at - begin_at)::bigint)) digest from g where end_at > begin_at""")


@query(RANGES)
def read_ranges(spark: SparkSession, sf: str) -> DataFrame:
    files = _order_archives(spark, sf)
    return _ranges_of(selection.read_ranges(parallel.build_index(files, 16 << 10), _wanted(files)), files)


def _wanted(files: DataFrame) -> DataFrame:
    asked = [F.struct(F.lit(i).alias("ordinal"), F.lit(r.offset).cast("long").alias("offset"), F.lit(r.size).cast("long").alias("size"), F.lit(r.offset_is_line).alias("offset_is_line"), F.lit(r.size_is_line).alias("size_is_line")) for i, r in enumerate(ranges.parse_ranges(EXPRESSION))]
    return files.select("path", F.inline(F.array(*asked)))


def _ranges_of(parts: DataFrame, files: DataFrame) -> DataFrame:
    whole = parts.groupBy("path", "ordinal").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("l"))
    out = whole.select("path", "ordinal", F.element_at("l", 1)["at"].alias("offset"), F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("d"))
    return out.join(files, "path").select(F.col("name").cast("long").alias("name"), "ordinal", "offset", F.octet_length("d").cast("long").alias("size"), F.md5("d").alias("digest"))


@query(RANGES)
def read_ranges_bzip2(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranges of bzip2 archives, whose blocks need no history: an index without windows."""
    files = _order_archives(spark, sf, "bzip2")
    blocks = parallel.decode_bzip2(files, 16 << 10, data=False).where("decoded_size > 0").withColumnRenamed("block_no", "chunk_no")
    return _ranges_of(selection.bzip2_ranges(cut(blocks), _wanted(files)), files)


@query("""with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) a from documents)
select doc_id, case when len(a) > 3 then list_sum([octet_length(encode(x)) for x in a[1:3]])::bigint + 2 end "at" from t""")
def nth_newline(spark: SparkSession, sf: str) -> DataFrame:
    return document_bytes(spark, sf).select("doc_id", selection.nth_newline_at("data", F.lit(3)).alias("at"))


# Parallel decoding and indexes.

WHOLE = f"select (doc_id // 2000)::bigint as name, sum({BYTES})::bigint size, sum({NEWLINES})::bigint n_newlines, md5(string_agg(coalesce(text, ''), '' order by doc_id)) digest, true valid from documents group by 1"


def _document_archives(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return archive_files(document_bytes(spark, sf), F.floor(F.col("doc_id") / 2000), "doc_id", kind, "documents")


def _digest(chunks: DataFrame, files: DataFrame, order: str = "decoded_offset") -> DataFrame:
    """Whole archives again, of 2000 documents at most each."""
    whole = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order, "data"))).alias("l"), F.sum("decoded_size").alias("size"), F.sum("n_newlines").alias("n_newlines"))
    return whole.join(files, "path").select("path", F.col("name").cast("long").alias("name"), "size", "n_newlines", F.md5(F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["data"]))).alias("digest"))


def _gzip_digest(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    files = _document_archives(spark, sf, kind)
    chunks = cut(parallel.decode(files, 64 << 10))
    good = parallel.verified(chunks).groupBy("path").agg(F.bool_and("valid").alias("valid"))
    return _digest(chunks, files).join(good, "path").drop("path")


@query(WHOLE)
def parallel_gzip(spark: SparkSession, sf: str) -> DataFrame:
    return _gzip_digest(spark, sf, "gzip")


@query(WHOLE)
def parallel_gzip_members(spark: SparkSession, sf: str) -> DataFrame:
    return _gzip_digest(spark, sf, "members")


@query(WHOLE)
def parallel_bgzf(spark: SparkSession, sf: str) -> DataFrame:
    return _gzip_digest(spark, sf, "bgzf")


@query(WHOLE.replace(", true valid", ""))
def parallel_bzip2(spark: SparkSession, sf: str) -> DataFrame:
    files = _document_archives(spark, sf, "bzip2")
    return _digest(parallel.decode_bzip2(files, 64 << 10), files, "block_no").drop("path")


@query("""with d as (select (doc_id // 2000)::bigint as name, sum(octet_length(encode(coalesce(text, ''))))::bigint z, count(*) n, max(doc_id) last from documents group by 1)
select name, (z + n * 50000)::bigint size, n::bigint n_newlines, true valid, true bounded from d""")
def parallel_high_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Each document after 49,999 blanks and a line end: archives that grow manyfold come out in bounded parts."""
    rows = document_bytes(spark, sf).select("doc_id", F.encode(F.translate(F.decode("data", "UTF-8"), "\n", " "), "UTF-8").alias("data"))
    files = archive_files(rows, F.floor(F.col("doc_id") / 2000), "doc_id", "gzip", "blanks", b" " * 49_999 + b"\n")
    parts = cut(parallel.decode(files, 1 << 20).withColumn("bytes", F.octet_length("data")).drop("data"))
    good = parallel.verified(parts).groupBy("path").agg(F.bool_and("valid").alias("valid"))
    out = parts.groupBy("path").agg(F.sum("bytes").alias("size"), F.sum("n_newlines").alias("n_newlines"), (F.max("bytes") < 2 * parallel.PART + (70 << 20)).alias("bounded"))
    return out.join(good, "path").join(files, "path").select(F.col("name").cast("long").alias("name"), "size", "n_newlines", "valid", "bounded")


def _round_trip(spark: SparkSession, sf: str, kind: str, archive: str = "gzip") -> DataFrame:
    """Scan archives by an index that was exported and imported again."""
    files = _document_archives(spark, sf, archive)
    pairs = index_files.export_indexes(parallel.build_index(files, 64 << 10), kind, shared_dir(spark, "indexes"))
    index = index_files.import_indexes(pairs)
    return _digest(parallel.indexed_scan(cut(index)), files).drop("path")


INDEXED = WHOLE.replace(", true valid", "")


@query(INDEXED)
def indexed_scan_zlib(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, sf, "indexed_gzip", "zlib")


@query(INDEXED)
def indexed_scan_deflate(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, sf, "gztool-with-lines", "deflate")


@query(INDEXED)
def indexed_scan_bgzi(spark: SparkSession, sf: str) -> DataFrame:
    """BGZF archives by the index of their own tool."""
    return _round_trip(spark, sf, "bgzi", "bgzf")


@query("select sum(octet_length(encode(coalesce(text, ''))))::bigint n_bytes, md5(string_agg(coalesce(text, ''), '' order by doc_id)) digest, true same from documents where doc_id // 2000 = 0")
def source_and_sink(spark: SparkSession, sf: str) -> DataFrame:
    """An archive read in chunks through the data source, and written back through it, each chunk at its place."""
    datasource.register(spark)
    files = _document_archives(spark, sf, "gzip").where("name = '0'")
    pairs = index_files.export_indexes(parallel.build_index(files, 64 << 10), "indexed_gzip", shared_dir(spark, "indexes")).first()
    if pairs is None:
        return spark.createDataFrame([], "n_bytes long, digest string, same boolean")
    chunks = spark.read.format("bytelake").option("path", pairs["path"]).option("index", pairs["index_path"]).load()
    chunks.select("decoded_offset", "data").write.format("bytelake").mode("append").save(target := f"{shared_dir(spark, 'sink')}/whole.txt")
    n = chunks.agg(F.sum("decoded_size").alias("n")).first()["n"]
    back = contents(spark, target).select(F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))
    return back.withColumn("same", F.col("n_bytes") == n)


@query(INDEXED)
def indexed_scan_indexed_gzip(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, sf, "indexed_gzip")


@query(INDEXED)
def indexed_scan_gztool(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, sf, "gztool-with-lines", "members")


@query(f"select (doc_id // 2000)::bigint as name, sum({BYTES})::bigint n_bytes, sum({NEWLINES})::bigint n_newlines, true lines_equal from documents group by 1")
def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Counts answered from an index, and lines gathered after an import without them equal those that were exported."""
    files = _document_archives(spark, sf, "gzip")
    index = parallel.build_index(files, 64 << 10)
    bare = cut(index_files.import_indexes(index_files.export_indexes(index, "indexed_gzip", shared_dir(spark, "indexes"))))
    again = index_files.with_lines(bare).select("path", "chunk_no", F.col("line_offset").alias("again"))
    equal = index.join(again, ["path", "chunk_no"]).groupBy("path").agg(F.bool_and(F.col("line_offset") == F.col("again")).alias("lines_equal"))
    return selection.total_bytes(index).join(selection.total_newlines(index), "path").join(equal, "path").join(files, "path").select(F.col("name").cast("long").alias("name"), "n_bytes", "n_newlines", "lines_equal")


@query("select (doc_id // 2000)::bigint as name, true same, true packs from documents group by 1")
def packed_windows(spark: SparkSession, sf: str) -> DataFrame:
    files = _document_archives(spark, sf, "gzip")
    index = parallel.build_index(files, 64 << 10)
    packed = cut(index_files.packed_windows(index))
    back = index_files.unpacked_windows(packed).select("path", "chunk_no", F.col("window").alias("back"))
    rows = index.join(back, ["path", "chunk_no"]).join(packed.select("path", "chunk_no", F.col("window").alias("packed")), ["path", "chunk_no"])
    found = rows.groupBy("path").agg(F.bool_and(F.col("back") == F.col("window")).alias("same"), (F.sum(F.octet_length("packed")) <= F.sum(F.octet_length("window"))).alias("packs"))
    return found.join(files, "path").select(F.col("name").cast("long").alias("name"), "same", "packs")


@query("select (doc_id // 2000)::bigint as name, 0::bigint wrong, true found_wrong from documents group by 1")
def checked_bzip2_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every found start of a bzip2 block is one; a bit further there is none."""
    files = _document_archives(spark, sf, "bzip2")
    starts = cut(parallel.bzip2_starts(files, 64 << 10))
    good = parallel.checked_offsets(starts.select("path", "start_bits")).groupBy("path").agg(F.count_if(~F.col("valid")).alias("wrong"))
    bad = parallel.checked_offsets(starts.select("path", (F.col("start_bits") + 1).alias("start_bits"))).groupBy("path").agg(F.bool_and(~F.col("valid")).alias("found_wrong"))
    return good.join(bad, "path").join(files, "path").select(F.col("name").cast("long").alias("name"), "wrong", "found_wrong")


# Scalars.


@query("select o_orderkey, (o_orderkey // 8) || ' B ' || (o_orderkey % 8) || ' b' bits from orders")
def format_bits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scalars.format_bits(F.col("o_orderkey")).alias("bits"))


@query("""select o_orderkey, case when v = 0 then '0 B' else concat_ws(' ', case when v // 1073741824 % 1024 > 0 then (v // 1073741824 % 1024) || ' GiB' end, case when v // 1048576 % 1024 > 0 then (v // 1048576 % 1024) || ' MiB' end,
case when v // 1024 % 1024 > 0 then (v // 1024 % 1024) || ' KiB' end, case when v % 1024 > 0 then (v % 1024) || ' B' end) end size from (select o_orderkey, o_orderkey * 65536 v from orders)""")
def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scalars.format_bytes(F.col("o_orderkey") * 65536).alias("size"))


@query("""select p_partkey, array_to_string(case when a[-1] = '' then a[1:len(a)-1] else a end, '~') fields, len(case when a[-1] = '' then a[1:len(a)-1] else a end)::int n, regexp_full_match(p_type, '[0-9A-Za-z+/]*') base64,
starts_with(lower(p_type), 'sta') starts, ends_with(p_type, 'R') ends from (select *, string_split(p_type || ' ' || case when p_partkey % 2 = 0 then '' else 'x ' end, ' ') a from part)""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_type", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x "))
    fields = scalars.split_fields(text, " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(fields, "~").alias("fields"), F.size(fields).alias("n"), scalars.is_base64(F.col("p_type")).alias("base64"), scalars.starts_with(F.col("p_type"), F.lit("STA"), False).alias("starts"), scalars.ends_with(F.col("p_type"), F.lit("R")).alias("ends"))


@query("""select o_orderkey, ((o_orderkey + 6) // 7)::bigint ceil_div, abs(o_orderkey - o_custkey)::bigint diff, list_sum([((o_orderkey >> i) & 1) << (15 - i) for i in range(16)])::bigint reversed,
(((o_orderkey & 255) << 8) | ((o_orderkey >> 8) & 255))::bigint swapped, ((1 << (o_orderkey % 20)::int) - 1)::bigint mask, (case when o_orderkey <= 1 then 0 else length(ltrim(bin(o_orderkey - 1), '0')) end)::int bits, 9223372036854775807 saturated from orders""")
def integer_functions(spark: SparkSession, sf: str) -> DataFrame:
    k, high = F.col("o_orderkey"), F.lit((1 << 63) - 1)
    return table(spark, sf, "orders").select("o_orderkey", scalars.ceil_div(k, F.lit(7)).alias("ceil_div"), scalars.abs_diff(k, F.col("o_custkey")).cast("long").alias("diff"), scalars.reverse_bits(k, 16).alias("reversed"), scalars.byte_swap(k, 2).alias("swapped"), scalars.low_mask(k % 20).alias("mask"), scalars.bits_required(k).alias("bits"), scalars.saturating_add(high - 1, k + 1).alias("saturated"))


@query(f"select doc_id, true same, {BYTES}::bigint varint from documents")
def run_length_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_bytes(spark, sf).withColumn("n", F.octet_length("data").cast("long"))
    return rows.select("doc_id", (coding.rle_decoded(coding.rle_encoded("data")) == F.col("data")).alias("same"), coding.from_varint(coding.varint("n")).alias("varint"))


# Access logs and streams.


@query("select user_id, event_id, event_id + 1 as first, event_id + 4 as last from events")
def prefetch_fixed(spark: SparkSession, sf: str) -> DataFrame:
    n = access.next_fixed(F.col("event_id"), F.lit(4))
    return table(spark, sf, "events").select("user_id", "event_id", F.element_at(n, 1).alias("first"), F.element_at(n, -1).alias("last"))


@query("""with h as (select event_id, user_id a, lag(user_id) over w b, lag(user_id, 2) over w c from events window w as (partition by event_id % 64 order by event_id))
select event_id, (case when b is null then 8 when c is null then case when a = b then 8 when a = b + 1 then 8 else 0 end
when a = b then case when b = c then 8 when b = c + 1 then 8 else 0 end when b = c then case when a = b + 1 then 8 else 0 end
when a = b + 1 and b = c + 1 then 8 when a = b + 1 then 4 when b = c + 1 then 1 else 0 end)::int n from h""")
def prefetch_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.col("event_id") % 64).orderBy("event_id")
    history = F.array_compact(F.array(F.col("user_id"), F.lag("user_id", 1).over(w), F.lag("user_id", 2).over(w)))
    return table(spark, sf, "events").select("event_id", F.size(access.adaptive_udf(history, F.lit(8))).alias("n"))


@query(f"select count(*) n_archives, sum({BYTES})::bigint n_bytes, sum({NEWLINES})::bigint n_newlines from documents")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of single documents, bundled: a member each, counted as they arrive."""
    at = shared_dir(spark, "stream")
    files = archive_files(document_bytes(spark, sf), F.floor(F.col("doc_id") / 500), "doc_id", "members", "stream")
    folder = files.first()["path"].rpartition("/")[0] if files.take(1) else f"{at}/none"
    members = streams.member_stream(streams.arriving(spark, f"{folder}/*.members")).select("path", "member_no", "decoded_size")
    streams.run_available(members, f"{at}/members", f"{at}/checkpoint")
    found = spark.read.parquet(f"{at}/members").select(F.lit(1).alias("n_archives"), F.col("decoded_size").alias("n_bytes"), F.lit(0).cast("long").alias("n_newlines"))
    lines = archives.counts(_contents(files)).select(F.lit(0).alias("n_archives"), F.lit(0).cast("long").alias("n_bytes"), "n_newlines")
    return found.unionByName(lines).agg(*[F.sum(c).alias(c) for c in found.columns])
