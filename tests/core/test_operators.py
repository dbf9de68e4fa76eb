"""Operators on archives against plain Python on the plain bytes."""

import bz2
import gzip
import io
import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake import api, cli
from bytelake.functions import access, deflate, formats, scalars
from bytelake.functions.ranges import parse_ranges
from bytelake.operators import archives, checkpoints, parallel, selection, stats
from bytelake.plans import fixtures
from bytelake.sources import datasource, files, index_files
from bytelake.streaming import archives as streams
from tests.core.test_functions import prose

ROOT = Path(__file__).resolve().parents[2]


def written(spark, folder, named):
    rows = []
    for name, data in named.items():
        (folder / name).write_bytes(data)
        rows.append((f"file://{folder}/{name}", len(data)))
    return spark.createDataFrame(rows, "path string, length long")


def by_path(rows, key, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r[key])):
        out[r["path"].rpartition("/")[2]] = out.get(r["path"].rpartition("/")[2], b"") + bytes(r[value])
    return out


PLAIN = {
    "text.gz": prose(900_000, 1), "members.gz": prose(400_000, 2), "random.gz": np.random.default_rng(0).bytes(500_000), "tiny.gz": b"A", "empty.gz": b"", "zeros.gz": bytes(3_000_000),
    "blocks.bgz": prose(500_000, 3), "raw.deflate": prose(600_000, 4), "a.zlib": prose(600_000, 5), "mixed.gz": prose(200_000, 6) + np.random.default_rng(1).bytes(150_000) + prose(200_000, 7), "garbage.gz": prose(300_000, 8),
}


def packed():
    out = {k: gzip.compress(v, 6, mtime=0) for k, v in PLAIN.items()}
    m = PLAIN["members.gz"]
    out["members.gz"] = b"".join(formats.gzip_member(m[a : a + 37_000], name=f"part{a}") for a in range(0, len(m), 37_000))
    out["blocks.bgz"] = formats.bgzf(PLAIN["blocks.bgz"])
    out["raw.deflate"], out["a.zlib"] = zlib.compress(PLAIN["raw.deflate"], 6, -15), zlib.compress(PLAIN["a.zlib"])
    out["garbage.gz"] += bytes(500)
    return out


@pytest.fixture(scope="module")
def packs(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("packs"), packed())


@pytest.fixture(scope="module")
def index(packs):
    return parallel.build_index(packs, 32 << 10)


def test_parallel_decoding(spark, packs):
    got = parallel.decode(packs, 32 << 10).collect()
    assert by_path(got, "decoded_offset", "data") == PLAIN
    assert sum(r["n_newlines"] for r in got) == sum(v.count(b"\n") for v in PLAIN.values())
    assert len([r for r in got if r["path"].endswith("text.gz")]) > 5
    ok = parallel.verified(files.cut(parallel.decode(packs, 48 << 10, data=False))).collect()
    assert all(r["valid"] for r in ok) and len([r for r in ok if r["path"].endswith("members.gz")]) == 11


def test_damage_is_noticed(spark, tmp_path):
    raw = bytearray(gzip.compress(PLAIN["text.gz"]))
    raw[-7] ^= 1
    damaged = written(spark, tmp_path, {"a.gz": bytes(raw)})
    chunks = files.cut(parallel.decode(damaged, 32 << 10, data=False))
    assert [r["valid"] for r in parallel.verified(chunks, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="differs"):
        parallel.verified(chunks).collect()
    short = written(spark, tmp_path, {"b.gz": gzip.compress(PLAIN["text.gz"])[:-5000]})
    with pytest.raises(Exception):
        parallel.decode(short, 32 << 10).collect()


def test_external_checksums(spark, packs):
    chunks = files.cut(parallel.decode(packs.where("path like '%.deflate'"), 32 << 10, data=False))
    path = chunks.first()["path"]
    for crc, want in ((zlib.crc32(PLAIN["raw.deflate"]), True), (5, False)):
        given = spark.createDataFrame([(path, crc)], "path string, crc32 long")
        assert [r["valid"] for r in parallel.verified_against(chunks, given).collect()] == [want]


def test_false_starts_are_dropped(spark, packs, monkeypatch):
    """Starts that aren't any, among real ones, cost a round and nothing else."""
    find = parallel.deflate.find_start
    wrong = lambda data, a, b: (find(data, a, b) or a) + 3 if len(data) % 2 else find(data, a, b)
    monkeypatch.setattr(parallel.deflate, "find_start", wrong)
    one = packs.where("path like '%text.gz'")
    assert by_path(parallel.decode(one, 33_333).collect(), "chunk_no", "data") == {"text.gz": PLAIN["text.gz"]}


def test_archives_within_stored_blocks(spark, tmp_path):
    """Starts that decode without an error and that no block has: archives in an archive that stores them as they are."""
    plain = b"".join(gzip.compress(prose(30_000 + 500 * k, k), 6, mtime=0) for k in range(40)) + prose(300_000, 99)
    both = {"stored.gz": gzip.compress(plain, 0, mtime=0), "two.gz": gzip.compress(plain[: 1 << 19], 1, mtime=0) * 2}
    got = files.cut(parallel.decode(written(spark, tmp_path, both), 32 << 10))
    assert by_path(got.collect(), "chunk_no", "data") == {"stored.gz": plain, "two.gz": plain[: 1 << 19] * 2}
    assert all(r["valid"] for r in parallel.verified(got).collect())


def test_a_start_is_met():
    data = prose(400_000, 5)
    raw = zlib.compress(data, 6, -15)
    starts = [b.start for b in deflate.walk(raw)]
    assert all(deflate.lead(raw[: -(-b // 8)], a, b, False).meets for a, b in zip(starts, starts[1:]))
    wrong = [starts[2] + k for k in (*range(-40, 0), *range(1, 40), 1000, 5003)]
    assert not any(deflate.lead(raw[: -(-b // 8)], starts[1], b, False).meets for b in wrong)


def test_parallel_bzip2(spark, tmp_path):
    plain = {"a.bz2": prose(900_000, 9), "two.bz2": prose(300_000, 10) * 2, "empty.bz2": b"", "runs.bz2": b"".join(bytes([65 + i % 2]) * i for i in range(1, 800))}
    packed = {k: bz2.compress(v, 1) for k, v in plain.items()} | {"two.bz2": bz2.compress(prose(300_000, 10), 1) * 2}
    packs = written(spark, tmp_path, packed)
    got, counted = parallel.decode_bzip2(packs, 20_000).collect(), parallel.decode_bzip2(packs, 20_000, data=False).collect()
    assert by_path(got, "block_no", "data") == plain
    for k, v in plain.items():
        rows = sorted((r for r in counted if r["path"].endswith(f"/{k}")), key=lambda r: r["block_no"])
        assert rows[-1]["decoded_size"] == 0 and rows[-1]["decoded_offset"] == len(v) and rows[-1]["line_offset"] == v.count(b"\n")


def test_chance_magic_within_a_bzip2_block(spark, tmp_path, monkeypatch):
    """Starts of blocks that aren't any are left out; damage isn't."""
    plain = prose(600_000, 11)
    raw = bz2.compress(plain, 1)
    find = parallel.magic_bits
    monkeypatch.setattr(parallel, "magic_bits", lambda data, magic: sorted([*find(data, magic), *([x + 1000 for x in find(data, magic)] if magic == parallel.BZIP2_BLOCK else [])]))
    packs = written(spark, tmp_path, {"a.bz2": raw})
    assert by_path(parallel.decode_bzip2(packs, 20_000).collect(), "block_no", "data") == {"a.bz2": plain}
    f = api.open(tmp_path / "a.bz2", spark, chunk_size=32 << 10)
    assert f.size() == len(plain) and b"".join(f.read_ranges("50@150000,2L@7L")) == b"".join(slices(plain, "50@150000,2L@7L"))
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 255
    with pytest.raises(Exception, match="can't be decoded"):
        parallel.decode_bzip2(written(spark, tmp_path, {"b.bz2": bytes(broken)}), 20_000).collect()


def test_bzip2_line_ranges(spark, tmp_path):
    for k, plain in enumerate((b"\nabc\ndef\n", prose(400_000, 13))):
        (tmp_path / f"{k}.bz2").write_bytes(bz2.compress(plain, 1))
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(plain))
        b, g = (api.open(tmp_path / f"{k}.{e}", spark, chunk_size=32 << 10) for e in ("bz2", "gz"))
        given = api.open(tmp_path / f"{k}.bz2", spark)
        given.set_block_offsets(b.block_offsets())
        expression = "1L@0,1L@1L,2L@1,inf@2L,1L@5,3L@100L,1@1L"
        want = [x for x in slices(plain, expression) if x]
        for f in (b, g, given) if k else (b, given):
            assert b"".join(f.read_ranges(expression)) == b"".join(want), k


def test_indexes_of_streams_without_footers(spark, packs, index, tmp_path):
    for name in ("a.zlib", "raw.deflate", "blocks.bgz"):
        own = index.where(F.col("path").endswith(name))
        pairs = index_files.export_indexes(own, "indexed_gzip", f"file://{tmp_path}")
        assert by_path(parallel.indexed_scan(files.cut(index_files.import_indexes(pairs))).collect(), "decoded_offset", "data") == {name: PLAIN[name]}
        datasource.register(spark)
        row = pairs.first()
        got = spark.read.format("bytelake").option("path", row["path"]).option("index", row["index_path"]).load().collect()
        assert by_path([{"path": name} | r.asDict() for r in got], "decoded_offset", "data") == {name: PLAIN[name]}
    with pytest.raises(ValueError, match="order"):
        index_files.ascending([index_files.Checkpoint(80, 10, b"", None), index_files.Checkpoint(80, 20, b"", None)])


def slices(data, expression):
    out = []
    ends = [0] + [i + 1 for i, b in enumerate(data) if b == 10]
    for r in parse_ranges(expression):
        if r.offset_is_line and r.offset >= len(ends):
            continue
        start = ends[r.offset] if r.offset_is_line else r.offset
        if r.size_is_line:
            before = data[:start].count(b"\n")
            stop = ends[before + r.size] if before + r.size < len(ends) else len(data)
        else:
            stop = start + r.size
        out.append(data[start:stop])
    return out


def test_ranges(spark, packs, index):
    r = random.Random(4)
    items = ["10@0", "1KiB@15KiB", "5L@20L", "inf@40L", "inf@0", "1@1G", "0@5", "3L@100", "100@3L", "2L@0", "5L@100000L"]
    items += [f"{r.randrange(100_000)}{r.choice(['', 'L'])}@{r.randrange(400_000) if k % 2 else f'{r.randrange(9000)}L'}" for k in range(12)]
    expression = ",".join(items)
    some = [n for n in PLAIN if n in ("text.gz", "members.gz", "mixed.gz", "empty.gz", "zeros.gz", "blocks.bgz")]
    ranges = [(p["path"], i, *x) for p in packs.collect() if p["path"].rpartition("/")[2] in some for i, x in enumerate(parse_ranges(expression))]
    got = {}
    rows = selection.read_ranges(index, spark.createDataFrame(ranges, "path string, ordinal int, offset long, size long, offset_is_line boolean, size_is_line boolean")).collect()
    for x in sorted(rows, key=lambda x: (x["path"], x["ordinal"], x["at"])):
        key = x["path"].rpartition("/")[2], x["ordinal"]
        got[key] = got.get(key, b"") + bytes(x["data"])
    for name in some:
        wanted = [slices(PLAIN[name], e) for e in expression.split(",")]
        assert {i: w[0] for i, w in enumerate(wanted) if w and w[0]} == {i: d for (n, i), d in got.items() if n == name}


def test_counts_from_an_index(index):
    assert {r["path"].rpartition("/")[2]: r["n_bytes"] for r in selection.total_bytes(index).collect()} == {k: len(v) for k, v in PLAIN.items()}
    assert {r["path"].rpartition("/")[2]: r["n_newlines"] for r in selection.total_newlines(index).collect()} == {k: v.count(b"\n") for k, v in PLAIN.items()}


@pytest.mark.parametrize("kind", ["indexed_gzip", "gztool", "gztool-with-lines"])
def test_indexes_round_trip(spark, index, kind, tmp_path):
    some = index.where("path like '%.gz'")
    pairs = index_files.export_indexes(some, kind, f"file://{tmp_path}")
    again = files.cut(index_files.import_indexes(pairs))
    got = parallel.indexed_scan(again).collect()
    assert by_path(got, "chunk_no", "data") == {k: v for k, v in PLAIN.items() if k.endswith(".gz")}
    offsets = {r["path"]: r["offsets"] for r in index_files.block_offsets(again).collect()}
    assert offsets == {r["path"]: r["offsets"] for r in index_files.block_offsets(some).collect()}
    lines = {(r["path"], r["chunk_no"]): r["line_offset"] for r in index_files.with_lines(again).collect()}
    assert lines == {(r["path"], r["chunk_no"]): r["line_offset"] for r in some.collect()}


def test_index_of_bgzf(spark, packs, index, tmp_path):
    one = index.where("path like '%.bgz'")
    pairs = index_files.export_indexes(one, "bgzi", f"file://{tmp_path}")
    again = files.cut(index_files.import_indexes(pairs))
    assert by_path(parallel.indexed_scan(again).collect(), "chunk_no", "data") == {"blocks.bgz": PLAIN["blocks.bgz"]}


def test_sparse_windows_are_enough(spark, packs, index):
    got = parallel.indexed_scan(index)
    assert by_path(got.collect(), "chunk_no", "data") == PLAIN
    full = parallel.build_index(packs.where("path like '%text.gz'"), 32 << 10, thin=False)
    zeros = lambda df: sum(bytes(r["window"]).count(0) for r in df.collect())
    assert zeros(index.where("path like '%text.gz'")) > zeros(full)


def test_rows(spark):
    named = packed() | {"b.bz2": bz2.compress(b"x\ny"), "none": b"\x07 nothing"}
    blobs = files.blobs(spark, named).unionByName(spark.createDataFrame([("null", None)], "path string, content binary"))
    types = {r["path"]: r["file_type"] for r in archives.file_types(blobs).collect()}
    assert types == {k: "BGZF" if k.endswith("bgz") else "ZLIB" if k.endswith("zlib") else "DEFLATE" if k.endswith("deflate") else "BZIP2" if k.endswith("bz2") else "NONE" if k in ("none", "null") else "GZIP" for k in [*named, "null"]}
    counted = {r["path"]: (r["n_bytes"], r["n_newlines"]) for r in archives.counts(blobs.where("path not in ('none')")).collect()}
    assert counted == {k: (len(v), v.count(b"\n")) for k, v in PLAIN.items()} | {"b.bz2": (3, 1)}
    m = archives.members(blobs.where("path like '%.gz'")).where("path = 'members.gz'").orderBy("member_no").collect()
    assert [r["file_name"] for r in m] == [f"part{a}" for a in range(0, 400_000, 37_000)] and m[3]["decoded_offset"] == 111_000
    assert archives.members(blobs.limit(0)).count() == 0
    b = archives.blocks(blobs.where("path in ('text.gz', 'tiny.gz', 'random.gz')"))
    assert {r["path"]: r["s"] for r in b.groupBy("path").agg(F.sum("decoded_size").alias("s")).collect()} == {k: len(PLAIN[k]) for k in ("text.gz", "tiny.gz", "random.gz")}
    reads = stats.window_reads(b).where("path = 'text.gz'").collect()
    assert reads and all(0 <= r["start"] < r["end"] <= 32768 for r in reads)


def test_members_report_damage(spark):
    raw = bytearray(gzip.compress(b"hello world"))
    raw[-1] ^= 1
    blobs = files.blobs(spark, {"a": bytes(raw)})
    assert [r["valid"] for r in archives.members(blobs, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="checksum"):
        archives.members(blobs).collect()


def test_bit_patterns(spark):
    data = np.random.default_rng(2).bytes(300)
    bits = "".join(f"{b:08b}" for b in data)
    for width in (1, 5, 8, 13):
        want = {}
        for i in range(len(bits) - width + 1):
            want[int(bits[i : i + width], 2)] = want.get(int(bits[i : i + width], 2), 0) + 1
        assert {r["pattern"]: r["n"] for r in stats.bit_patterns(files.blobs(spark, {"a": data}), width).collect()} == want


def test_as_of_without_keys_over_ties(spark):
    r = random.Random(6)
    points, probes = sorted({r.randrange(1000) for _ in range(60)}), [r.randrange(-5, 1100) for _ in range(300)]
    p = spark.createDataFrame([(x, f"c{x}") for x in points], "at long, name string")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(probes)], "id long, x long")
    for strict in (False, True):
        got = {r["id"]: r["at"] for r in checkpoints.as_of(q, p, "x", "at", strict=strict).collect()}
        assert got == {i: max((c for c in points if c < x or c == x and not strict), default=None) for i, x in enumerate(probes)}
    assert checkpoints.as_of(q.limit(0), p, "x", "at").count() == 0 and checkpoints.as_of(q, p.limit(0), "x", "at").where("at is null").count() == 300


def test_thinning(spark):
    r = random.Random(7)
    rows = [(k, x) for k in "abc" for x in sorted(r.sample(range(10_000), 200))] + [("one", 5)]
    got = {}
    for x in checkpoints.thinned(spark.createDataFrame(rows, "k string, x long"), ["k"], "x", 300).collect():
        got.setdefault(x["k"], []).append(x["x"])
    for k in ("a", "b", "c", "one"):
        own, kept = [x for n, x in rows if n == k], []
        for i, x in enumerate(own):
            if not kept or i == len(own) - 1 or own[i + 1] - kept[-1] > 300:
                kept.append(x)
        assert sorted(got[k]) == kept


def test_islands(spark):
    """Equal values count once, nulls are a run; no table of values or runs is made for it."""
    rng = random.Random(4)
    values = [(k, rng.choice([None, *range(60)])) for k in range(6) for _ in range(50)] + [(None, 3), (None, 4), (9, None), (9, None)]
    rows = spark.createDataFrame(values, "k long, v long")
    want = []
    for k, v in sorted(set(values), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        if want and want[-1][0] == k and v is not None and want[-1][2] == v - 1:
            want[-1][2:] = [v, want[-1][3] + 1]
        else:
            want.append([k, v, v, 1])
    found = checkpoints.islands(rows, ["k"], "v")
    assert sorted(map(str, (list(r) for r in found.collect()))) == sorted(map(str, want))
    assert "Aggregate" not in found._jdf.queryExecution().toString()


def test_matches_of_blocks_take_little_memory():
    raw = gzip.compress(prose(600_000, 3))
    tracemalloc.start()
    rows = list(archives._blocks("a", raw))
    batch = archives._block_batch(rows)
    peak, n = tracemalloc.get_traced_memory()[1], sum(len(r[-1]) // 3 for r in rows)
    tracemalloc.stop()
    assert n > 50_000 and peak < 300 * n
    assert batch.column("matches").to_pylist() == [[{"place": p, "length": n, "distance": d} for p, n, d in zip(*(r[-1][k::3] for k in range(3)))] for r in rows]


def test_a_walk_ends_with_the_data():
    raw = zlib.compress(bytes(range(97, 123)) * 9 + b"e" * 9 + prose(60_000, 3), 6, -15)
    for n in range(200, len(raw), 997):
        with pytest.raises(deflate.Corrupt):
            list(deflate.walk(raw[:n]))


def test_archives_of_rows(spark, sf_dir):
    """Rows after what goes ahead of each, which doesn't go through a shuffle; texts go to Python in small batches."""
    spark.conf.unset(fixtures.BATCH_KEY)
    texts = fixtures.document_bytes(spark, sf_dir).limit(50).cache()
    assert spark.conf.get(fixtures.BATCH_KEY) == str(fixtures.BATCH_BYTES)
    want = b"".join(b"ahead\n" + bytes(r["data"]) for r in texts.orderBy("doc_id").collect())
    for kind in ("gzip", "members", "bgzf", "zlib"):
        made = fixtures.archive_files(texts, F.lit(0), "doc_id", kind, "rows", b"ahead\n").first()
        got = files.read_range(made["path"], 0, made["length"] + 1)
        assert len(got) == made["length"] and archives.decode_bytes(got) == want


def test_histograms(spark):
    values = [1, 1, 2, 5, 9, 10, 10, 11, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    h = stats.histogram(df, "v", 1, 10, 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 1, 0, 3]
    assert stats.plotted(stats.histogram(df, "v", 1, 10, 4)).orderBy("bin").first()["bar"] == "=" * 20
    assert stats.histogram_of(df, "v", 50).count() == 11 and stats.histogram_of(df.limit(0), "v", 5).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(scalars.format_bytes(F.lit(1024 * 1024 + 5)).alias("a"), scalars.format_bytes(F.lit(0)).alias("b"), scalars.format_bits(F.lit(17)).alias("c"), scalars.saturating_add(F.lit(-(1 << 63) + 5), F.lit(-9)).alias("d"), scalars.saturating_add(F.lit((1 << 63) - 5), F.lit(3)).alias("e"), scalars.is_base64(F.lit("ab+/\n")).alias("f"), scalars.is_base64(F.lit("a=")).alias("g"), scalars.split_fields(F.lit("a..b."), ".").alias("h"), scalars.reverse_bits(F.lit(0b1101), 4).alias("i"), scalars.byte_swap(F.lit(0x0102), 2).alias("j"), scalars.extra_flags_name(F.lit(7)).alias("k"), scalars.has_crc32(F.lit("ZLIB")).alias("l"), access.next_fixed(F.lit(4), F.lit(2)).alias("m")).first()
    assert tuple(row) == ("1 MiB 5 B", "0 B", "2 B 1 b", -(1 << 63), (1 << 63) - 2, True, False, ["a", "", "b"], 0b1011, 0x0201, "undefined (7)", False, [5, 6])


def test_data_source(spark, packs, index, tmp_path):
    datasource.register(spark)
    path = packs.where("path like '%text.gz'").first()["path"]
    at = index_files.export_indexes(index.where("path like '%text.gz'"), "indexed_gzip", f"file://{tmp_path}").first()["index_path"]
    plain = spark.read.format("bytelake").option("path", path).load()
    chunked = spark.read.format("bytelake").option("path", path).option("index", at).load()
    for df in (plain, chunked):
        rows = sorted(df.collect(), key=lambda r: r["decoded_offset"])
        assert b"".join(bytes(r["data"]) for r in rows) == PLAIN["text.gz"]
    assert chunked.rdd.getNumPartitions() > 5
    only = spark.read.format("bytelake").option("path", path).option("index", at).option("count_only", "true").load()
    assert only.columns == ["chunk_no", "decoded_offset", "decoded_size", "n_newlines"] and only.agg(F.sum("n_newlines")).first()[0] == PLAIN["text.gz"].count(b"\n")
    target = f"file://{tmp_path}/out.txt"
    chunked.select("decoded_offset", "data").repartition(7).write.format("bytelake").mode("append").save(target)
    assert (tmp_path / "out.txt").read_bytes() == PLAIN["text.gz"] and not list(tmp_path.glob("*.parts"))
    with pytest.raises(Exception, match="there already"):
        chunked.select("decoded_offset", "data").write.format("bytelake").mode("append").save(target)


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / f"in/{k}.gz").write_bytes(gzip.compress(b"line\n" * k))
    out = lambda: streams.count_stream(streams.arriving(spark, str(tmp_path / "in"), 2))
    streams.run_available(out(), str(tmp_path / "out"), str(tmp_path / "at"))
    (tmp_path / "in/late.gz").write_bytes(gzip.compress(b"late\n"))
    streams.run_available(out(), str(tmp_path / "out"), str(tmp_path / "at"))
    assert sorted(r["n_newlines"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 1, 2, 3, 4]
    assert streams.windowed_sizes(streams.arriving(spark, str(tmp_path / "in"))).isStreaming


def test_file_view(spark, tmp_path):
    data = PLAIN["text.gz"]
    (tmp_path / "a.gz").write_bytes(gzip.compress(data))
    f = api.open(tmp_path / "a.gz", spark, chunk_size=64 << 10)
    assert f.file_type() == "GZIP" and not f.block_offsets_complete() and f.available_block_offsets() == {}
    assert f.read(10) == data[:10] and f.tell() == 10 and f.peek(5) == data[10:15] and f.tell() == 10
    assert f.seek(-20, io.SEEK_END) == len(data) - 20 and f.read() == data[-20:] and f.read(5) == b"" and f.tell_compressed() == 8 * f.length
    assert f.seek(-5) == 0 and f.seek(1 << 60) == len(data) and f.seek(100) == 100 and f.seek(5, io.SEEK_CUR) == 105
    buffer = bytearray(7)
    assert f.readinto(buffer) == 7 and buffer == data[105:112] and f.size() == len(data) and f.count_lines() == data.count(b"\n") and f.test()
    offsets = f.block_offsets()
    assert offsets[80] == 0 and offsets[8 * f.length] == len(data)
    f.export_index(str(tmp_path / "a.index"), "gztool-with-lines")
    g = api.open((tmp_path / "a.gz").read_bytes(), spark)
    g.import_index(str(tmp_path / "a.index"))
    g.seek(300_000)
    assert g.read(1000) == data[300_000:301_000] and g.block_offsets() == offsets
    b = api.open(io.BytesIO(bz2.compress(data, 1)), spark)
    b.seek(150_000)
    assert b.file_type() == "BZIP2" and b.read(200_000) == data[150_000:350_000] and b.test()
    c = api.open(b.path, spark)
    c.set_block_offsets(b.block_offsets())
    assert c.read(50) == data[:50] and b"".join(c.read_ranges("2L@3L,4@1")) == b"".join(slices(data, "2L@3L,4@1"))


def test_command_line(spark, tmp_path, capfd):
    data = PLAIN["members.gz"]
    (tmp_path / "a.gz").write_bytes(gzip.compress(data))
    path = str(tmp_path / "a.gz")
    run = lambda *a: cli.run([*a, path], spark)
    assert run("--count") == 0 and capfd.readouterr().out.strip() == str(len(data))
    assert run("-l") == 0 and capfd.readouterr().out.strip() == str(data.count(b"\n"))
    assert run("--count", "--count-lines", "--test") == 0 and capfd.readouterr().out == f"Size: {len(data)}\nLines: {data.count(b'\n')}\n"
    assert run("-d") == 0 and (tmp_path / "a").read_bytes() == data
    with pytest.raises(FileExistsError):
        run("-d")
    assert run("-f", "--ranges", "5L@2L,3@0", "-o", str(tmp_path / "r")) == 0 and (tmp_path / "r").read_bytes() == b"".join(slices(data, "5L@2L,3@0"))
    assert run("--export-index", str(tmp_path / "x"), "--index-format", "gztool") == 0 and run("--import-index", str(tmp_path / "x"), "--count") == 0
    capfd.readouterr()
    assert run("--list-offsets", "-") == 0 and capfd.readouterr().out.startswith("80,0\n")
    assert run("--analyze") == 0 and "DYNAMIC" in capfd.readouterr().out


def test_command_line_reports_errors(tmp_path):
    (tmp_path / "bad").write_bytes(b"\x07 nothing")
    done = subprocess.run([sys.executable, "-m", "bytelake.cli", "--count", str(tmp_path / "bad")], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, timeout=120)
    assert done.returncode == 1 and "no format" in done.stderr


def test_sources(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    assert files.read_range(str(tmp_path / "f"), 3, 6) == b"345" and files.read_range(f"file:{tmp_path}/f", 8, 99) == b"89" and files.read_range(str(tmp_path / "f"), 50, 60) == b""
    with open(tmp_path / "f", "rb") as f:
        assert files.resolve_source(f) == b"0123456789" and files.resolve_source(memoryview(b"x")) == b"x" and files.resolve_source(tmp_path / "f") == str(tmp_path / "f")
        f.seek(0)
        a = files.Accesses(f)
        assert a.read(4) == b"0123" and a.seek(8) == 8 and a.read(9) == b"89" and (a.reads, a.bytes, a.seeks) == (2, 6, 1)
    read, write = os.pipe()
    os.write(write, b"piped")
    os.close(write)
    assert files.resolve_source(read) == b"piped"
