"""Parallel decoding of single archives, with and without a saved index.

Without an index, a gzip archive is cut into cells; tasks look for the first block start in each. Chunks between starts are
decoded from an unknown history, of which only each chunk's last 32 KiB is kept (as planes); a pass over those in order
gives every chunk its window; then each chunk is decoded by zlib from its window. Only tails and windows move between
stages, never decoded data. From a chunk on whose start is known, decoding shows whether the next start is one: a block must
begin there. A start that fails is dropped and its cell joined to the one before; footers' checksums, folded over chunks, are
the last guard. bzip2 blocks need no history: they are found by their
magic bits and decoded one by one.
"""

from __future__ import annotations

import bz2
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions import deflate, formats
from bytelake.functions.crc import folded_crc
from bytelake.operators.checkpoints import FIRST, before
from bytelake.sources.files import cut, opened, read_range

SPACING, MARGIN = 4 << 20, 256 << 10
REACH = 3  #: starts of bzip2 blocks that may lie within one by chance
BZIP2_BLOCK, BZIP2_END = bytes.fromhex("314159265359"), bytes.fromhex("177245385090")
PART = 16 << 20  #: decoded bytes that a row holds, about; one step of decoding may add some 64 MB to it
PIECES = "array<struct<size:long,crc32:long,is_end:boolean,stated_crc32:long,stated_size:long>>"


def chunk_size(length: int, parallel: int, spacing: int = SPACING) -> int:
    """Smaller chunks for small files: if two chunks a task don't fit, a third of a task's share, in steps of 512 KiB."""
    step = 512 << 10
    return spacing if 2 * spacing * parallel <= length else max(step, -(-length // (3 * parallel) // step) * step)


def _dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Few small rows that stand for much work, over enough tasks; a number keeps them from being put together again. What two such
    steps exchange grows with the product of their tasks, so those are bounded by the session's, not by the rows."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(n, max(least, min(n // 4, 8 * spark.sparkContext.defaultParallelism)))), *keys)


def n_cells(files: DataFrame, spacing: int) -> int:
    return files.agg(F.sum(F.ceil(F.greatest("length", F.lit(1)) / spacing))).first()[0] or 0


def cells(files: DataFrame, spacing: int, n: int | None = None) -> DataFrame:
    """(path, length, cell): the grid over each file, of n cells in all."""
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest("length", F.lit(1)) / spacing) - 1)).alias("cell"))
    return _dealt(rows, n_cells(files, spacing) if n is None else n, "path", "cell")


def block_starts(files: DataFrame, spacing: int = SPACING, n: int | None = None) -> DataFrame:
    """(path, length, cell, start_bits, file_type, head): the first start of a deflate block in each cell that has one.

    Blocks of BGZF archives are members that tell their sizes, so their starts need no trial: a header that another follows
    right after its block, or the archive's end. `head` is where that header begins."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("cell", pa.int64()), ("start_bits", pa.int64()), ("file_type", pa.string()), ("head", pa.int64())])

    def run(batches):
        for b in batches:
            out = []
            for path, length, cell in zip(*(b.column(c).to_pylist() for c in ("path", "length", "cell"))):
                low, high = cell * spacing, min(length, (cell + 1) * spacing)
                with opened(path) as f:
                    kind = _kind(f, path, length)
                    if cell == 0:
                        out.append((path, length, cell, kind[1], kind[0], 0))
                        continue
                    data = f.read_at(min(high + MARGIN, length) - low, low)
                if kind[0] == "BGZF":
                    at = formats.find_bgzf(data, length - low)
                    if at is not None and at < high - low:
                        out.append((path, length, cell, 8 * (low + formats.gzip_header(data, at).end), kind[0], low + at))
                elif (at := deflate.find_start(data, 0, 8 * (high - low))) is not None:
                    out.append((path, length, cell, 8 * low + at, kind[0], None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return cells(files, spacing, n).mapInArrow(run, "path string, length long, cell long, start_bits long, file_type string, head long")


def _kind(f, path: str, length: int) -> tuple[str, int]:
    """(format, first block) of an open archive; most headers are short, so little is read before more is."""
    tail = f.read_at(min(28, length), length - min(28, length))
    kind = formats.detect(f.read_at(min(1 << 12, length), 0), tail)
    if kind is None or kind[0] not in ("GZIP", "BGZF") and length > 1 << 12:
        kind = formats.detect(f.read_at(min(2 * formats.MOST, length), 0), tail)
    if kind is None or kind[0] == "BZIP2":
        raise deflate.Corrupt(f"{path}: no deflate archive")
    return kind


def _chunks(starts: DataFrame) -> DataFrame:
    """(path, length, cell, chunk_no, start_bits, stop_bits, is_last, raw, known, head, next_head), known: its history is empty"""
    w = Window.partitionBy("path").orderBy("start_bits")
    no = (F.row_number().over(w) - 1).cast("long")
    return starts.select("path", "length", "cell", no.alias("chunk_no"), "start_bits", F.coalesce(F.lead("start_bits").over(w), F.col("length") * 8).alias("stop_bits"), F.lead("start_bits").over(w).isNull().alias("is_last"), F.col("file_type").isin("ZLIB", "DEFLATE").alias("raw"), ((F.col("file_type") == "BGZF") | (no == 0)).alias("known"), "head", F.coalesce(F.lead("head").over(w), "length").alias("next_head"))


def _own(row: dict) -> tuple[int, bytes]:
    """(first byte, bytes) of a chunk in its archive."""
    base = row["start_bits"] >> 3
    return base, read_range(row["path"], base, row["length"] if row["is_last"] else -(-row["stop_bits"] // 8))


def _pieces(row: dict, history: bytes) -> list[deflate.Piece]:
    base, data = _own(row)
    return deflate.inflate(data, row["start_bits"] - 8 * base, row["stop_bits"] - 8 * base, history, row["is_last"], row["raw"])


_CHUNK = [("path", pa.string()), ("length", pa.int64()), ("start_bits", pa.int64()), ("stop_bits", pa.int64()), ("is_last", pa.bool_()), ("raw", pa.bool_())]
_CHUNK_SQL = "path string, length long, start_bits long, stop_bits long, is_last boolean, raw boolean"


def _tails(chunks: DataFrame) -> DataFrame:
    """(path, length, start_bits, stop_bits, is_last, raw, bad, meets, ends, fresh, literal, place, used, decoded_size): what the next chunk's
    window needs of each chunk, which bytes of its own window (a bit each) a chunk refers to, and whether the next start is one (`meets`)."""
    schema = pa.schema([*_CHUNK, ("bad", pa.bool_()), ("meets", pa.bool_()), ("ends", pa.bool_()), ("fresh", pa.bool_()), ("literal", pa.binary()), ("place", pa.binary()), ("used", pa.binary()), ("decoded_size", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                out = {k: row[k] for k, _ in _CHUNK} | {"bad": False, "meets": False}
                try:
                    base, data = _own(row)
                    found = deflate.lead(data, row["start_bits"] - 8 * base, row["stop_bits"] - 8 * base, row["is_last"], row["raw"], row["known"])
                    marked = found.tail.markers() > 0
                    out |= {"meets": found.meets or row["is_last"], "ends": found.ends, "fresh": found.fresh, "used": np.packbits(found.used).tobytes(), "literal": found.tail.literal.tobytes(), "place": found.tail.place.astype("<i2").tobytes() if marked else b"", "decoded_size": found.decoded}
                except (zlib.error, deflate.Corrupt):
                    out["bad"] = True
                yield pa.RecordBatch.from_pylist([out], schema)

    return chunks.mapInArrow(run, _CHUNK_SQL + ", bad boolean, meets boolean, ends boolean, fresh boolean, literal binary, place binary, used binary, decoded_size long")


def _judged(chunks: DataFrame, seen: DataFrame, reach: int) -> DataFrame:
    """(path, start_bits, wrong, corrupt) of starts, from what was seen of their chunks.

    A chunk whose own start is one tells of the next start. So of each run of chunks that fail, the first one does: if no block begins
    where it stops, the next `reach` starts go. If it can't be decoded, its start goes, or the archive is corrupt if nothing failed before."""
    w = Window.partitionBy("path").orderBy("start_bits")
    earlier = w.rowsBetween(FIRST, -1)
    rows = chunks.select("path", "start_bits", "stop_bits", "chunk_no").join(seen, ["path", "start_bits", "stop_bits"]).withColumn("fails", F.col("bad") | ~F.col("meets"))
    rows = rows.withColumn("first", F.col("fails") & ~F.coalesce(F.lag("fails").over(w), F.lit(False))).withColumn("again", F.coalesce(F.max("fails").over(earlier), F.lit(False)))
    stopped = F.max(F.when(F.col("first") & ~F.col("bad"), F.col("chunk_no"))).over(earlier)
    wrong = F.coalesce(F.col("chunk_no") - stopped <= reach, F.lit(False)) | F.col("first") & F.col("bad")
    return rows.select("path", "start_bits", wrong.alias("wrong"), (F.col("first") & F.col("bad") & ~F.col("again")).alias("corrupt"))


def _bgzf_sizes(chunks: DataFrame) -> DataFrame:
    """(path, chunk_no, decoded_size) of chunks of BGZF archives, from the sizes in their blocks' footers."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for row in rows:
                row["decoded_size"] = formats.bgzf_size(read_range(row["path"], row["head"], row["next_head"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in (("path", pa.string()), ("chunk_no", pa.int64()), ("decoded_size", pa.int64()))], ["path", "chunk_no", "decoded_size"])

    return chunks.mapInArrow(run, "path string, chunk_no long, decoded_size long")


def sparse(window: bytes, used: bytes) -> bytes:
    """The window with zeros for what isn't referred to; empty if nothing is."""
    keep = np.unpackbits(np.frombuffer(used, np.uint8)).astype(bool)
    w = np.frombuffer(window.rjust(deflate.WINDOW, b"\0"), np.uint8)
    return np.where(keep, w, 0).astype(np.uint8).tobytes() if keep.any() else b""


def _windows(tails: DataFrame, thin: bool = False) -> DataFrame:
    """(path, length, start_bits, stop_bits, is_last, raw, chunk_no, window, decoded_offset): a pass over each archive's tails in order, holding
    one window. Each chunk begins where the one before stops: tails of chunks that were joined to others since are passed over."""
    schema = pa.schema([*_CHUNK, ("chunk_no", pa.int64()), ("window", pa.binary()), ("decoded_offset", pa.int64())])

    def run(batches):
        own, window, no, offset, following = None, b"", 0, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["path"] != own:
                    own, window, no, offset, following = r["path"], b"", 0, 0, r["start_bits"]
                if r["start_bits"] != following:
                    continue
                out.append({k: r[k] for k, _ in _CHUNK} | {"chunk_no": no, "window": sparse(window, r["used"]) if thin and window and r["used"] else window, "decoded_offset": offset})
                no, offset, following = no + 1, offset + r["decoded_size"], r["stop_bits"]
                if r["ends"] or r["literal"] is None:
                    window = b"" if r["ends"] else window
                elif r["fresh"]:
                    window = r["literal"]
                else:
                    tail = r["literal"]
                    if r["place"]:
                        tail = deflate.Planes(np.frombuffer(tail, np.uint8), np.frombuffer(r["place"], "<i2")).resolve(window)
                    window = deflate.next_window(window, tail)
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    in_order = tails.repartition("path").sortWithinPartitions("path", "start_bits", F.desc("stop_bits"))
    return in_order.mapInArrow(run, _CHUNK_SQL + ", chunk_no long, window binary, decoded_offset long")


def _scan(rows: DataFrame, data: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    """Decode rows (path, length, chunk_no, start_bits, stop_bits, is_last, raw, window) by zlib, a step at a time.

    Without `data`, a row for each chunk. With it, a row for each PART of decoded bytes (part_no): what a chunk says of
    sizes, newlines and pieces is split over its parts, and decoded_offset, where it is `carried`, goes on from part to part.
    `carried`: columns of `rows` that are in the result as they are."""
    fields = [("path", pa.string()), ("chunk_no", pa.int64()), ("part_no", pa.int64()), ("start_bits", pa.int64()), ("stop_bits", pa.int64()), ("is_last", pa.bool_()), ("raw", pa.bool_()), ("length", pa.int64()), *((c, pa.int64()) for c in carried), ("decoded_size", pa.int64()), ("n_newlines", pa.int64())]
    piece = pa.struct([("size", pa.int64()), ("crc32", pa.int64()), ("is_end", pa.bool_()), ("stated_crc32", pa.int64()), ("stated_size", pa.int64())])
    schema = pa.schema([*fields, *([] if data else [("window", pa.binary())]), ("pieces", pa.list_(piece)), *([("data", pa.binary())] if data else [])])

    def row_of(row, part, pieces, held, lines):
        size = sum(p["size"] for p in pieces)
        out = {k: row[k] for k in schema.names if k in row} | {"part_no": part, "pieces": pieces, "decoded_size": size, "n_newlines": lines}
        if data:
            out["data"] = b"".join(held)
        return pa.RecordBatch.from_pylist([out], schema), size

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                base, own = _own(row)
                pieces, held, lines, part, open_, total = [], [], 0, 0, False, 0
                for p in deflate.inflated(own, row["start_bits"] - 8 * base, row["stop_bits"] - 8 * base, row["window"], row["is_last"], row["raw"]):
                    if not open_:
                        pieces.append({"size": 0, "crc32": 0, "is_end": False, "stated_crc32": None, "stated_size": None})
                    now = pieces[-1]
                    now["size"], now["crc32"] = now["size"] + len(p.data), zlib.crc32(p.data, now["crc32"])
                    total, lines, open_ = total + len(p.data), lines + p.data.count(b"\n"), not p.end
                    if p.end:
                        now |= {"is_end": True, "stated_crc32": p.crc, "stated_size": p.size}
                    if data:
                        held.append(p.data)
                        if total >= PART:
                            batch, size = row_of(row, part, pieces, held, lines)
                            yield batch
                            if "decoded_offset" in row:
                                row["decoded_offset"] += size
                            pieces, held, lines, part, open_, total = [], [], 0, part + 1, False, 0
                if pieces or not part:
                    yield row_of(row, part, pieces, held, lines)[0]

    columns = "path string, chunk_no long, part_no long, start_bits long, stop_bits long, is_last boolean, raw boolean, length long" + "".join(f", {c} long" for c in carried) + ", decoded_size long, n_newlines long"
    return rows.mapInArrow(run, columns + ("" if data else ", window binary") + f", pieces {PIECES}" + ", data binary" * data)


def planned(files: DataFrame, spacing: int = SPACING, thin: bool = False) -> DataFrame:
    """Chunks of deflate archives with their windows and decoded offsets, ready to scan: an index whose lines aren't counted yet.
    `thin`: windows keep only what their chunks refer to. Chunks of BGZF archives are known without decoding any."""
    n = n_cells(files, spacing)  # chunks are as many at most
    starts = cut(block_starts(files, spacing, n))
    is_bgzf = F.col("file_type") == "BGZF"
    some_bgzf, some_plain = starts.agg(F.bool_or(is_bgzf), F.bool_or(~is_bgzf)).first()
    plain = starts.where(~is_bgzf)
    columns = [*(k for k, _ in _CHUNK), "chunk_no", "window", "decoded_offset"]
    narrow = []
    if some_bgzf:
        known = _chunks(starts.where(is_bgzf))
        sizes = _bgzf_sizes(_dealt(known, n, "path", "chunk_no"))
        both = known.join(sizes, ["path", "chunk_no"]).withColumn("decoded_offset", before("decoded_size", ["path"], ["chunk_no"]))
        narrow.append(both.withColumn("window", F.lit(b"")).select(columns))
    tails, todo, reach, n_todo = [], _chunks(plain), 1, n
    while some_plain:
        tails.append(cut(_tails(_dealt(todo, n_todo, "path", "start_bits"))))
        seen = reduce(DataFrame.unionByName, [t.select("path", "start_bits", "stop_bits", "bad", "meets") for t in tails])
        judged = cut(_judged(_chunks(plain), seen, reach))
        wrong, corrupt = judged.agg(F.count_if("wrong"), F.max(F.when(F.col("corrupt"), F.col("path")))).first()
        if corrupt:
            raise deflate.Corrupt(f"{corrupt}: a block can't be decoded")
        if not wrong:
            narrow.append(_windows(reduce(DataFrame.unionByName, tails), thin).select(columns))
            break
        plain, reach = cut(plain.join(judged.where("wrong").select("path", "start_bits"), ["path", "start_bits"], "left_anti")), 2 * reach
        todo, n_todo = _chunks(plain).join(seen, ["path", "start_bits", "stop_bits"], "left_anti"), wrong  # a chunk each at most
    if not narrow:
        narrow.append(_chunks(starts).withColumn("decoded_offset", F.lit(0).cast("long")).withColumn("window", F.lit(b"")).select(columns))
    return _dealt(reduce(DataFrame.unionByName, narrow), n, "path", "chunk_no")


def decode(files: DataFrame, spacing: int = SPACING, data: bool = True) -> DataFrame:
    """Chunks of deflate archives (path, length): sizes, offsets, newlines, checksums and, unless only those are wanted, `data` in parts."""
    return _scan(planned(files, spacing), data, ("decoded_offset",))


def with_places(chunks: DataFrame) -> DataFrame:
    """line_offset (newlines before the chunk) of scanned chunks, which have no data."""
    return chunks.withColumn("line_offset", before("n_newlines", ["path"], ["chunk_no"]))


def build_index(files: DataFrame, spacing: int = SPACING, thin: bool = True) -> DataFrame:
    """Checkpoints (path, length, chunk_no, start_bits, stop_bits, is_last, raw, window, decoded_offset, decoded_size, line_offset, n_newlines, pieces)."""
    found = _scan(planned(files, spacing, thin=thin), False, ("decoded_offset",)).drop("part_no")
    return cut(with_places(found))


def indexed_scan(index: DataFrame, data: bool = True) -> DataFrame:
    """Decode the chunks of an index, or those of its rows that are wanted: one zlib pass each, nothing in order, data in parts."""
    return _scan(_dealt(index, index.count(), "path", "chunk_no"), data, ("decoded_offset", "line_offset"))


def verified(chunks: DataFrame, strict: bool = True) -> DataFrame:
    """(path, member_no, crc32, size, valid): each member's checksum and size, folded over chunks, against its footer."""
    p = chunks.select("path", "chunk_no", "part_no" if "part_no" in chunks.columns else F.lit(0).alias("part_no"), F.posexplode("pieces").alias("k", "p")).select("path", F.struct("chunk_no", "part_no", "k").alias("at"), "p.*")
    p = p.withColumn("member_no", before(F.col("is_end").cast("long"), ["path"], ["at"]))
    stated = p.where("is_end").select("path", "member_no", "stated_crc32", "stated_size")
    out = folded_crc(p, ["path", "member_no"], "at").join(stated, ["path", "member_no"])
    valid = F.coalesce((F.col("crc32") == F.col("stated_crc32")) & (F.col("size") % (1 << 32) == F.col("stated_size")), F.lit(True))
    out = out.select("path", "member_no", "crc32", "size", valid.alias("valid"))
    if strict:
        out = out.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("a checksum or size differs in "), "path")).cast("boolean")))
    return out


def verified_against(chunks: DataFrame, given: DataFrame) -> DataFrame:
    """(path, crc32, size, valid): archives of streams without checksums against those in `given` (path, crc32)."""
    p = chunks.select("path", "chunk_no", "part_no" if "part_no" in chunks.columns else F.lit(0).alias("part_no"), F.posexplode("pieces").alias("k", "p")).select("path", F.struct("chunk_no", "part_no", "k").alias("at"), "p.size", "p.crc32")
    both = folded_crc(p, ["path"], "at").join(given.select("path", F.col("crc32").alias("_given")), "path")
    return both.select("path", "crc32", "size", (F.col("crc32") == F.col("_given")).alias("valid"))


# bzip2


def magic_bits(data: bytes, magic: bytes) -> list[int]:
    """Every bit at which `magic` stands, highest bits first."""
    a, out = np.frombuffer(data, np.uint8), []
    for r in range(8):
        s = a << np.uint8(r)
        if r and len(a) > 1:
            s[:-1] |= a[1:] >> np.uint8(8 - r)
        raw, at = s.tobytes(), -1
        while (at := raw.find(magic, at + 1)) >= 0:
            if 8 * at + r + 48 <= 8 * len(data):
                out.append(8 * at + r)
    return sorted(out)


def bzip2_starts(files: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(path, length, start_bits, is_end): where blocks and ends of streams begin, without decoding."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start_bits", pa.int64()), ("is_end", pa.bool_())])

    def run(batches):
        for b in batches:
            for path, length, cell in zip(*(b.column(c).to_pylist() for c in ("path", "length", "cell"))):
                low = cell * spacing
                data, size = read_range(path, low, low + spacing + 7), 8 * min(spacing, length - low)
                found = sorted((x, end) for end, m in ((False, BZIP2_BLOCK), (True, BZIP2_END)) for x in magic_bits(data, m) if x < size)
                yield pa.RecordBatch.from_pylist([{"path": path, "length": length, "start_bits": 8 * low + x, "is_end": end} for x, end in found], schema)

    return cells(files, spacing).mapInArrow(run, "path string, length long, start_bits long, is_end boolean")


def checked_offsets(offsets: DataFrame) -> DataFrame:
    """`offsets` (path, start_bits, ...) with `valid`: whether a bzip2 block or end of a stream begins there."""

    def run(batches):
        for b in batches:
            ok = []
            for path, bit in zip(b.column("path").to_pylist(), b.column("start_bits").to_pylist()):
                raw = read_range(path, bit >> 3, (bit >> 3) + 7)
                magic = (int.from_bytes(raw.ljust(7, b"\0"), "big") >> (8 - (bit & 7)) & (1 << 48) - 1).to_bytes(6, "big")
                ok.append(len(raw) * 8 >= (bit & 7) + 48 and magic in (BZIP2_BLOCK, BZIP2_END))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, "valid"])

    from pyspark.sql import types as T

    return offsets.mapInArrow(run, T.StructType([*offsets.schema.fields, T.StructField("valid", T.BooleanType())]))


def bzip2_block(data: bytes, start: int, stop: int) -> bytes:
    """The output of the block in bits [start, stop), made a stream of its own: one block's checksum is its stream's."""
    n = stop - start
    bits = int.from_bytes(data[start >> 3 : -(-stop // 8)], "big") >> (-stop % 8) & (1 << n) - 1
    crc = bits >> (n - 80) & 0xFFFFFFFF
    whole = ((bits << 48 | int.from_bytes(BZIP2_END, "big")) << 32) | crc
    n += 80
    whole <<= -n % 8
    return bz2.decompress(b"BZh9" + whole.to_bytes(-(-n // 8), "big"))


def _bzip2_rows(starts: DataFrame) -> DataFrame:
    """(path, block_no, start_bits, stop_bits, is_end, before, after): starts of blocks with the REACH starts on either side."""
    w = Window.partitionBy("path").orderBy("start_bits")
    stop = F.coalesce(F.lead("start_bits").over(w), F.col("length") * 8)
    end = lambda k: F.coalesce(F.lead("start_bits", k).over(w), F.col("length") * 8)
    near = [F.array(*(F.lag("start_bits", k).over(w) for k in range(1, REACH + 1))).alias("before"), F.array(*(end(k) for k in range(1, REACH + 2))).alias("after")]
    return starts.select("path", (F.row_number().over(w) - 1).cast("long").alias("block_no"), "start_bits", stop.alias("stop_bits"), "is_end", *near)


def bzip2_output(path: str, start: int, stops: list[int]) -> tuple[bytes, int] | None:
    """(output, stop) of the block at bit `start`, which ends at one of `stops`: the magic may stand within a block by chance."""
    base, last = start >> 3, max(stops)
    data = read_range(path, base, -(-last // 8))
    for stop in sorted(set(stops)):
        try:
            return bzip2_block(data, start - 8 * base, stop - 8 * base), stop
        except (OSError, ValueError, EOFError):
            continue
    return None


def _bzip2_own(r: dict) -> bytes | None:
    """The output of a row of _bzip2_rows; None for a start that lies within a block."""
    if (got := bzip2_output(r["path"], r["start_bits"], r["after"])) is not None:
        return got[0]
    for earlier in filter(None.__ne__, r["before"]):
        got = bzip2_output(r["path"], earlier, [x for x in r["after"] if x > r["start_bits"]])
        if got is not None:
            return None
    raise deflate.Corrupt(f"{r['path']}: the bzip2 block at bit {r['start_bits']} can't be decoded")


def scan_bzip2(rows: DataFrame, data: bool = True) -> DataFrame:
    """(path, block_no, start_bits, stop_bits, decoded_size, n_newlines[, data]) of rows of _bzip2_rows; ends of streams have size 0."""
    schema = pa.schema([("path", pa.string()), ("block_no", pa.int64()), ("start_bits", pa.int64()), ("stop_bits", pa.int64()), ("decoded_size", pa.int64()), ("n_newlines", pa.int64()), *([("data", pa.binary())] if data else [])])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if (got := b"" if r["is_end"] else _bzip2_own(r)) is not None:
                    out = {"path": r["path"], "block_no": r["block_no"], "start_bits": r["start_bits"], "stop_bits": r["stop_bits"], "decoded_size": len(got), "n_newlines": got.count(b"\n")}
                    yield pa.RecordBatch.from_pylist([out | ({"data": got} if data else {})], schema)

    return rows.mapInArrow(run, "path string, block_no long, start_bits long, stop_bits long, decoded_size long, n_newlines long" + ", data binary" * data)


def decode_bzip2(files: DataFrame, spacing: int = SPACING, data: bool = True) -> DataFrame:
    """Blocks of bzip2 archives (see scan_bzip2), in the order of block_no. Without `data`, decoded_offset and line_offset as well:
    a sum over an archive's blocks moves rows, and rows with data stay where they are."""
    starts = cut(bzip2_starts(files, spacing))
    out = scan_bzip2(_dealt(_bzip2_rows(starts), starts.count(), "path", "block_no"), data)
    if data:
        return out
    w = Window.partitionBy("path").orderBy("block_no")  # a block goes on over starts that lie within it
    out = out.withColumn("stop_bits", F.coalesce(F.lead("start_bits").over(w), "stop_bits"))
    return out.withColumn("decoded_offset", before("decoded_size", ["path"], ["block_no"])).withColumn("line_offset", before("n_newlines", ["path"], ["block_no"]))
