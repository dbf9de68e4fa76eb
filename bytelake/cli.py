"""Command line: decode, count, test, analyze, and read and write indexes of archives.

    python -m bytelake.cli [options] [input]

Exit codes: 0 if all went well, 1 on an error, 141 if the reader of the output went away.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytelake import api
from bytelake.operators import archives
from bytelake.sources import files

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelake", description="Decodes gzip, BGZF, zlib, deflate and bzip2 archives on Spark.")
    p.add_argument("file", nargs="?", help="input; standard input if there is none or it is -")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-c", "--stdout", action="store_true")
    p.add_argument("-f", "--force", action="store_true", help="overwrite an output that is there")
    p.add_argument("-k", "--keep", action="store_true", help="inputs are always kept")
    p.add_argument("-d", "--decompress", action="store_true")
    p.add_argument("-t", "--test", action="store_true", help="verify checksums")
    p.add_argument("-P", "--decoder-parallelism", type=int, default=0)
    p.add_argument("-p", "--block-finder-parallelism", type=int, default=1)
    p.add_argument("--ranges", help="for instance 10@0,1KiB@15KiB,5L@20L,inf@40L")
    p.add_argument("--chunk-size", type=int, default=4096, help="KiB")
    p.add_argument("--verify", dest="verify", action="store_true", default=True)
    p.add_argument("--no-verify", dest="verify", action="store_false")
    p.add_argument("--io-read-method", choices=["pread", "sequential", "locked-read"], default="pread")
    p.add_argument("--index-format", choices=["indexed_gzip", "gztool", "gztool-with-lines", "bgzi"], default="indexed_gzip")
    p.add_argument("--import-index")
    p.add_argument("--export-index")
    p.add_argument("--sparse-windows", dest="sparse", action="store_true", default=True, help="an index keeps of a window only what is referred to")
    p.add_argument("--no-sparse-windows", dest="sparse", action="store_false")
    p.add_argument("--count", action="store_true")
    p.add_argument("-l", "--count-lines", action="store_true")
    p.add_argument("--analyze", action="store_true")
    p.add_argument("--list-compressed-offsets", metavar="FILE", help="bits of bzip2 blocks, a line each; - is standard output")
    p.add_argument("--list-offsets", metavar="FILE", help="bits,bytes of blocks, a line each")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    return p


def _lines(target: str, lines) -> None:
    out = sys.stdout if target == "-" else open(target, "w")
    for x in lines:
        print(x, file=out)
    if out is not sys.stdout:
        out.close()


def analyze(spark: SparkSession, path: str) -> None:
    blob = spark.createDataFrame([(path, bytearray(files.read_range(path, 0, 1 << 62)))], "path string, content binary")
    print("Members:")
    for m in archives.members(blob, strict=False).toLocalIterator():
        print("  " + ", ".join(f"{k}={v}" for k, v in m.asDict().items() if v is not None and k not in ("path", "extra")))
    print("Blocks:")
    b = archives.blocks(blob)
    for r in b.select("block_no", "btype", "is_final", "encoded_bits", "encoded_size_bits", "decoded_offset", "decoded_size", "literals", "references", "copied", "farthest", "window_symbols").toLocalIterator():
        print("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()))
    for r in b.groupBy("btype").agg(F.count("*").alias("n")).toLocalIterator():
        print(f"{r['btype']}: {r['n']}")


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
        spark = (builder.master(f"local[{a.decoder_parallelism or '*'}]") if not os.environ.get("SPARK_REMOTE") else builder).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    source = a.input or a.file or "-"
    archive = api.Archive(source, spark, chunk_size=a.chunk_size << 10, verify=a.verify, sparse=a.sparse)
    if archive.file_type() == "NONE":
        raise ValueError("no format that is known")
    if a.import_index:
        archive.import_index(a.import_index)
    if a.analyze:
        analyze(spark, archive.path)
        return 0
    if a.list_compressed_offsets:
        _lines(a.list_compressed_offsets, archive.block_offsets())
    if a.list_offsets:
        _lines(a.list_offsets, (f"{b},{d}" for b, d in archive.block_offsets().items()))
    if a.export_index:
        archive.export_index(a.export_index, a.index_format)
    if a.test and not archive.test():
        raise ValueError("a checksum or size differs")
    if a.count or a.count_lines:
        n, lines = archive.size() if a.count else None, archive.count_lines() if a.count_lines else None
        if n is not None and lines is not None:
            print(f"Size: {n}\nLines: {lines}")
        else:
            print(n if lines is None else lines)
    asked = a.decompress or a.ranges or a.output or a.stdout
    if not asked and (a.count or a.count_lines or a.test or a.export_index or a.list_offsets or a.list_compressed_offsets):
        return 0
    parts = archive.read_ranges(a.ranges or "inf@0")
    target = a.output or (None if a.stdout or source == "-" else files.output_name(source))
    if target is None:
        for x in parts:
            sys.stdout.buffer.write(x)
        sys.stdout.flush()
        return 0
    if os.path.exists(target) and not a.force and target != "/dev/null":
        raise FileExistsError(f"{target} is there already; --force overwrites it")
    with open(target, "wb") as out:
        for x in parts:
            out.write(x)
    return 0


def main() -> int:
    try:
        return run()
    except BrokenPipeError:
        return 141
    except Exception as e:  # whatever it is, the tool says so and fails
        print(f"bytelake: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
