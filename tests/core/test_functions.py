"""Plain functions against the standard library, literal cases and brute force."""

import bz2
import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelake.functions import access, coding, crc, deflate, formats
from bytelake.functions.ranges import ALL, parse_ranges
from bytelake.operators import archives, parallel, stats
from bytelake.sources import files, index_files


def prose(n, seed=0, words=400):
    r = random.Random(seed)
    v = ["".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randrange(2, 9))) for _ in range(words)]
    out = bytearray()
    while len(out) < n:
        out += (r.choice(v) + r.choice([" ", " ", " ", "\n"])).encode()
    return bytes(out[:n])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), ("  ", []), ("1@0", [(0, 1, False, False)]), ("1B@0", [(0, 1, False, False)]), ("  1  @  0  ", [(0, 1, False, False)]), ("1 kB@ 2 kiB", [(2048, 1000, False, False)]),
        ("1M@2Mi", [(2 << 20, 10**6, False, False)]), ("1 GB@ 2 GiB", [(2 << 30, 10**9, False, False)]), (" ,, 1  @  4  , 2@3 ", [(4, 1, False, False), (3, 2, False, False)]),
        ("1L@2", [(2, 1, False, True)]), ("1@2KiL", [(2048, 1, True, False)]), ("inf@40L", [(40, ALL, True, False)]),
    ],
)
def test_ranges(text, want):
    assert [tuple(r) for r in parse_ranges(text)] == want


@pytest.mark.parametrize("text", ["a", "1", "1@", "@1", "1@2@3", "-1@0", "1X@0"])
def test_ranges_errors(text):
    with pytest.raises(ValueError):
        parse_ranges(text)


@given(st.integers(0, (1 << 64) - 1), st.binary(max_size=5))
def test_varint(n, rest):
    raw = coding.put_varint(n)
    assert coding.get_varint(raw + rest) == (n, len(raw))
    assert coding.get_varint(raw[:-1]) == (0, 0)


def test_varint_literals():
    assert [coding.put_varint(n).hex() for n in (127, 128, 0x7FFFFFFF)] == ["7f", "8001", "ffffffff07"]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 40))))
def test_run_lengths(runs):
    data = b"".join(bytes([b]) * n for b, n in runs)
    assert coding.rle_decode(coding.rle_encode(data), len(data)) == data


def test_run_length_literals():
    assert coding.rle_encode(b"A" * 7) == b"\0\1A\1\6" and coding.rle_encode(b"\0" + b"\x09" * 9) == b"\0\2\0\x09\1\x08"
    for bad in (b"\1\1", b"\0\5A", b"\2\1", b"\0"):
        with pytest.raises(ValueError):
            coding.rle_decode(bad)


@settings(max_examples=60)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_crc_of_concatenations(parts):
    total, size = 0, 0
    for p in parts:
        total, size = crc.combine(total, zlib.crc32(p), len(p)), size + len(p)
    assert total == zlib.crc32(b"".join(parts))


def test_prefetch():
    assert access.adaptive([], 8) == [] and access.adaptive([3], 4) == [4, 5, 6, 7]
    assert access.adaptive([7, 6, 5], 8) == list(range(8, 16)) and access.adaptive([9, 4, 1], 8) == []
    assert access.adaptive([5, 4, 1], 8) == [6, 7, 8, 9] and access.adaptive([9, 5, 4], 8) == [10]
    assert access.adaptive([3, 3], 2) == [4, 5] and access.adaptive([2, 1], 0) == []
    assert access.multi_stream([101, 1, 100, 0], 8) == [2, 102, 3, 103, 4, 104, 5, 105]
    assert access.multi_stream([5], 3) == [6, 7, 8] and access.interleaved([[1, 2, 3], [], [4]]) == [1, 4, 2, 3]
    assert access.simulate([1, 2, 1, 3, 2], 2) == {"hits": 1, "misses": 4, "unused": 1}


def test_gzip_headers():
    raw = formats.gzip_member(b"hello", 9, "näme", b"BC\2\0\5\0", 77)
    h = formats.gzip_header(raw)
    assert (h.mtime, h.os, h.xfl, h.name, h.comment, h.extra, h.hcrc) == (77, 3, 2, "näme", None, b"BC\2\0\5\0", None)
    assert gzip.decompress(raw) == b"hello" and formats.extra_fields(h.extra) == {"bgzf_block_size": 6}
    full = b"\x1f\x8b\x08" + bytes([2 | 4 | 8 | 16]) + struct.pack("<IBB", 5, 0, 255) + struct.pack("<H", 4) + b"RA\0\0" + b"a\0" + b"c d\0" + struct.pack("<H", 0x1234)
    h = formats.gzip_header(full)
    assert (h.end, h.name, h.comment, h.hcrc) == (len(full), "a", "c d", 0x1234)
    assert all(formats.gzip_header(full[:n]) is None for n in range(len(full)))


def test_extra_fields():
    four, eight = struct.pack("<I", 99), struct.pack("<Q", 1 << 40)
    f = formats.extra_fields
    assert f(b"IG\4\0" + four) == {"indexed_gzip_block_size": 99} and f(b"MZ\4\0" + four) == {"migz_stream_size": 99}
    assert f(b"QZ\x08\0" + four + four) == {"qatzip_decompressed_size": 99, "qatzip_stream_size": 99}
    assert f(b"ZC\4\0" + four + b"GC\x08\0" + eight) == {"pgzf_stream_size": 99, "pgzf_group_size": 1 << 40}
    assert f(b"RA\6\0\1\0\2\0\3\0") == {"dictzip_version": 1, "dictzip_chunk_size": 2, "dictzip_chunks": 3} and f(None) == {} and f(b"xx") == {}


def test_detection():
    data = prose(5000)
    assert [formats.detect(x, x[-28:]) for x in (gzip.compress(data), formats.bgzf(data), zlib.compress(data), bz2.compress(data), zlib.compress(data, 6, -15))] == [("GZIP", 80), ("BGZF", 144), ("ZLIB", 16), ("BZIP2", 32), ("DEFLATE", 0)]
    assert formats.detect(b"") is None and formats.detect(b"\x07abc") is None


@pytest.mark.parametrize("level", [0, 1, 6, 9])
@pytest.mark.parametrize("data", [b"", b"A", b"ab" * 40000, bytes(range(256)) * 300, prose(200_000)], ids=["empty", "one", "runs", "bytes", "prose"])
def test_block_walk(level, data):
    raw = zlib.compress(data, level, -15)
    blocks = list(deflate.walk(raw))
    assert sum(b.size for b in blocks) == len(data) and [b.final for b in blocks] == [False] * (len(blocks) - 1) + [True]
    assert -(-blocks[-1].end // 8) == len(raw) and all(b.literals + sum(n for _, n, _ in b.matches) == b.size for b in blocks)
    for b in blocks:
        assert deflate.read_block_header(raw, b.start).header_end == b.header_end


def test_block_walk_rejects_damage():
    raw = zlib.compress(prose(5000), 6, -15)
    with pytest.raises(deflate.Corrupt):
        list(deflate.walk(raw[:-20]))
    for bad in (b"\x07", b"\x00\x01\x00\x00\x00", b"\xfd\xff\xff"):
        with pytest.raises(deflate.Corrupt):
            list(deflate.walk(bad))


def test_finders():
    data = prose(2_000_000, 3, 3000)
    raw = zlib.compress(data, 6, -15)
    starts = [b.start for b in deflate.walk(raw) if b.kind == "DYNAMIC" and not b.final]
    assert len(starts) > 10 and set(starts) <= set(deflate.dynamic_candidates(raw, 0, 8 * len(raw)).tolist())
    for a in range(0, 8 * len(raw) - 200_000, 777_777):
        want = min((s for s in starts if s >= a), default=None)
        assert deflate.find_start(raw, a, 8 * len(raw)) == want
    stored = zlib.compress(np.random.default_rng(0).bytes(200_000), 0, -15)
    sizes_at = lambda bit: bit + 3 + 7 >> 3
    want = {sizes_at(b.start) for b in list(deflate.walk(stored))[1:-1]}
    assert want and want <= {sizes_at(a) for a in deflate.stored_candidates(stored, 8, 8 * len(stored)).tolist() if deflate.starts_block(stored, a)}


def test_planes_resolve():
    data = prose(600_000, 5)
    raw = zlib.compress(data, 6, -15)
    for b in list(deflate.walk(raw))[1:-1:3]:
        one, two = (b"".join(p.data for p in deflate.inflate(raw, b.start, 8 * len(raw), d, True, True)) for d in deflate.DICTIONARIES)
        planes = deflate.Planes.of(one, two)
        found = deflate.lead(raw, b.start, 8 * len(raw), True, True)
        assert found.decoded == len(one) and found.ends and np.array_equal(np.flatnonzero(found.used), deflate.used_places(planes.place))
        tail = planes.tail()
        assert np.array_equal(found.tail.place, tail.place) and np.array_equal(found.tail.literal[tail.place < 0], tail.literal[tail.place < 0])
        window = data[max(0, b.decoded - deflate.WINDOW) : b.decoded]
        assert planes.resolve(window) == data[b.decoded :] and planes.markers() >= len(deflate.used_places(planes.place)) > 0
        used = np.packbits(np.isin(np.arange(deflate.WINDOW), deflate.used_places(planes.place))).tobytes()
        assert planes.resolve(parallel.sparse(window, used)) == data[b.decoded :]


def test_empty_blocks_keep_places():
    """From every block of a stream zlib decodes the rest, stored blocks and what follows the stream included."""
    assert [len(x) % 8 for x in deflate._EMPTY] == list(range(8))
    data = b"".join(prose(60_000, k) + np.random.default_rng(k).bytes(70_000) for k in range(12))
    raw = zlib.compress(data, 6, -15)
    blocks, seen = list(deflate.walk(raw)), set()
    assert {b.kind for b in blocks} >= {"DYNAMIC", "UNCOMPRESSED"}
    for b in blocks:
        body, _ = deflate.primed(raw + b"rest", b.start, len(raw) + 4)
        window = data[max(0, b.decoded - deflate.WINDOW) : b.decoded]
        d = zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
        assert d.decompress(body) == data[b.decoded :] and d.unused_data == b"rest"
        seen.add(b.start % 8)
    assert len(seen) > 4


@pytest.mark.parametrize("offset", range(0, 16))
def test_magic_at_any_bit(offset):
    bits = (1 << offset) - 1 << 48 | int.from_bytes(parallel.BZIP2_BLOCK, "big")
    bits <<= -(48 + offset) % 8
    raw = bits.to_bytes(-(-(48 + offset) // 8), "big")
    assert parallel.magic_bits(raw, parallel.BZIP2_BLOCK) == [offset]


def test_bzip2_blocks_alone():
    data = prose(700_000, 7)
    raw = bz2.compress(data, 1)
    at = parallel.magic_bits(raw, parallel.BZIP2_BLOCK)
    stops = [*at[1:], *parallel.magic_bits(raw, parallel.BZIP2_END)]
    assert len(at) > 5 and b"".join(parallel.bzip2_block(raw, a, b) for a, b in zip(at, stops)) == data


def test_block_offsets_of_one_byte_files():
    """Known offsets: the first block after each header."""
    one = b"A"
    assert formats.detect(bz2.compress(one))[1] == 32 and formats.detect(formats.bgzf(one), formats.BGZF_END)[1] == 144
    assert formats.detect(formats.gzip_member(one, name="1B"))[1] == 104 and formats.detect(zlib.compress(one))[1] == 16


def sample_index(lines=True):
    r = random.Random(1)
    points = [index_files.Checkpoint(104, 0, b"", 0)]
    for i in range(1, 5):
        points.append(index_files.Checkpoint(points[-1].bits + r.randrange(10_000, 90_000), points[-1].offset + 65536, r.randbytes(32768) if i != 2 else b"", 10 * i))
    size = points[-1].bits // 8 + 5000
    points.append(index_files.Checkpoint(8 * size, points[-1].offset + 9, b"", 55))
    return index_files.Index(size, points[-1].offset, points, has_lines=lines)


def test_index_files():
    index = sample_index()
    got = index_files.read_index(index_files.write_indexed_gzip(index))
    assert [(c.bits, c.offset, c.window) for c in got.checkpoints] == [(c.bits, c.offset, c.window) for c in index.checkpoints]
    assert (got.compressed_size, got.uncompressed_size) == (index.compressed_size, index.uncompressed_size) and got.spacing >= 32768
    raw = index_files.write_gztool(index)
    got = index_files.read_gztool(raw, index.compressed_size)
    assert [(c.bits, c.offset, c.window, c.line) for c in got.checkpoints] == [(c.bits, c.offset, c.window, c.line) for c in index.checkpoints]
    assert index_files.write_gztool(got) == raw
    bare = index_files.read_gztool(index_files.write_gztool(index, False), index.compressed_size)
    assert [c.bits for c in bare.checkpoints] == [c.bits for c in index.checkpoints[:-1]] and not bare.has_lines
    for bad in (b"GZIDX", raw[:40], b"x" * 50, raw[:28] + bytes(8) + raw[36:]):
        with pytest.raises((ValueError, struct.error)):
            index_files.read_index(bad, bytes(index.compressed_size))


def test_bgzip_index():
    data = prose(300_000)
    raw = formats.bgzf(data)
    blocks = formats.bgzf_blocks(raw)
    index = index_files.Index(len(raw), len(data), [index_files.Checkpoint(8 * (a + 18), min(len(data), 65280 * k)) for k, (a, _) in enumerate(blocks)])
    got = index_files.read_index(index_files.write_bgzi(index), raw)
    assert [(c.bits, c.offset) for c in got.checkpoints] == [(c.bits, c.offset) for c in index.checkpoints[:-1]] and got.uncompressed_size == len(data)
    with pytest.raises(ValueError):
        index_files.read_index(index_files.write_bgzi(index), gzip.compress(data))


def test_decode_bytes():
    data = prose(100_000)
    for raw in (gzip.compress(data), formats.bgzf(data), zlib.compress(data), bz2.compress(data), zlib.compress(data, 6, -15)):
        assert archives.decode_bytes(raw) == data
    assert archives.decode_bytes(gzip.compress(data) * 3) == data * 3 and archives.decode_bytes(bz2.compress(data) + bz2.compress(b"x") + b"garbage") == data + b"x"
    raw = bytearray(gzip.compress(data))
    raw[-6] ^= 1
    for bad in (bytes(raw), gzip.compress(data)[:-30], b"\x07nothing"):
        with pytest.raises((deflate.Corrupt, zlib.error)):
            archives.decode_bytes(bad)


def test_uncertainty():
    assert stats.format_uncertain(12.3456, 0.1234) == "12.35 +- 0.12" and stats.format_uncertain(12.3456, 0.51) == "12.3 +- 0.5"
    assert stats.format_uncertain(12345, 1234) == "12300 +- 1200" and stats.format_uncertain(5, 0.2, 1, 9) == "1.00 <= 5.00 +- 0.20 <= 9.00"


def test_names_and_chunks():
    assert [files.output_name(x) for x in ("a.gz", "b.BZ2", "c", "d.txt", ".gz")] == ["a", "b", "c.out", "d.txt.out", ".gz.out"]
    assert parallel.chunk_size(1 << 40, 8) == 4 << 20 and parallel.chunk_size(1000, 8) == 512 << 10


def test_flushed_starts():
    z, parts = zlib.compressobj(6, zlib.DEFLATED, -15), []
    for k in range(4):
        parts.append(z.compress(prose(20_000, k)) + z.flush(zlib.Z_FULL_FLUSH))
    raw = b"".join(parts) + z.flush()
    ends = np.cumsum([len(x) for x in parts]).tolist()
    assert set(ends) <= set(deflate.flushed_starts(raw)) and all(deflate.starts_block(raw, 8 * e) for e in ends)


def test_windows_are_packed():
    w = prose(32768)
    for codec in ("NONE", "ZLIB", "GZIP"):
        assert index_files.unpack(index_files.pack(w, codec), codec) == w
    with pytest.raises(ValueError):
        index_files.pack(w, "LZ4")


def test_high_ratios_come_in_parts():
    raw = zlib.compress(bytes(300_000_000), 9, -15)
    sizes = [len(p.data) for p in deflate.inflated(raw, 0, 8 * len(raw), b"", True, True)]
    assert sum(sizes) == 300_000_000 and max(sizes) <= 70 << 20
    found = deflate.lead(raw, 0, 8 * len(raw), True, True)
    assert found.decoded == 300_000_000 and not found.used.any()


def test_bgzf_starts_and_sizes():
    data = prose(900_000, 12) + formats.bgzf(prose(200_000, 3))  # an archive within an archive
    raw = formats.bgzf(data, level=0)
    blocks = dict(formats.bgzf_blocks(raw))
    for at in range(0, len(raw), 40_111):
        want = min((b for b in blocks if b >= at), default=None)
        found = formats.find_bgzf(raw[at : at + (1 << 18)], len(raw) - at)
        assert want is None or found is not None
    real = formats.bgzf(prose(900_000, 12))
    blocks = [b for b, _ in formats.bgzf_blocks(real)]
    for at in range(0, len(real), 7_001):
        found = formats.find_bgzf(real[at : at + (1 << 18)], len(real) - at)
        assert (None if found is None else found + at) == min((b for b in blocks if b >= at), default=None)
    assert formats.bgzf_size(real) == 900_000 and formats.bgzf_size(real[blocks[3] : blocks[5]]) == 2 * 65280
