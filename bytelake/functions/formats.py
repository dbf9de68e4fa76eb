"""Containers of compressed data: headers, footers, vendors' metadata, and telling formats apart."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import NamedTuple

from bytelake.functions.deflate import Corrupt, read_block_header

MOST = 1 << 20  #: bytes that a header field may have

# Magic bytes and flags (RFC 1950, RFC 1952, the BGZF specification).
GZIP = b"\x1f\x8b\x08"
BZIP2 = b"BZh"
FTEXT, FHCRC, FEXTRA, FNAME, FCOMMENT = 1, 2, 4, 8, 16
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class GzipHeader(NamedTuple):
    end: int  #: where the deflate stream begins, in bytes
    mtime: int
    os: int
    xfl: int
    text: bool
    extra: bytes | None
    name: str | None
    comment: str | None
    hcrc: int | None


def gzip_header(data: bytes, at: int = 0) -> GzipHeader | None:
    """The header at byte `at`; None where there is none."""
    if data[at : at + 3] != GZIP or len(data) < at + 10:
        return None
    flags, mtime, xfl, os = struct.unpack_from("<BIBB", data, at + 3)
    if flags & 0xE0:
        return None
    end, extra, texts, hcrc = at + 10, None, [], None
    if flags & FEXTRA:
        if len(data) < end + 2:
            return None
        (n,) = struct.unpack_from("<H", data, end)
        extra, end = data[end + 2 : end + 2 + n], end + 2 + n
    for flag in (FNAME, FCOMMENT):
        text = None
        if flags & flag:
            stop = data.find(0, end, end + MOST)
            if stop < 0:
                return None
            text, end = data[end:stop].decode("latin-1"), stop + 1
        texts.append(text)
    if flags & FHCRC:
        if len(data) < end + 2:
            return None
        (hcrc,), end = struct.unpack_from("<H", data, end), end + 2
    return GzipHeader(end, mtime, os, xfl, bool(flags & FTEXT), extra, *texts, hcrc) if end <= len(data) else None


def gzip_footer(data: bytes, at: int) -> tuple[int, int] | None:
    """(crc32, size modulo 2**32)"""
    return struct.unpack_from("<II", data, at) if len(data) >= at + 8 else None


class ZlibHeader(NamedTuple):
    end: int
    window: int
    level: int
    dictionary: bool


def zlib_header(data: bytes, at: int = 0) -> ZlibHeader | None:
    if len(data) < at + 2:
        return None
    method, flags = data[at], data[at + 1]
    if method & 15 != 8 or method >> 4 > 7 or (method << 8 | flags) % 31 or flags & 32:
        return None
    return ZlibHeader(at + 2, 256 << (method >> 4), flags >> 6, False)


def bzip2_level(data: bytes, at: int = 0) -> int | None:
    return data[at + 3] - 48 if data[at : at + 3] == BZIP2 and len(data) > at + 3 and 49 <= data[at + 3] <= 57 else None


def is_bgzf_header(data: bytes, at: int = 0) -> bool:
    return data[at : at + 3] == GZIP and len(data) >= at + 18 and bool(data[at + 3] & FEXTRA) and data[at + 10 : at + 16] == b"\6\0BC\2\0"


def bgzf_blocks(data: bytes) -> list[tuple[int, int]]:
    """(start, size) of each block, following the sizes in the headers; what comes after the last is left out."""
    out, at = [], 0
    while is_bgzf_header(data, at):
        size = int.from_bytes(data[at + 16 : at + 18], "little") + 1
        out.append((at, size))
        at += size
    return out


def bgzf_follow(data: bytes, at: int) -> int | None:
    """Where the block after the one whose header is at `at` begins; None if there is no header."""
    return at + int.from_bytes(data[at + 16 : at + 18], "little") + 1 if is_bgzf_header(data, at) else None


def find_bgzf(data: bytes, length: int) -> int | None:
    """The first block's header in `data`, the first part of the `length` bytes to the archive's end: one that a header or the end follows."""
    at = data.find(GZIP)
    while at >= 0:
        after = bgzf_follow(data, at)
        if after is not None and (after == length or after + 18 <= len(data) and is_bgzf_header(data, after)):
            return at
        at = data.find(GZIP, at + 1)
    return None


def bgzf_size(data: bytes) -> int:
    """The decoded bytes of the blocks in `data`, which begins with a header, from the sizes in their footers."""
    total, at = 0, 0
    while (after := bgzf_follow(data, at)) is not None and after <= len(data):
        total, at = total + int.from_bytes(data[after - 4 : after], "little"), after
    return total


def detect(head: bytes, tail: bytes | None = None) -> tuple[str, int] | None:
    """(format, bit where the first block begins) of a file with the first bytes `head` (64 KiB or so) and the last bytes
    `tail` (28; None: unknown). None if it is no format that is known."""
    if h := gzip_header(head):
        return ("BGZF" if is_bgzf_header(head) and (tail is None or tail[-28:] == BGZF_END) else "GZIP"), 8 * h.end
    if z := zlib_header(head):
        return "ZLIB", 8 * z.end
    if bzip2_level(head):
        return "BZIP2", 32
    try:
        read_block_header(head, 0)
    except Corrupt:
        return None
    return "DEFLATE", 0


def extra_fields(extra: bytes | None) -> dict[str, int]:
    """What known compressors put into a gzip header's extra field. Sizes are little-endian."""
    out: dict[str, int] = {}
    if not extra or len(extra) < 4:
        return out
    number = lambda a, n: int.from_bytes(extra[a : a + n], "little")
    kind, size, whole = extra[:2], number(2, 2), len(extra)
    if kind == b"BC" and size == 2 and whole == 6:
        out["bgzf_block_size"] = number(4, 2) + 1
    if kind == b"IG" and size == 4 and whole == 8:
        out["indexed_gzip_block_size"] = number(4, 4)
    if kind == b"MZ" and size == 4 and whole == 8:
        out["migz_stream_size"] = number(4, 4)
    if kind == b"QZ" and size == 8 and whole == 12:
        out["qatzip_decompressed_size"], out["qatzip_stream_size"] = number(4, 4), number(8, 4)
    if kind == b"ZC" and size == 4 and whole >= 8:
        out["pgzf_stream_size"] = number(4, 4)
        if extra[8:12] == b"GC\x08\0" and whole == 20:
            out["pgzf_group_size"] = number(12, 8)
        if extra[8:12] == b"IX\x08\0" and whole >= 20:
            out["pgzf_index"] = 1
    if kind == b"RA" and whole >= 10:
        out["dictzip_version"], out["dictzip_chunk_size"], out["dictzip_chunks"] = number(4, 2), number(6, 2), number(8, 2)
    return out


# Writers: small ones, for fixtures and for windows of an index.


def gzip_member(payload: bytes | Iterable[bytes], level: int = 6, name: str | None = None, extra: bytes | None = None, mtime: int = 0) -> bytes:
    """One gzip member with whole header fields, which the standard library's writer doesn't offer together. Parts are taken one at a time."""
    import zlib

    z, body, crc, size = zlib.compressobj(level, zlib.DEFLATED, -15), [], 0, 0
    for part in (payload,) if isinstance(payload, (bytes, bytearray, memoryview)) else payload:
        body.append(z.compress(part))
        crc, size = zlib.crc32(part, crc), size + len(part)
    flags = FEXTRA * (extra is not None) | FNAME * (name is not None)
    head = GZIP + struct.pack("<BIBB", flags, mtime, 2 if level == 9 else 4 if level == 1 else 0, 3)
    if extra is not None:
        head += struct.pack("<H", len(extra)) + extra
    if name is not None:
        head += name.encode("latin-1", "replace") + b"\0"
    return b"".join([head, *body, z.flush(), struct.pack("<II", crc, size & 0xFFFFFFFF)])


def bgzf(payload: bytes, block: int = 65280, level: int = 6) -> bytes:
    out = []
    for at in range(0, len(payload), block):
        raw = gzip_member(payload[at : at + block], level, extra=b"BC\2\0\0\0")
        out.append(raw[:16] + struct.pack("<H", len(raw) - 1) + raw[18:])
    return b"".join(out) + BGZF_END
