"""Deflate streams: a walker over blocks for analysis, finders of block starts, and decoding from any block start.

Decoding uses zlib alone. zlib starts at a whole byte; for a block that starts at another bit, empty blocks of as many bits
modulo 8 go before it, so that the rest of the data keeps its place (stored blocks are aligned to bytes). From an unknown history a chunk is decoded with three made-up dictionaries; where the results
differ a byte is a reference into the history, and the three bytes say to which place. `Planes` holds that as arrays:
the literal bytes, and for each byte the place in the 32 KiB window or none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np

WINDOW = 32 << 10

# Fixed values of RFC 1951: the order of code lengths in a dynamic block's header, and its counts' limits.
ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
LITERALS, DISTANCES = 286, 30
LENGTHS_MOST = (LITERALS + DISTANCES) * 14 // 8 + 2  #: bytes that the code lengths of a header take at most, 7 bits and 7 more each
NAMES = {0: "UNCOMPRESSED", 1: "FIXED", 2: "DYNAMIC"}


class Corrupt(ValueError):
    pass


def _steps(n: int, group: int, start: int) -> tuple[list[int], list[int]]:
    """(first value, extra bits) of n codes: `2 * group` without extra bits, then a bit more after each `group` codes."""
    base, extra, at = [], [], start
    for k in range(n):
        bits = max(0, k // group - 1)
        base.append(at)
        extra.append(bits)
        at += 1 << bits
    return base, extra


LENGTH_BASE, LENGTH_EXTRA = _steps(28, 4, 3)
LENGTH_BASE, LENGTH_EXTRA = [*LENGTH_BASE, 258], [*LENGTH_EXTRA, 0]  # the last length has a code of its own
DISTANCE_BASE, DISTANCE_EXTRA = _steps(30, 2, 1)


class Bits:
    """Reads from the lowest bit of each byte on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7) & (1 << n) - 1

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise Corrupt("the data end within a block")
        out = self.peek(n)
        self.at += n
        return out


def decoder(lengths: list[int], one: bool = False) -> tuple[list[tuple[int, int]], int]:
    """A table from the next bits to (symbol, bits taken). The code must be complete; `one`: or empty, or one code of one bit."""
    of: list[list[int]] = [[] for _ in range(16)]  # the symbols of each length, ascending
    for symbol, n in enumerate(lengths):
        of[n].append(symbol)
    filled = sum(len(of[n]) << (15 - n) for n in range(1, 16))
    if filled != 1 << 15 and not (one and (not filled or filled == 1 << 14 and len(of[1]) == 1)):
        raise Corrupt("a code isn't complete")
    most = max((n for n in range(1, 16) if of[n]), default=1)
    table, code = [(-1, 0)] * (1 << most), 0
    for n in range(1, most + 1):
        for symbol in of[n]:
            table[BACK[code] >> (15 - n) :: 1 << n] = [(symbol, n)] * (1 << (most - n))
            code += 1
        code <<= 1
    return table, most


BACK = [0]  #: numbers of 15 bits, the last bit first
for _k in range(15):
    BACK += [x | 1 << (14 - _k) for x in BACK]
FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


@cache
def _fixed() -> tuple:
    return decoder(FIXED), decoder([5] * 32)


@dataclass
class Block:
    """One deflate block. Bits count from the start of the data, bytes of output from the start of the stream."""

    kind: str
    final: bool
    start: int
    header_end: int = 0
    end: int = 0
    decoded: int = 0
    size: int = 0
    precode: list[int] = field(default_factory=list)
    literal_lengths: list[int] = field(default_factory=list)
    distance_lengths: list[int] = field(default_factory=list)
    literals: int = 0
    flat: list[int] = field(default_factory=list)  #: place in the block's output, length and distance of each match, numbers in a row

    @property
    def matches(self) -> list[tuple[int, int, int]]:
        return list(zip(self.flat[::3], self.flat[1::3], self.flat[2::3]))


def read_block_header(data: bytes, at: int) -> Block:
    """The block at bit `at`, up to the end of its header; Corrupt where there is none."""
    b = Bits(data, at)
    final, kind = b.take(1), b.take(2)
    if kind == 3:
        raise Corrupt("a reserved type of block")
    block = Block(NAMES[kind], bool(final), at)
    if kind == 0:
        if b.take(-b.at % 8):
            raise Corrupt("padding isn't zero")
        size = b.take(16)
        if size ^ b.take(16) != 0xFFFF:
            raise Corrupt("a stored block's sizes differ")
        block.size = size
    elif kind == 1:
        block.literal_lengths, block.distance_lengths = FIXED, [5] * 32
    else:
        n_lit, n_dist, n_pre = b.take(5) + 257, b.take(5) + 1, b.take(4) + 4
        if n_lit > LITERALS or n_dist > DISTANCES:
            raise Corrupt("too many codes")
        pre = [0] * 19
        for k in ORDER[:n_pre]:
            pre[k] = b.take(3)
        block.precode = pre
        table, bits = decoder(pre, one=[n for n in pre if n] == [1])
        lengths: list[int] = []
        held, mask, most, taken = int.from_bytes(data[b.at >> 3 : (b.at >> 3) + LENGTHS_MOST], "little") >> (b.at & 7), (1 << bits) - 1, n_lit + n_dist, 0
        while len(lengths) < most:
            symbol, n = table[held & mask]
            if symbol < 0:
                raise Corrupt("no such code")
            held >>= n
            taken += n
            if symbol < 16:
                lengths.append(symbol)
                continue
            if symbol == 16 and not lengths:
                raise Corrupt("nothing to repeat")
            extra = 2 if symbol == 16 else 3 if symbol == 17 else 7
            lengths += (lengths[-1:] if symbol == 16 else [0]) * ((11 if symbol == 18 else 3) + (held & (1 << extra) - 1))
            held >>= extra
            taken += extra
        b.take(taken)
        if len(lengths) > n_lit + n_dist or not lengths[256]:
            raise Corrupt("code lengths are wrong")
        block.literal_lengths, block.distance_lengths = lengths[:n_lit], lengths[n_lit:]
    block.header_end = b.at
    return block


def walk(data: bytes, at: int = 0, history: int = 0):
    """The blocks of one deflate stream from bit `at` on, each with its symbols counted; `history`: bytes of output before it."""
    decoded = history
    while True:
        block = read_block_header(data, at)
        block.decoded = decoded - history
        if block.kind == "UNCOMPRESSED":
            block.end = block.header_end + 8 * block.size
            block.literals = block.size
            if block.end > 8 * len(data):
                raise Corrupt("the data end within a block")
        else:
            (lit, lit_bits), (dist, dist_bits) = _fixed() if block.kind == "FIXED" else (decoder(block.literal_lengths, one=True), decoder(block.distance_lengths, one=True))
            lit_mask, dist_mask, flat = (1 << lit_bits) - 1, (1 << dist_bits) - 1, block.flat
            byte, skip = divmod(block.header_end, 8)
            held = data[byte : byte + 32]  # bits that were read but not yet used, the next one lowest
            bits, left, byte = int.from_bytes(held, "little") >> skip, 8 * len(held) - skip, byte + 32
            out = copied = 0
            while True:
                if left < 64:
                    if left < 0:
                        raise Corrupt("the data end within a block")
                    held = data[byte : byte + 32]
                    bits |= int.from_bytes(held, "little") << max(left, 0)
                    left, byte = left + 8 * len(held), byte + 32
                symbol, n = lit[bits & lit_mask]
                bits >>= n
                left -= n
                if symbol < 256:
                    if symbol < 0:
                        raise Corrupt("no such code")
                    out += 1
                    continue
                if symbol == 256:
                    break
                if symbol > 285:
                    raise Corrupt("no such code")
                extra = LENGTH_EXTRA[symbol - 257]
                length = LENGTH_BASE[symbol - 257] + (bits & (1 << extra) - 1)
                bits >>= extra
                symbol, n = dist[bits & dist_mask]
                if symbol < 0 or symbol > 29:
                    raise Corrupt("no such distance")
                more = DISTANCE_EXTRA[symbol]
                distance = DISTANCE_BASE[symbol] + (bits >> n & (1 << more) - 1)
                bits >>= n + more
                left -= extra + n + more
                if left < 0:
                    raise Corrupt("the data end within a block")
                if distance > decoded + out:
                    raise Corrupt("a reference before the start")
                flat += out, length, distance
                out += length
                copied += length
            if left < 0:
                raise Corrupt("the data end within a block")
            block.literals, at = out - copied, 8 * min(byte, len(data)) - left
            block.size, block.end = out, at
        decoded, at = decoded + block.size, block.end
        yield block
        if block.final:
            return


# Finding block starts.


def _empty_blocks() -> list[str]:
    """For each number of bits 0 to 7, empty blocks of as many bits modulo 8, in the order of the stream."""
    low_first = lambda value, n: f"{value:0{n}b}"[::-1]
    fixed = "0" + low_first(1, 2) + "0" * 7  # 10 bits: a header and the end of the block
    lengths = {18: 1, 0: 2, 1: 2}
    zeros = lambda n: "0" + low_first(n - 11, 7)  # noqa: E731  the code of 18
    dynamic = "0" + low_first(2, 2) + low_first(0, 5) + low_first(0, 5) + low_first(15, 4) + "".join(low_first(lengths.get(k, 0), 3) for k in ORDER) + zeros(138) + zeros(118) + "11" + "10" + "0"
    assert len(dynamic) % 2 == 1
    return [dynamic * (r % 2) + fixed * ((r - r % 2 * len(dynamic)) % 8 // 2) for r in range(8)]


_EMPTY = _empty_blocks()


def primed(data: bytes, at: int, stop: int) -> tuple[bytes, int]:
    """(bytes that zlib decodes from the block at bit `at` on, up to byte `stop`; whole bytes in front that aren't of the data)."""
    bits, first = _EMPTY[at & 7], at >> 3
    if not bits:
        return data[first:stop], 0
    n = int(bits[::-1], 2) | (data[first] >> (at & 7) << (at & 7) if first < len(data) else 0) << (len(bits) & ~7)
    return n.to_bytes((len(bits) >> 3) + 1, "little") + data[first + 1 : stop], len(bits) >> 3


def dynamic_candidates(data: bytes, start: int, stop: int) -> np.ndarray:
    """Bits in [start, stop) where a dynamic block that isn't the last may begin: its type, counts and a complete precode."""
    first = start >> 3
    raw = np.frombuffer(data[first : (stop >> 3) + 16], np.uint8)
    n = len(raw) - 3
    if n <= 0:
        return np.zeros(0, np.int64)
    word = raw[: n].astype(np.uint32) | raw[1 : n + 1].astype(np.uint32) << np.uint32(8) | raw[2 : n + 2].astype(np.uint32) << np.uint32(16) | raw[3 : n + 3].astype(np.uint32) << np.uint32(24)
    found = []
    for r in range(8):
        v = word >> np.uint32(r)
        ok = ((v & np.uint32(7)) == 4) & ((v >> np.uint32(3) & np.uint32(31)) < 30) & ((v >> np.uint32(8) & np.uint32(31)) < 30)
        found.append(8 * np.flatnonzero(ok) + r)
    at = np.sort(np.concatenate(found))
    at = at[(at + 8 * first >= start) & (at + 8 * first < stop)]
    take = lambda p, k: (word[np.minimum(p >> 3, n - 1)] >> (p & 7).astype(np.uint32)) & np.uint32((1 << k) - 1)
    codes = take(at + 13, 4) + 4
    leaves, used = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(19):
        length = np.where(k < codes, take(at + 17 + 3 * k, 3), 0).astype(np.int64)
        leaves += np.where(length > 0, 128 >> length, 0)
        used += length > 0
    return at[(leaves == 128) | (leaves == 64) & (used == 1)] + 8 * first


def stored_candidates(data: bytes, start: int, stop: int) -> np.ndarray:
    """Bits in [start, stop) where a stored block that isn't the last may begin, taken right before its sizes."""
    first = max(0, (start >> 3) - 1)
    raw = np.frombuffer(data[first : (stop >> 3) + 8], np.uint8).astype(np.uint32)
    if len(raw) < 5:
        return np.zeros(0, np.int64)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    sizes = np.flatnonzero((two[:-2] ^ two[2:]) == 0xFFFF)
    at = 8 * (sizes[sizes > 0] + first) - 3
    ok = np.array([data[(a + 3 >> 3) - 1] >> 5 == 0 for a in at], bool)
    at = at[ok] if len(at) else at
    return at[(at >= start) & (at < stop)]


def flushed_starts(data: bytes, start: int = 0, stop: int | None = None) -> list[int]:
    """Bytes at which blocks begin after an empty stored block, which some compressors put between the parts of theirs."""
    out, at, stop = [], data.find(b"\0\0\xff\xff", start), len(data) if stop is None else stop
    while 0 <= at < stop:
        out.append(at + 4)
        at = data.find(b"\0\0\xff\xff", at + 1)
    return out


def starts_block(data: bytes, at: int, most: int = 1 << 17) -> bool:
    """Whether zlib decodes without an error from bit `at` on, over some `most` bytes of input."""
    d = zlib.decompressobj(-15, zdict=bytes(WINDOW))
    try:
        out = len(d.decompress(primed(data, at, (at >> 3) + most)[0], 1 << 22))
    except zlib.error:
        return False
    return out > 0 or d.eof


def find_start(data: bytes, start: int, stop: int, step: int = 8 << 13, limit: int = 8 << 19) -> int | None:
    """The first bit in [start, stop) where a block begins, or a member's first block; None if there is none in `limit` bits.

    Looks at `step` bits at a time. Only dynamic and stored blocks that aren't their stream's last, and heads of
    members, are found; a caller joins a range without any to the one before."""
    from bytelake.functions.formats import gzip_header

    for low in range(start, min(stop, start + limit), step):
        high = min(low + step, stop)
        found = [(int(c), int(c)) for c in (*dynamic_candidates(data, low, high), *stored_candidates(data, low, high))]
        at = data.find(b"\x1f\x8b\x08", low >> 3, (high >> 3) + 2)
        while 0 <= at and 8 * at < high:
            if (h := gzip_header(data, at)) and start <= 8 * h.end < stop:
                found.append((8 * at, 8 * h.end))
            at = data.find(b"\x1f\x8b\x08", at + 1, (high >> 3) + 2)
        for _, bit in sorted(found):
            if starts_block(data, bit):
                return bit
    return None


# Decoding from a block start.


@dataclass
class Piece:
    """Output of one member or a part of it; `end`: whether the member ends here, with its footer."""

    data: bytes
    fresh: bool  #: whether the member begins here, so that nothing before it is referred to
    end: bool = False
    crc: int | None = 0
    size: int | None = 0
    meets: bool = False  #: whether a block, or the next member's first, begins right where the range stops


def meets(d, data: bytes, stop: int) -> bool:
    """Whether the stream that `d` has read up to the last whole byte before bit `stop` has a block's start there. A last, empty stored
    block put there ends the stream with its own last byte then; within a block its bits are read as something else."""
    r = stop & 7
    header = 1 << r | (data[stop >> 3] & (1 << r) - 1 if r else 0)
    c = d.copy()
    try:
        c.decompress(header.to_bytes(1 + (r > 5), "little") + b"\0\0\xff\xff")
    except zlib.error:
        return False
    return c.eof and not c.unused_data


def stream(data: bytes, at: int, end: int, history: bytes = b"", step: int = 1 << 16, stop: int | None = None):
    """Output of the stream from the block at bit `at`, a step of input at a time, then the byte where the stream ends (None: not
    before byte `end`). Steps keep what follows a short stream from being copied with it. `stop`: a bit of the last byte at which a
    block should begin; if the stream does not end before, the last value is None or, where one does begin there, -1."""
    d = zlib.decompressobj(-15, zdict=history) if history else zlib.decompressobj(-15)
    first, pos, met = at >> 3, at >> 3, None
    while pos < end and not d.eof:
        to = min(end, pos + step)
        if stop is not None and to == end and stop >> 3 < end:
            to = max(pos + 1, stop >> 3)
        yield d.decompress(primed(data, at, to)[0] if pos == first else data[pos:to])
        pos = to
        if stop is not None and pos == stop >> 3 and not d.eof and meets(d, data, stop):
            met = -1
    yield pos - len(d.unused_data) if d.eof else met


def inflated(data: bytes, start: int, stop: int, history: bytes, last: bool, raw: bool = False, check: bool = False):
    """The output of bits [start, stop) of an archive, both starts of blocks or its end, after `history`, a part at a time.

    `data` holds the archive from byte 0. Parts follow each other; one with `end` set ends its member, whose footer it tells (None for
    a `raw` stream, which has none); the next one, if any, begins the next member. `last`: the range goes to the end of the archive.
    `check`: the last part tells whether a block begins at `stop`."""
    from bytelake.functions.formats import gzip_footer, gzip_header

    at, fresh, end = start, not history, -(-stop // 8)
    if not last and start >= stop:
        return
    while True:
        held, foot, some = b"", None, False
        for got in stream(data, at, end, history, stop=stop if check and not last else None):
            if not isinstance(got, bytes):
                foot = got
                break
            if some:
                yield Piece(held, fresh)
            held, some = got, True
        if foot is None or foot < 0:
            if last and (at != start or some):
                raise Corrupt("the archive ends within a stream")
            yield Piece(held, fresh, meets=foot is not None)
            return
        if raw:
            yield Piece(held, fresh, True, None, None)
            return
        said = gzip_footer(data, foot)
        if said is None:
            raise Corrupt("the archive ends before its footer")
        head = gzip_header(data, foot + 8)
        yield Piece(held, fresh, True, *said, head is not None and 8 * head.end == stop)
        if head is None:  # what follows the last member is no part of the archive
            return
        at, history, fresh = 8 * head.end, b"", True
        if at >= stop and not last:
            return


def inflate(data: bytes, start: int, stop: int, history: bytes, last: bool, raw: bool = False) -> list[Piece]:
    """`inflated`, with each member's parts put together."""
    out, held = [], []
    for p in inflated(data, start, stop, history, last, raw):
        held.append(p.data)
        if p.end:
            out.append(Piece(b"".join(held), p.fresh, True, p.crc, p.size))
            held = []
    if held:
        out.append(Piece(b"".join(held), p.fresh))
    return out


# The places 0..32767 as pairs of bytes that differ: the lower byte of the place, and that plus one plus the upper byte.
DICTIONARIES = [bytes(range(256)) * 128, bytes((i + 1 + (i >> 8)) & 255 for i in range(WINDOW))]


@dataclass
class Planes:
    """Output whose history is unknown: a byte each, and the place in the window that it stands for (-1: itself)."""

    literal: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, first: bytes, second: bytes) -> Planes:
        """Of what the two dictionaries give; `second` may end where the two agree from there on."""
        a, b = np.frombuffer(first, np.uint8), np.frombuffer(second, np.uint8)
        place = np.full(len(a), -1, np.int16)
        low = a[: len(b)]
        place[: len(b)] = np.where(low != b, (b - low - np.uint8(1)).astype(np.int16) << 8 | low, -1)
        return cls(a, place)

    def tail(self) -> Planes:
        return Planes(self.literal[-WINDOW:], self.place[-WINDOW:])

    def markers(self) -> int:
        return int((self.place >= 0).sum())

    def resolve(self, window: bytes) -> bytes:
        w = np.frombuffer(window.rjust(WINDOW, b"\0")[-WINDOW:], np.uint8)
        return np.where(self.place >= 0, w[np.maximum(self.place, 0)], self.literal).astype(np.uint8).tobytes()


def used_places(place: np.ndarray) -> np.ndarray:
    """The places of the window that output refers to, ascending."""
    seen = np.zeros(WINDOW, bool)
    seen[place[place >= 0]] = True
    return np.flatnonzero(seen)


@dataclass
class Lead:
    """What a chunk says before its history is known: sizes, the places of the window that it refers to, its last 32 KiB."""

    decoded: int = 0
    ends: bool = False  #: whether its last member ends within it
    fresh: bool = False  #: whether its last member begins within it
    meets: bool = False  #: whether a block begins where it stops
    tail: Planes | None = None
    used: np.ndarray = field(default_factory=lambda: np.zeros(WINDOW, bool))


def lead(data: bytes, start: int, stop: int, last: bool, raw: bool = False, known: bool = False) -> Lead:
    """Decode bits [start, stop) after an unknown history (`known`: after none), a step at a time, holding 32 KiB.

    The first stream goes through both dictionaries, until 32 KiB without a reference into the history have gone by."""
    out, literal, place = Lead(), b"", np.zeros(0, np.int16)
    one = inflated(data, start, stop, b"" if known else DICTIONARIES[0], last, raw, True)
    two, alike = None if known else inflated(data, start, stop, DICTIONARIES[1], last, raw, True), 0
    for p in one:
        if out.ends:  # a member begins
            literal, place = b"", place[:0]
            two = None
        got = p.data
        out.decoded, out.ends, out.fresh, out.meets = out.decoded + len(got), p.end, p.fresh, p.meets
        marks = np.full(min(len(got), WINDOW), -1, np.int16)
        if two is not None:
            other = next(two).data
            if len(other) != len(got):
                raise Corrupt("two decodings differ in length")
            if other == got:
                alike += len(got)
            else:
                all_marks = Planes.of(got, other).place
                at = np.flatnonzero(all_marks >= 0)
                out.used[all_marks[at]] = True
                alike, marks = len(got) - 1 - int(at[-1]), all_marks[-WINDOW:]
            if alike >= WINDOW:
                two = None
        literal, place = (literal + got[-WINDOW:])[-WINDOW:], np.concatenate([place, marks])[-WINDOW:]
    out.tail = Planes(np.frombuffer(literal, np.uint8), place)
    return out


def next_window(window: bytes, tail: bytes) -> bytes:
    """The last 32 KiB of what ends with `tail` after `window`."""
    return (window + tail)[-WINDOW:]
