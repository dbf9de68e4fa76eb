"""Variable-length numbers and run-length coding of byte strings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

RUN = 6  #: a shorter run costs more as a run than as literals
_RUNS = re.compile(rb"(.)\1{%d,}" % (RUN - 1), re.S)


def put_varint(n: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, bytes read); (0, 0) where the data end within a number or it has over 10 bytes."""
    n = 0
    for k, b in enumerate(data[at : at + 10]):
        n |= (b & 127) << 7 * k
        if b < 128:
            return n & (1 << 64) - 1, k + 1
    return 0, 0


def rle_encode(data: bytes) -> bytes:
    """Sections of (0, count, literals) and (1, count: more of the last byte), numbers as varints. A run's first byte is a literal."""
    out, at = bytearray(), 0
    while at < len(data):
        m = _RUNS.search(data, at)
        end = m.start() + 1 if m else len(data)
        out += b"\0" + put_varint(end - at) + data[at:end]
        if m:
            out += b"\1" + put_varint(m.end() - end)
        at = m.end() if m else end
    return bytes(out)


def rle_decode(data: bytes, size: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        kind, n = get_varint(data, at)
        count, m = get_varint(data, at + n)
        if not n or not m or kind > 1 or kind > len(out):
            raise ValueError("not a run-length coding")
        at += n + m
        if kind:
            out += out[-1:] * count
        else:
            if at + count > len(data):
                raise ValueError("literals go past the end")
            out += data[at : at + count]
            at += count
    if size is not None and size != len(out):
        raise ValueError("another size than the one stated")
    return bytes(out)


def _binary(f) -> Column:
    return arrow_udf(lambda col: pa.array([None if x is None else f(x) for x in col.to_pylist()], pa.binary()), T.BinaryType())


rle_encoded, rle_decoded = _binary(rle_encode), _binary(rle_decode)
varint = arrow_udf(lambda col: pa.array([None if x is None else put_varint(x) for x in col.to_pylist()], pa.binary()), T.BinaryType())
from_varint = arrow_udf(lambda col: pa.array([None if x is None else get_varint(x)[0] for x in col.to_pylist()], pa.int64()), T.LongType())
