"""CRC-32 of concatenations from the CRC-32 of their parts.

Appending n zero bytes multiplies a CRC by x**(8 n) modulo the polynomial, and the CRC of a concatenation is the
exclusive or of its parts' CRCs, each advanced by the bytes that follow it. So an ordered, associative fold becomes a
sum of bytes that follow (a window) and a bit_xor aggregate, which needs no order and combines partially.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

POLYNOMIAL = 0xEDB88320  # reflected: the highest bit is x**0


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the polynomial, of uint32 arrays."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def advance(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRCs advanced over `after` bytes each."""
    out, left = np.array(crc, np.uint32), np.array(after, np.int64)
    power = np.uint32(1 << 23)  # x**8
    while (left > 0).any():
        out = np.where(left & 1, times(out, power), out)
        power, left = times(power, power)[()], left >> 1
    return out


def combine(a: int, b: int, b_size: int) -> int:
    """The CRC of a concatenation of two byte strings with CRCs a and b."""
    return int(advance(np.array([a]), np.array([b_size]))[0]) ^ b


advanced = arrow_udf(lambda crc, after: pa.array(advance(crc.to_numpy(zero_copy_only=False), after.to_numpy(zero_copy_only=False)).astype(np.int64)), T.LongType())


def folded_crc(parts: DataFrame, keys: list[str], order: str, crc: str = "crc32", size: str = "size") -> DataFrame:
    """(keys, crc32, size): the CRC of each key's parts, concatenated in the order of `order`.

    No part's bytes are needed. Where one key has very many parts, fold by a prefix of them first: the result folds again."""
    after = F.sum(size).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    moved = parts.select(*keys, F.col(size).cast("long").alias("_n"), F.col(crc).cast("long").alias("_c"), F.coalesce(after, F.lit(0)).cast("long").alias("_after"))
    return moved.select(*keys, "_n", advanced("_c", "_after").alias("_c")).groupBy(*keys).agg(F.bit_xor("_c").alias("crc32"), F.sum("_n").alias("size"))
