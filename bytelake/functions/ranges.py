"""The range expressions `size@offset[,...]`: bytes or lines, with decimal and binary prefixes."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

ALL = (1 << 63) - 1  #: the size `inf`
SCHEMA = "ordinal int, offset long, size long, offset_is_line boolean, size_is_line boolean"

# Decimal prefixes are powers of 1000; with an i they are powers of 1024.
PREFIXES = "kMGTPE"

_NUMBER = re.compile(r"(?P<n>[0-9]+)\s*(?:(?P<prefix>[kKMGTPE]i|[kMGTPE])?)\s*(?P<unit>[BL]?)")


class Range(NamedTuple):
    offset: int
    size: int
    offset_is_line: bool = False
    size_is_line: bool = False


def _amount(text: str) -> tuple[int, bool]:
    m = _NUMBER.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a size or offset: {text!r}")
    prefix, n = m["prefix"] or "", int(m["n"])
    if prefix:
        n *= (1024 if prefix.endswith("i") else 1000) ** (PREFIXES.index(prefix[0].replace("K", "k")) + 1)
    return n, m["unit"] == "L"


def parse_ranges(expression: str) -> list[Range]:
    """The ranges in their order. Blanks and empty items are ignored; ValueError where an item has another form."""
    out = []
    for item in expression.split(","):
        if not item.strip():
            continue
        size, at, offset = item.partition("@")
        if not at:
            raise ValueError(f"no @ in {item!r}")
        n, lines = (ALL, False) if size.strip() == "inf" else _amount(size)
        start, in_lines = _amount(offset)
        out.append(Range(start, n, in_lines, lines))
    return out


def ranges_frame(spark: SparkSession, expression: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(parse_ranges(expression))], SCHEMA)
