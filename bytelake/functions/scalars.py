"""Scalar functions as column expressions: they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that gzip headers' codes stand for (RFC 1952) and units of sizes.
SYSTEMS = {
    0: "FAT filesystem (MS-DOS, OS/2, NT/Win32)", 1: "Amiga", 2: "VMS (or OpenVMS)", 3: "Unix", 4: "VM/CMS", 5: "Atari TOS", 6: "HPFS filesystem (OS/2, NT)",
    7: "Macintosh", 8: "Z-System", 9: "CP/M", 10: "TOPS-20", 11: "NTFS filesystem (NT)", 12: "QDOS", 13: "Acorn RISCOS",
}
EXTRA_FLAGS = {0: "none", 2: "compressor used maximum compression, slowest algorithm", 4: "compressor used fastest algorithm"}
UNITS = ["EiB", "PiB", "TiB", "GiB", "MiB", "KiB", "B"]


def format_bits(bits: Column) -> Column:
    """`N B M b`: whole bytes and the bits beyond them."""
    return F.concat_ws(" ", F.floor(bits / 8).cast("string"), F.lit("B"), (bits % 8).cast("string"), F.lit("b"))


def format_bytes(size: Column) -> Column:
    """All binary units that aren't zero, largest first; `0 B` for none."""
    parts = [F.when(digit != 0, F.concat_ws(" ", digit.cast("string"), F.lit(unit))) for k, unit in enumerate(UNITS) for digit in [F.shiftright(size.cast("long"), 10 * (6 - k)) % 1024]]
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", *parts))


def ceil_div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers from 0 up, rounded up, in whole numbers."""
    return F.floor((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")


def abs_diff(a: Column, b: Column) -> Column:
    return F.greatest(a, b) - F.least(a, b)


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of longs that stops at the ends of their range."""
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    safe_a = F.when(b > 0, F.least(a, high - F.greatest(b, F.lit(0)))).otherwise(F.greatest(a, low - F.least(b, F.lit(0))))
    return safe_a + b


def starts_with(text: Column, prefix: Column, case_sensitive: bool = True) -> Column:
    return F.startswith(text, prefix) if case_sensitive else F.startswith(F.lower(text), F.lower(prefix))


def ends_with(text: Column, suffix: Column, case_sensitive: bool = True) -> Column:
    return F.endswith(text, suffix) if case_sensitive else F.endswith(F.lower(text), F.lower(suffix))


def split_fields(text: Column, separator: str) -> Column:
    """Fields between one-character separators; only an empty last field is left out."""
    fields = F.split(text, "[\\\\]" if separator == "\\" else f"[{separator}]", -1)
    return F.when(F.element_at(fields, -1) == "", F.slice(fields, 1, F.size(fields) - 1)).otherwise(fields)


def is_base64(text: Column) -> Column:
    """Whether all characters are of the base64 alphabet (without =) or line feeds."""
    return F.length(F.translate(text, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/\n", "")) == 0


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    return reduce(lambda c, kv: c.when(code == kv[0], kv[1]), list(names.items())[1:], F.when(code == 0, names[0])).otherwise(other)


def system_name(code: Column) -> Column:
    return _named(code, SYSTEMS, F.lit("unknown"))


def extra_flags_name(code: Column) -> Column:
    return _named(code, EXTRA_FLAGS, F.concat(F.lit("undefined ("), code.cast("string"), F.lit(")")))


def has_crc32(file_type: Column) -> Column:
    return file_type.isin("GZIP", "BGZF")


def low_mask(bits: Column) -> Column:
    """A long whose lowest `bits` (0 to 63) bits are set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1


def reverse_bits(value: Column, width: int) -> Column:
    """The lowest `width` (1 to 63) bits in the opposite order."""
    v = value.cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), width - 1 - i) for i in range(width)])


def byte_swap(value: Column, size: int = 8) -> Column:
    """The bytes of a whole number of `size` bytes in the opposite order."""
    v = value.cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)), 8 * (size - 1 - i)) for i in range(size)])


def bits_required(states: Column) -> Column:
    """Bits that tell `states` (1 or more) states apart."""
    return F.when(states <= 1, 0).otherwise(F.length(F.bin(states.cast("long") - 1))).cast("int")


def bucket_start(offset: Column, spacing: int) -> Column:
    """The start of the grid cell of `spacing` that an offset lies in."""
    return offset - F.pmod(offset, F.lit(spacing))


def ranges_intersect(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two closed intervals share a point."""
    return (a_low <= b_high) & (b_low <= a_high)


def newline_count(data: Column, newline: str = "\n") -> Column:
    """How many times a one-byte character stands in a string."""
    return (F.length(data) - F.length(F.replace(data, F.lit(newline), F.lit("")))).cast("long")


def type_by_magic(content: Column) -> Column:
    """GZIP, BGZF, ZLIB or BZIP2 by the first bytes alone, without Python; null for anything else, raw deflate included."""
    head = F.hex(F.substring(content, 1, 18))
    first = F.conv(F.substring(head, 1, 4), 16, 10).cast("int")
    gzip = F.startswith(head, F.lit("1F8B08"))
    bgzf = gzip & (F.substring(head, 21, 12) == "060042430200") & (F.conv(F.substring(head, 7, 2), 16, 10).cast("int").bitwiseAND(4) != 0)
    zlib = (F.substring(head, 2, 1) == "8") & (F.substring(head, 1, 1) <= "7") & (first % 31 == 0) & (first.bitwiseAND(32) == 0)
    return F.when(bgzf, "BGZF").when(gzip, "GZIP").when(zlib, "ZLIB").when(F.substring(head, 1, 8).between("425A6831", "425A6839"), "BZIP2")
