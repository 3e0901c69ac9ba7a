"""Scalar functions of hex values, addresses and trace text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, FloatType


def to_hex(value: Column, n_bytes: int | None = None) -> Column:
    """Upper-case hex, padded to two digits a byte if n_bytes is given."""
    return F.hex(value) if n_bytes is None else F.lpad(F.hex(value), 2 * n_bytes, "0")


def swap_bytes(hex_text: Column) -> Column:
    """Hex of the same bytes in the other byte order."""
    return F.array_join(F.reverse(F.regexp_extract_all(hex_text, F.lit("(..)"), F.lit(1))), "")


def without_reserved(flags: Column, reserved: int = 0x2A) -> Column:
    """Flags with the processor's reserved bits cleared, 32 bits wide."""
    return flags.bitwiseAND(F.lit(0xFFFFFFFF - reserved))


def unsigned(hex_text: Column) -> Column:
    """Unsigned 64-bit value of hex text."""
    return F.conv(hex_text, 16, 10).cast("decimal(20,0)")


def signed(hex_text: Column, bits: int) -> Column:
    u = unsigned(hex_text)
    return F.when(u >= F.lit(Decimal(2 ** (bits - 1))), u - F.lit(Decimal(2**bits))).otherwise(u).cast("long")


def ascii_of_hex(hex_text: Column, every_second: bool = False) -> Column:
    """Printable characters of hex bytes, a block sign for the others; every_second: of the bytes 0, 2, 4, ... only."""
    pairs = F.regexp_extract_all(hex_text, F.lit("(..).?.?" if every_second else "(..)"), F.lit(1))
    codes = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))
    return F.array_join(F.transform(codes, lambda c: F.when(c.between(32, 126), F.char(c)).otherwise(F.lit("■"))), "")


def hex_of_ascii(text: Column, wide: bool = False) -> Column:
    """Hex of a text's characters; wide: each behind a zero byte."""
    h = F.hex(F.encode(text, "ISO-8859-1"))
    return F.regexp_replace(h, "(..)", "00$1") if wide else h


def split_keeping(text: Column, pattern: str) -> Column:
    """Parts of a text, each with the delimiter that ends it; the last part has none."""
    marked = F.regexp_replace(text, f"({pattern})", "$1\u0000")
    return F.split(marked, "\u0000", -1)


def offset_text(offset: Column, digits: int = 19) -> Column:
    """An offset as text of fixed width."""
    return F.lpad(offset.cast("string"), digits, "0")


def hex_text(hex_value: Column) -> Column:
    """Memory-view text: question marks dropped, leading zero bytes dropped, NUL shown as \\0."""
    clean = F.regexp_replace(F.regexp_replace(hex_value, r"\?", ""), "^(00)+", "")
    codes = F.transform(F.regexp_extract_all(clean, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.array_join(F.transform(codes, lambda c: F.when(c == 0, F.lit("\\0")).otherwise(F.char(c))), "")


def module_base(module: Column) -> Column:
    """Module name up to its first dot; the whole name if it has none."""
    return F.substring_index(module, ".", 1)


def file_of_path(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)


def tree_id(level: int, line: Column, base: int = 1000, height: int = 4) -> Column:
    """Number of the aggregate node of a level (0: the root) that covers a line in a tree of this base and height."""
    root = sum(base ** (height - i) for i in range(1, level + 1))
    return (F.lit(root) + F.floor(line / base ** (height - level))).cast("long")


def digit(line: Column, place: int, base: int = 1000) -> Column:
    return (F.floor(line / base**place) % base).cast("long")


def without_first_token(line: Column) -> Column:
    """A trace line as the diff compares it: without its leading token."""
    return F.regexp_replace(line, "^[a-zA-Z0-9]* ", "")


def message_text(hex_bytes: Column, length: Column | None = None) -> Column:
    """First line of the text that hex bytes hold, trimmed; of a sent message of `length` bytes all but the last count."""
    if length is not None:
        hex_bytes = F.substring(hex_bytes, F.lit(1), F.greatest(length - 1, F.lit(0)) * 2)
    return F.trim(F.substring_index(F.decode(F.unhex(hex_bytes), "ISO-8859-1"), "\n", 1))


def succeeded(rax_hex: Column) -> Column:
    """Whether the low half of a return value is not zero."""
    return F.right(rax_hex, F.lit(8)) != "00000000"


def shortened(text: Column) -> Column:
    """Numbers as the register view shows them: ten characters and dots if longer than thirteen."""
    return F.when(F.length(text) > 13, F.concat(F.substring(text, 1, 10), F.lit("..."))).otherwise(text)


@pandas_udf(DoubleType())
def float64_of_hex(h):
    """Double of sixteen hex digits, big end first; other texts give null."""
    import struct

    def one(x):
        try:
            return struct.unpack(">d", bytes.fromhex(x))[0]
        except (ValueError, TypeError, struct.error):
            return None

    return h.map(one)


@pandas_udf(FloatType())
def float32_of_hex(h):
    """Float of eight hex digits, big end first; other texts give null."""
    import struct

    def one(x):
        try:
            return struct.unpack(">f", bytes.fromhex(x))[0]
        except (ValueError, TypeError, struct.error):
            return None

    return h.map(one)


@pandas_udf(DoubleType())
def float80_of_hex(h):
    """Double next to an x87 number of twenty hex digits, big end first; other texts give null."""

    def one(x):
        try:
            raw = int(x, 16)
        except (ValueError, TypeError):
            return None
        if len(x) != 20:
            return None
        sign, exponent, mantissa = raw >> 79, raw >> 64 & 0x7FFF, raw & (1 << 64) - 1
        if exponent == 0x7FFF:
            value = float("inf") if mantissa << 1 & (1 << 64) - 1 == 0 else float("nan")
        else:
            try:
                value = mantissa * 2.0 ** (max(exponent, 1) - 16383 - 63)
            except OverflowError:
                value = float("inf")
        return -value if sign else value

    return h.map(one)
