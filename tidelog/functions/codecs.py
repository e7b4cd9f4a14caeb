"""Fixed-width and variable-length integers in BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(b: Column, i: int | Column) -> Column:
    """The byte at 0-based place i, as a number."""
    return F.conv(F.hex(F.substring(b, i + 1, F.lit(1)) if isinstance(i, Column) else F.substring(b, i + 1, 1)), 16, 10).cast("bigint")


def decode_fixed_le(b: Column, width: int = 8) -> Column:
    """An unsigned little-endian integer, as DECIMAL: 64-bit ones overflow BIGINT."""
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(width):
        total = total + byte_at(b, i).cast("decimal(20,0)") * F.lit(str(1 << (8 * i))).cast("decimal(20,0)")
    return total.cast("decimal(38,0)")


def encode_fixed_be(x: Column, width: int = 8) -> Column:
    """A non-negative BIGINT so that byte order is number order."""
    return F.unhex(F.lpad(F.hex(x), 2 * width, "0"))


def encode_varint(x: Column, most: int = 10) -> Column:
    """Seven bits a byte, lowest first, the high bit set on all but the last; a negative number counts as unsigned, of 64 bits."""
    groups = F.sequence(F.lit(0), F.floor((F.length(F.bin(x)) - 1) / 7).cast("int"))
    bits = lambda g: F.call_function("shiftrightunsigned", x.cast("bigint"), g * 7).bitwiseAND(F.lit(127))
    parts = F.transform(groups, lambda g: F.lpad(F.hex(bits(g) + F.when(g < F.size(groups) - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(parts, ""))


def decode_varint(b: Column) -> Column:
    """The integer at the start of ``b``, of 64 bits; bytes after its last are ignored."""
    places = F.sequence(F.lit(0), F.length(b) - 1)
    digits = F.transform(places, lambda i: F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    # shifts wrap as 64-bit numbers do, where products would overflow
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("k"), F.lit(True).alias("on"))
    step = lambda a, d: F.struct((a["v"].bitwiseOR(F.when(a["on"], F.call_function("shiftleft", F.pmod(d, F.lit(128)), a["k"])).otherwise(F.lit(0)))).alias("v"), F.when(a["on"], a["k"] + 7).otherwise(a["k"]).alias("k"), (a["on"] & (d >= 128)).alias("on"))
    return F.aggregate(digits, start, step, lambda a: a["v"])
