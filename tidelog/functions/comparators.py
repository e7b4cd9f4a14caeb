"""Orders of keys by name: each maps a key to a column whose own order is the order wanted.

A comparator of the user's is such a function, so that sorting, range partitioning and bounds stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import decode_fixed_le

Comparator = Callable[[Column], Column]


def bytewise(key: Column) -> Column:
    """Unsigned bytes, shorter prefixes first."""
    return key.cast("binary")


def reverse_bytewise(key: Column) -> Column:
    """Unsigned bytes downwards, longer ones first: each byte is flipped, and an end is larger than any byte."""
    flipped = F.translate(F.hex(key.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(flipped, F.lit("G"))


def uint64(key: Column) -> Column:
    """Eight little-endian bytes as an unsigned number."""
    return decode_fixed_le(key, 8)


def with_timestamp(key: Column) -> Column:
    """Keys that end in eight big-endian bytes of a timestamp: by what comes before it, the newest first."""
    b = key.cast("binary")
    return F.struct(F.substring(F.hex(b), F.lit(1), 2 * F.length(b) - 16).alias("key"), F.translate(F.substring(F.hex(b), 2 * F.length(b) - 15, F.lit(16)), "0123456789ABCDEF", "FEDCBA9876543210").alias("ts"))


REGISTRY: dict[str, Comparator] = {"bytewise": bytewise, "reverse_bytewise": reverse_bytewise, "uint64": uint64, "with_timestamp": with_timestamp}


def register(name: str, comparator: Comparator) -> None:
    REGISTRY[name] = comparator


def get(name: str) -> Comparator:
    if name not in REGISTRY:
        raise ValueError(f"there is no comparator of the name {name!r}")
    return REGISTRY[name]
