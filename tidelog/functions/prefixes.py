"""Key transforms for prefix scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(key: Column, n: int) -> Column:
    """The first n characters or bytes; null, out of the domain, for shorter keys."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped(key: Column, n: int) -> Column:
    """At most the first n characters or bytes: every key is in the domain."""
    return F.substring(key, 1, n)


def noop(key: Column) -> Column:
    return key


REGISTRY = {"fixed": fixed, "capped": capped, "noop": noop}


def from_string(text: str):
    """``fixed:4`` or ``capped:4`` or ``noop`` to a function of a key column."""
    name, _, n = text.partition(":")
    return (lambda key: REGISTRY[name](key, int(n))) if n else REGISTRY[name]
