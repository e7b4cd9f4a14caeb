"""Merge operators: folds of an ordered operand array onto a base.

Every operator is a function (base, operands) of columns, where operands is an array of struct(seq, value), oldest
first, and base is null if there is none. A missing operator is an error, as in :func:`get`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import byte_at

Operator = Callable[[Column, Column], Column]
U64 = 1 << 64


def values(operands: Column) -> Column:
    return F.transform(operands, lambda x: x["value"])


def put(base: Column, operands: Column) -> Column:
    return F.element_at(operands, -1)["value"]


def add(base: Column, operands: Column) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return F.coalesce(base.cast("decimal(38,0)"), zero) + F.aggregate(values(operands), zero, lambda a, x: (a + F.coalesce(x.cast("decimal(38,0)"), zero)).cast("decimal(38,0)"))


def uint64add(base: Column, operands: Column) -> Column:
    """Sum of unsigned 64-bit numbers, modulo 2**64, as DECIMAL."""
    return F.pmod(add(base, operands), F.lit(str(U64)).cast("decimal(38,0)"))


def largest(base: Column, operands: Column) -> Column:
    return F.array_max(F.array_compact(F.concat(F.array(base), values(operands))))


def string_append(delimiter: str = ",") -> Operator:
    """The base, if any, and the operands; empty values keep their delimiters."""

    def fold(base: Column, operands: Column) -> Column:
        return F.array_join(F.concat(F.when(base.isNull(), F.array().cast("array<string>")).otherwise(F.array(base)), values(operands)), delimiter)

    return fold


def sort_list(base: Column, operands: Column) -> Column:
    """Operands are comma lists of sorted integers; the result is their merge. The base is ignored."""
    return F.array_join(F.array_sort(F.flatten(F.transform(values(operands), lambda x: F.split(x, ",").cast("array<bigint>")))), ",")


def bytes_xor(base: Column, operands: Column) -> Column:
    """Bytewise exclusive or; the tail of the longer value is copied. Values are BINARY."""
    whole = F.concat(F.array(base), values(operands))

    def step(a: Column, b: Column) -> Column:
        n = F.greatest(F.length(a), F.length(b))
        one = lambda x, i: F.when(i < F.length(x), byte_at(x, i)).otherwise(F.lit(0).cast("bigint"))
        both = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(one(a, i).bitwiseXOR(one(b, i))), 2, "0"))
        return F.when(b.isNull(), a).when(a.isNull() | (F.length(a) == 0), b).when(n == 0, a).otherwise(F.unhex(F.array_join(both, "")))

    return F.aggregate(whole, F.lit(None).cast("binary"), step)


def with_times(operator: Operator) -> Operator:
    """An operator over values that carry a write time: struct(value, write_time). The result has the newest time of what went into it."""

    def fold(base: Column, operands: Column) -> Column:
        plain = F.transform(operands, lambda x: F.struct(x["seq"].alias("seq"), x["value"]["value"].alias("value")))
        times = F.transform(operands, lambda x: x["value"]["write_time"])
        value = operator(base["value"], plain)
        # the result takes the place of a value, so that it has a value's type
        return F.struct(value.cast("bigint").alias("value"), F.array_max(F.concat(F.array_compact(F.array(base["write_time"])), times)).alias("write_time"))

    return fold


def last_n(n: int) -> Operator:
    """Only the newest n operands count and the base does not: an operator that stops the search early."""
    return lambda base, operands: F.aggregate(F.slice(values(operands), F.greatest(F.lit(1), F.size(operands) - n + 1), n), F.lit(0).cast("bigint"), lambda a, x: a + x)


REGISTRY: dict[str, Operator] = {"put": put, "put_v1": put, "add": add, "uint64add": uint64add, "max": largest, "stringappend": string_append(), "stringappendtest": string_append(), "sortlist": sort_list, "bytesxor": bytes_xor}


def register(name: str, operator: Operator) -> None:
    """Makes a user's operator known by name; it may be a built-in expression or call a Pandas UDF."""
    REGISTRY[name] = operator


def get(name: str) -> Operator:
    if name not in REGISTRY:
        raise ValueError(f"no merge operator is configured under the name {name!r}")
    return REGISTRY[name]


# --- named aggregates whose function can change within one history

#: name -> (accumulator or null, value) -> accumulator, over BIGINT
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, x: F.when(a.isNull(), x).otherwise(F.try_add(a, x)),
    "mul": lambda a, x: F.when(a.isNull(), x).otherwise(F.try_multiply(a, x)),
    "max": lambda a, x: F.greatest(a, x),
}


def agg_switch(operands: Column, functions: tuple[str, ...] = ("sum", "mul", "max")) -> Column:
    """struct(func, value, failed) of operands struct(seq, func, value), oldest first, base included.

    Where the function changes, what was aggregated so far is the first input of the next one. An operand without a
    function (empty name) takes over the later name. A value that is no number, an unknown function or an overflow
    fails; callers then list all operands.
    """
    start = F.struct(F.lit("").alias("func"), F.lit(None).cast("bigint").alias("value"), F.lit(False).alias("failed"))

    def step(a: Column, o: Column) -> Column:
        x = o["value"].try_cast("bigint")
        func = F.when(o["func"] == "", a["func"]).otherwise(o["func"])
        value = F.when(a["value"].isNull(), x)
        for name in functions:
            value = value.when(func == name, AGGREGATES[name](a["value"], x))
        known = func.isin(*functions, "")
        return F.struct(func.alias("func"), value.alias("value"), (a["failed"] | x.isNull() | ~known | value.isNull()).alias("failed"))

    return F.aggregate(operands, start, step)
