"""Joins that stay even where a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key's rows are ordered in spans of so much of what they are ordered by; a key that isn't hot has few of them.
SPANS = 256


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows with what was aggregated for their key.

    Spark can split a hot key's rows among tasks only if both sides of the join come straight from a shuffle. It would take the
    aggregate as it lies, partitioned by the same columns; joined by a hash of them, the small side is shuffled once more.
    """
    key = F.xxhash64(*on)
    other = per_key.select(key.alias("spread__"), *(F.col(c).alias(f"own__{c}") for c in on), *(c for c in per_key.columns if c not in on))
    same = F.col("spread__") == key
    for c in on:
        same = same & F.col(f"own__{c}").eqNullSafe(F.col(c))
    return rows.join(other.hint("shuffle_merge"), same, how).drop("spread__", *(f"own__{c}" for c in on))


def span_of(rows: DataFrame, order: str, spans: int = SPANS) -> Column:
    """The number of a row's span: the range of ``order``, a whole number, in ``spans`` equal parts."""
    least, most = rows.agg(F.min(order), F.max(order)).first()
    width = 1 if least is None else max(1, -(-(most - least + 1) // spans))
    return F.expr(f"({order} - {0 if least is None else least}L) div {width}L")


def running(rows: DataFrame, by: str, order: list[str], what: dict[str, Column], strictly: bool = True, spans: int = SPANS) -> DataFrame:
    """Rows with ``what``, values that only some rows have, each as it was last before the row in its key; with ``strictly=False`` the row counts, too.

    The first of ``order`` is a whole number. Rows of a key are ordered in spans of it, and a row for each span says what the spans
    before it leave, so that no task has all of a hot key.
    """
    dealt = rows.withColumn("span__", span_of(rows, order[0], spans))
    inside = Window.partitionBy(by, "span__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    place = F.struct(*order)
    left = dealt.groupBy(by, "span__").agg(*(F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in what.items()))
    before = Window.partitionBy(by).orderBy("span__").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(by, "span__", *(F.last(n, ignorenulls=True).over(before).alias(f"before__{n}") for n in what))
    out = dealt.withColumns({f"in__{n}": F.last(c, ignorenulls=True).over(inside) for n, c in what.items()})
    out = spread_join(out, carried, [by, "span__"], "left")
    return out.withColumns({n: F.coalesce(f"in__{n}", f"before__{n}") for n in what}).drop("span__", *(f"{p}__{n}" for n in what for p in ("in", "before")))
