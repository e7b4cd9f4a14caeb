"""Batches as values: packed into one column, and visited record by record in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "array<struct<n: bigint, op: string, key: bigint, value: bigint, end_key: bigint>>"


def packed(rows: DataFrame, by: str) -> DataFrame:
    """(by, batch): each batch's records (n, op, key, value, end_key) in the order of n, as JSON. A batch must fit a row, as it must fit a write."""
    each = F.array_sort(F.collect_list(F.struct("n", "op", "key", "value", "end_key")))
    return rows.groupBy(by).agg(F.to_json(each).alias("batch"))


def visited(batches: DataFrame, by: str, stop: Column | None = None) -> DataFrame:
    """(by, n, op, key, value, end_key): the records of each batch, up to the first at which ``stop`` holds.

    ``stop`` is a condition over a record's fields: what a handler returns that has seen enough.
    """
    rows = batches.select(by, F.from_json("batch", RECORD).alias("records"))
    out = rows.select(by, F.inline("records"))
    if stop is None:
        return out
    ends = out.where(stop).groupBy(by).agg(F.min("n").alias("stop__"))
    return out.join(ends, by, "left").where(F.col("stop__").isNull() | (F.col("n") < F.col("stop__"))).drop("stop__")
