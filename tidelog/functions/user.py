"""Merge operators written in Python, for folds that no column expression gives."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..oplog import DELETIONS, MERGE, VALUES
from ..operators.resolve import live_records, visible


def python_merge(log: DataFrame, full_merge: Callable[[int | None, list[int]], int | None], snapshot: int | None = None) -> DataFrame:
    """(cf, key, value) with ``full_merge(base or None, operands oldest first)`` called once for each key with operands.

    Range deletions, base selection and grouping run in the JVM. Each key's operands come as one array in
    a row, so that the function sees batches of keys through Arrow, and no group is shipped as a table of its own.
    """
    live = live_records(visible(log, snapshot))
    rows = live.groupBy("cf", "key").agg(
        F.bool_or(~F.col("op").isin(*DELETIONS)).alias("live"), F.max(F.when(F.col("op").isin(*VALUES), F.col("value"))).alias("base"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == MERGE, F.struct("seq", "value")))), lambda x: x["value"]).alias("operands"),
    )

    @F.pandas_udf("bigint")
    def fold(base: pd.Series, operands: pd.Series) -> pd.Series:
        return pd.Series([full_merge(None if pd.isna(b) else int(b), [int(x) for x in o]) for b, o in zip(base, operands)], dtype="Int64")

    value = F.when(F.size("operands") > 0, fold("base", "operands")).otherwise(F.col("base"))
    return rows.where("live").select("cf", "key", value.alias("value"))
