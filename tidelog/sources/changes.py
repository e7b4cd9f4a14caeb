"""The log as a source of changes, and its replay after a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updates_since(log: DataFrame, seq: int, batch: str = "batch_id") -> DataFrame:
    """Whole batches from the one that covers ``seq`` on, or else from the next."""
    last = log.groupBy(batch).agg(F.max("seq").alias("last__")).where(F.col("last__") >= seq).select(batch)
    return log.join(last, batch, "left_semi").orderBy("seq")


def replay(log: DataFrame, decision: Column) -> DataFrame:
    """A filter of replay: CONTINUE keeps a record, IGNORE leaves it out, STOP ends before it."""
    rows = log.withColumn("decision__", decision)
    stop = rows.where("decision__ = 'STOP'").agg(F.min("seq").alias("stop__"))
    return rows.crossJoin(F.broadcast(stop)).where((F.col("decision__") == "CONTINUE") & (F.col("stop__").isNull() | (F.col("seq") < F.col("stop__")))).drop("decision__", "stop__")  # one row


def recover(log: DataFrame, corrupt: Column, mode: str) -> DataFrame:
    """What recovery reads.

    skip_corrupt: all other records; point_in_time: those before the first corrupt one; tolerate_tail: the same, if nothing but corrupt
    records follows, as after a write that didn't end; absolute: all, if none is corrupt. The last two refuse other logs.
    """
    if mode == "skip_corrupt":
        return log.where(~corrupt)
    if mode == "point_in_time":
        return replay(log, F.when(corrupt, "STOP").otherwise("CONTINUE"))
    if mode == "tolerate_tail":
        kept = replay(log, F.when(corrupt, "STOP").otherwise("CONTINUE"))
        if log.where(~corrupt).count() != kept.count():
            raise ValueError("the log holds corrupt records before its end")
        return kept
    if mode == "absolute":
        if not log.where(corrupt).isEmpty():
            raise ValueError("the log holds corrupt records")
        return log
    raise ValueError(f"unknown recovery mode {mode!r}")
