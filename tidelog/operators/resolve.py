"""State from the log: visibility, range deletions, base versions and merges.

One plan serves all reads. Visibility (snapshot, read time) is filtered below everything else. Points under
a newer range deletion go: a search among the deletions' fragments where they are few, a range anti join else; then the newest base version of a key ends its history, and the
merge operands above it are folded onto it, oldest first. Predicates on keys commute with all of that and
reach the scan; predicates on values must stay above.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..oplog import BASES, DELETIONS, MERGE, POINTS, RANGE_DELETE, VALUES
from .ranges import FEW, cover, range_join, sweep
from .skew import spread_join

#: name -> (base value, operands oldest first as an array of struct(seq, value)) -> folded value
Fold = Callable[[Column, Column], Column]


def visible(log: DataFrame, snapshot: int | None = None, read_ts: int | None = None) -> DataFrame:
    if snapshot is not None:
        log = log.where(F.col("seq") <= F.lit(snapshot))
    if read_ts is not None:
        log = log.where(F.col("ts") <= F.lit(read_ts))
    return log


def uncovered(log: DataFrame, few: int = FEW) -> DataFrame:
    """Point records that no newer range deletion covers: its number must be strictly larger.

    Up to ``few`` range deletions are cut into fragments, each with its newest number, and searched in place, with no join.
    """
    points = log.where(F.col("op").isin(*POINTS))
    tombs = log.where((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("end_key")))
    found = tombs.select("cf", "key", "end_key", "seq").limit(few + 1).collect()
    families = {r["cf"] for r in found}
    if len(found) <= few and len(families) <= 64:
        newest = F.lit(None).cast("bigint")
        for cf in sorted(families, key=str):
            pieces = sweep([(r["key"], r["end_key"], r["seq"]) for r in found if r["cf"] == cf])
            newest = F.when(F.col("cf") == F.lit(cf), cover(F.col("key"), pieces)).otherwise(newest)
        return points.where(F.coalesce(newest <= F.col("seq"), F.lit(True))) if families else points
    tombs = tombs.select(F.col("cf").alias("t_cf"), F.col("key").alias("t_begin"), F.col("end_key").alias("t_end"), F.col("seq").alias("t_seq"))
    return range_join(points, tombs, (F.col("cf") == F.col("t_cf")) & (F.col("t_seq") > F.col("seq")), "left_anti", "key", "t_begin", "t_end")


def of_keys(log: DataFrame, keys: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The records that decide the given keys: their points, and all range deletions. Reads of some keys need no others."""
    keys = keys.select("key").distinct().withColumn("asked__", F.lit(True))
    keys = F.broadcast(keys) if keys.count() <= few else keys
    return log.join(keys, "key", "left").where(F.col("asked__") | (F.col("op") == RANGE_DELETE)).drop("asked__").select(*log.columns)


def live_records(log: DataFrame, ranges: bool = True) -> DataFrame:
    """The records that decide each key: its newest base version, if any, and the operands above it."""
    points = uncovered(log) if ranges else log.where(F.col("op").isin(*POINTS))
    bases = points.where(F.col("op").isin(*BASES)).groupBy("cf", "key").agg(F.max("seq").alias("base_seq"))
    return spread_join(points, bases, ["cf", "key"], "left").where(F.col("seq") >= F.coalesce("base_seq", F.lit(-1)))


#: A key's history is folded in spans of so many sequence numbers first, so that a hot key is no single task's.
SPAN = 1 << 20


def resolve(log: DataFrame, snapshot: int | None = None, read_ts: int | None = None, fold: Fold | None = None, ranges: bool = True, span: int = SPAN) -> DataFrame:
    """(cf, key, value, seq, ts, n_operands) of live keys.

    Without ``fold``, operands add up: spans of a key's history are summed up apart and then put together, so any
    number of records may share a key. ``fold`` may be any function of the base and the ordered operands; as it
    needs a key's operands in one row, histories must fit one. ``seq`` and ``ts`` are the newest record's.
    """
    log = visible(log, snapshot, read_ts)
    if "ts" not in log.columns:
        log = log.withColumn("ts", F.lit(None).cast("bigint"))
    merge, put, newest = F.col("op") == MERGE, F.col("op").isin(*VALUES), F.max_by("ts", "seq").alias("ts")
    if fold is not None:
        got = live_records(log, ranges).groupBy("cf", "key").agg(
            F.max("seq").alias("seq"), newest, F.count_if(merge).alias("n_operands"), F.bool_or(~F.col("op").isin(*DELETIONS)).alias("live"), F.max(F.when(put, F.col("value"))).alias("base"),
            F.array_sort(F.collect_list(F.when(merge, F.struct("seq", "value")))).alias("operands"),
        )
        value = F.when(F.col("n_operands") == 0, F.col("base")).otherwise(fold(F.col("base"), F.col("operands")))
        return got.where("live").select("cf", "key", value.alias("value"), "seq", "ts", "n_operands")
    points = (uncovered(log) if ranges else log.where(F.col("op").isin(*POINTS))).withColumn("span__", F.expr(f"seq div {span}"))
    base_seq = F.max(F.when(F.col("op").isin(*BASES), F.col("seq"))).over(Window.partitionBy("cf", "key", "span__"))
    parts = points.withColumn("base_seq", base_seq).where(F.col("seq") >= F.coalesce("base_seq", F.lit(-1))).groupBy("cf", "key", "span__").agg(
        F.max("seq").alias("seq"), newest, F.count_if(merge).alias("n_operands"), F.sum(F.when(merge, F.col("value"))).alias("folded"), F.max("base_seq").alias("base_seq"),
        F.bool_or(~F.col("op").isin(*DELETIONS)).alias("live"), F.max(F.when(put, F.col("value"))).alias("base"),
    )
    top = F.max(F.when(F.col("base_seq").isNotNull(), F.col("span__"))).over(Window.partitionBy("cf", "key"))
    got = parts.withColumn("top__", top).where(F.col("span__") >= F.coalesce("top__", F.lit(-1))).groupBy("cf", "key").agg(
        F.max("seq").alias("seq"), newest, F.sum("n_operands").alias("n_operands"), F.sum("folded").alias("folded"), F.bool_or("live").alias("live"), F.max("base").alias("base")
    )
    value = F.when(F.col("n_operands") == 0, F.col("base")).otherwise(F.coalesce("base", F.lit(0)) + F.col("folded"))
    return got.where("live").select("cf", "key", value.alias("value"), "seq", "ts", "n_operands")


def latest(log: DataFrame, snapshot: int | None = None, read_ts: int | None = None) -> DataFrame:
    """(cf, key, value, seq, ts) for logs of puts and point deletes only: one aggregation, no window, combined before the shuffle."""
    newest = lambda c: F.max_by(c, "seq")  # noqa: E731  each of fixed width, where values are: the aggregate hashes, and doesn't sort
    got = visible(log, snapshot, read_ts).groupBy("cf", "key").agg(newest("value").alias("value"), newest("ts").alias("ts"), newest(F.col("op").isin(*DELETIONS)).alias("gone"), F.max("seq").alias("seq"))
    return got.where("NOT gone").select("cf", "key", "value", "seq", "ts")


def operands(log: DataFrame, snapshot: int | None = None, expected: int | None = None) -> DataFrame:
    """(cf, key, n, operands, status): in insertion order, the base first; more than ``expected`` gives the count only."""
    live = live_records(visible(log, snapshot))
    rows = live.where(~F.col("op").isin(*DELETIONS)).groupBy("cf", "key").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("operands"))
    if expected is None:
        return rows.withColumn("status", F.lit("OK"))
    over = F.col("n") > expected
    return rows.withColumn("operands", F.when(~over, F.col("operands"))).withColumn("status", F.when(over, "Incomplete").otherwise("OK"))
