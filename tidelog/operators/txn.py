"""Conflicts, commit visibility, batches over a base, and lock queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..oplog import RANGE_DELETE
from ..shared import shared_folder
from .ranges import range_join


def conflicts(write_sets: DataFrame, log: DataFrame) -> DataFrame:
    """(txn, status): Busy if a key of the transaction (txn, key, snap_seq) was committed after its snapshot."""
    latest = log.groupBy("key").agg(F.max("seq").alias("committed"))
    hit = write_sets.join(latest, "key", "left").withColumn("late", F.coalesce(F.col("committed") > F.col("snap_seq"), F.lit(False)))
    return hit.groupBy("txn").agg(F.bool_or("late").alias("busy"), F.count_if("late").alias("n_conflicts")).select("txn", F.when(F.col("busy"), "Busy").otherwise("OK").alias("status"), "n_conflicts")


def committed_at(prepared: DataFrame, commits: DataFrame, snapshot: int) -> DataFrame:
    """Prepared rows that a snapshot sees: those whose transaction committed at or before it; their sequence number is the commit's."""
    seen = commits.where(F.col("commit_seq") <= snapshot)
    return prepared.join(seen, "txn_id").withColumn("seq", F.col("commit_seq")).drop("commit_seq")


#: What a reader without a snapshot sees of each state of a transaction, by write policy: whether its data are in the log, and whether they show.
POLICIES = {"committed": {"COMMITTED"}, "prepared": {"COMMITTED", "PREPARED", "ROLLED_BACK"}, "unprepared": {"COMMITTED", "PREPARED", "ROLLED_BACK", "OPEN"}}


def written_and_visible(writes: DataFrame, ends: DataFrame, policy: str) -> DataFrame:
    """(…write, state, written, visible): a transaction (txn_id) without an end is open.

    Write-committed transactions enter the log at their commit; write-prepared ones when they are prepared; write-unprepared
    ones as they go. Only committed data show, whatever is in the log.
    """
    state = F.coalesce("state", F.lit("OPEN"))
    rows = writes.join(ends.select("txn_id", "state"), "txn_id", "left").withColumn("state", state)
    return rows.withColumn("written", F.col("state").isin(*POLICIES[policy])).withColumn("visible", F.col("state") == "COMMITTED")


def tracked(operations: DataFrame) -> DataFrame:
    """(txn, key, exclusive) that each transaction holds in the end, from operations (txn, key, n, kind) in the order of n.

    READ (for update), WRITE and UNDO track a key, shared or exclusive, and untrack it; UNTRACKED writes never do. An undo takes back one
    read for update, and has no effect on a key that was written.
    """
    w = Window.partitionBy("txn", "key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # undos beyond the reads so far have none to take back
    step = F.when(F.col("kind") == "READ", 1).when(F.col("kind") == "UNDO", -1).otherwise(0)
    run = operations.withColumn("sum__", F.sum(step).over(w)).withColumn("low__", F.least(F.lit(0), F.min("sum__").over(w)))
    last = run.groupBy("txn", "key").agg(F.max_by(F.col("sum__") - F.col("low__"), "n").alias("reads"), F.bool_or(F.col("kind") == "WRITE").alias("exclusive"))
    return last.where("reads > 0 OR exclusive").select("txn", "key", "exclusive")


def commit_times(txns: DataFrame, committed: DataFrame) -> DataFrame:
    """(txn, status) of transactions (txn, key, read_ts, commit_ts) against what is committed (key, ts).

    A commit time must be later than the read time, and no key may have been committed after the read time.
    """
    newest = committed.groupBy("key").agg(F.max("ts").alias("newest__"))
    rows = txns.join(newest, "key", "left")
    one = rows.groupBy("txn").agg(F.bool_or(F.col("commit_ts") <= F.col("read_ts")).alias("early"), F.bool_or(F.coalesce(F.col("newest__") > F.col("read_ts"), F.lit(False))).alias("late"))
    return one.select("txn", F.when(F.col("early"), "InvalidArgument").when(F.col("late"), "Busy").otherwise("OK").alias("status"))


def overlay(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with an uncommitted batch (…, ordinal) on top, so that its records are newer than all."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top__"))
    rows = batch.crossJoin(F.broadcast(top)).withColumn("seq", F.col("top__") + 1 + F.col("ordinal")).drop("top__", "ordinal")  # one row
    return log.unionByName(rows, allowMissingColumns=True)


def rolled_back(batch: DataFrame, savepoint: int) -> DataFrame:
    """The records before a savepoint."""
    return batch.where(F.col("ordinal") < savepoint)


def batch_counts(batch: DataFrame, by: str = "batch_id") -> DataFrame:
    """What a batch holds, by kind."""
    kind = lambda k: F.col("op") == k
    return batch.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(kind("PUT")).alias("n_puts"), F.count_if(kind("MERGE")).alias("n_merges"), F.count_if(kind("DELETE") | kind("SINGLE_DELETE")).alias("n_deletes"),
        F.count_if(kind(RANGE_DELETE)).alias("n_range_deletes"), F.bool_or(kind("PUT")).alias("has_put"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def stamped(batches: DataFrame, by: str = "batch_id") -> DataFrame:
    """The records of each batch with one timestamp, the newest among them."""
    times = batches.groupBy(by).agg(F.max("ts").alias("ts"))
    return batches.drop("ts").join(times, by)


def lock_overlaps(held: DataFrame, wanted: DataFrame, buckets: int = 32) -> DataFrame:
    """(waiter, holder): requests [w_lo, w_hi] that touch a held range [lo, hi] of another owner, bounds inclusive.

    Of two overlapping ranges one begins in the other, which makes two joins of points with ranges.
    """
    other = F.col("owner") != F.col("waiter")
    h = held.select("owner", "lo", (F.col("hi") + 1).alias("end"))
    w = wanted.select("waiter", "w_lo", (F.col("w_hi") + 1).alias("w_end"))
    begins_in_held = range_join(w, h, other, "inner", "w_lo", "lo", "end")
    held_begins = range_join(h, w, other, "inner", "lo", "w_lo", "w_end")
    return begins_in_held.select("waiter", "owner").union(held_begins.select("waiter", "owner")).distinct().select("waiter", F.col("owner").alias("holder"))


def deadlocked(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node): transactions on a cycle of the wait-for graph or waiting for one on both sides: trimming leaves them.

    Nodes that wait for none, or that none waits for, are taken off until nothing changes.
    """
    edges = edges.select("waiter", "holder").where("waiter <> holder").distinct()
    shared_folder(edges.sparkSession)  # rounds are checkpointed there
    n = edges.count()
    done = 0
    while n and (rounds is None or done < rounds):
        waits, held = edges.select(F.col("waiter").alias("holder")).distinct(), edges.select(F.col("holder").alias("waiter")).distinct()
        edges = edges.join(waits, "holder", "left_semi").join(held, "waiter", "left_semi").select("waiter", "holder").checkpoint()
        n, before = edges.count(), n
        done += 1
        if n == before:
            break
    return edges.select(F.col("waiter").alias("node")).distinct()


def index_check(rows: DataFrame, index: DataFrame, key: str = "pk", value: str = "secondary") -> DataFrame:
    """One row: how many entries of a table and its secondary index agree, are missing, or dangle."""
    both = rows.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")).join(index.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b")), key, "full_outer")
    return both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("matching"), F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("dangling"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("different"))
