"""Compaction as a rewriting aggregation: stripes between snapshots, filters, expiry.

Snapshots cut the history of a key into stripes; a read at any snapshot sees only the newest version of
one stripe, so older ones in it go. At the bottommost level deletions go where nothing older is left, and numbers
that every snapshot sees become 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..oplog import BASES, DELETIONS, ENTITY, MERGE, POINTS, PUT, RANGE_DELETE, SINGLE_DELETE, VALUES
from .ranges import range_join
from .resolve import uncovered
from .skew import spread_join


def stripe(snapshots: list[int], seq: Column | str = "seq") -> Column:
    """How many snapshots are older than the record."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    total = F.lit(0)
    for s in snapshots:
        total = total + F.when(seq > s, 1).otherwise(0)
    return total


def _without_covered(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """A range deletion drops points only within its own stripe."""
    striped = log.withColumn("stripe", stripe(snapshots))
    out = None
    for k in range(len(snapshots) + 1):
        one = uncovered(striped.where(F.col("stripe") == k))
        out = one if out is None else out.unionByName(one)
    return out


def compact(log: DataFrame, snapshots: list[int] | None = None, bottommost: bool = False) -> DataFrame:
    """(cf, key, seq, op, value, and ts, write_time and cols if the log has them): what is left of puts, deletions and merges, the latter added up within a stripe; ``rewrite`` has range deletions, too.

    A merge chain folds onto the base below it only if no snapshot lies between; else its sum stays a merge.
    """
    snapshots = sorted(snapshots or [])
    points = _without_covered(log, snapshots)
    bases = points.where(F.col("op").isin(*BASES)).groupBy("cf", "key", "stripe").agg(F.max("seq").alias("base_seq"))
    kept = spread_join(points, bases, ["cf", "key", "stripe"], "left").where(F.col("seq") >= F.coalesce("base_seq", F.lit(-1)))
    merge = F.col("op") == MERGE
    rows = kept.groupBy("cf", "key", "stripe").agg(
        F.max("seq").alias("seq"), F.max_by("op", "seq").alias("newest"), F.max(F.when(F.col("op").isin(*BASES), F.col("op"))).alias("base_op"),
        F.max(F.when(F.col("op").isin(*VALUES), F.col("value"))).alias("base"), F.sum(F.when(merge, F.col("value"))).alias("folded"), F.count_if(merge).alias("n_merges"),
        *(F.max_by(c, "seq").alias(c) for c in ("ts", "write_time") if c in log.columns), *(F.max_by("cols", F.when(F.col("op") == ENTITY, F.col("seq"))).alias(c) for c in ("cols",) if c in log.columns),
    )
    more = [c for c in ("ts", "write_time", "cols") if c in log.columns]
    op = F.when(F.col("n_merges") == 0, F.col("base_op")).when(F.col("base_op").isNull(), MERGE).otherwise(PUT)
    value = F.when(F.col("n_merges") > 0, F.coalesce("base", F.lit(0)) + F.col("folded")).otherwise(F.col("base"))
    rows = rows.select("cf", "key", "stripe", "seq", op.alias("op"), value.alias("value"), *more)
    if not bottommost:
        return rows.select("cf", "key", "seq", "op", "value", *more)
    # from the oldest stripe up: a deletion stays only if a value is left below it
    older = Window.partitionBy("cf", "key").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("op").isin(*DELETIONS) & (F.coalesce(F.max(F.when(~F.col("op").isin(*DELETIONS), 1)).over(older), F.lit(0)) == 0)
    # a merge over nothing, or over a deletion in the next older stripe that is left out, has its final value
    rows = rows.withColumn("gone", gone).where(~F.col("gone"))
    lowest = F.min("stripe").over(Window.partitionBy("cf", "key"))
    final = rows.withColumn("op", F.when((F.col("op") == MERGE) & (F.col("stripe") == lowest), PUT).otherwise(F.col("op")))
    zero = (F.col("stripe") == 0) & ~F.col("op").isin(*DELETIONS)
    return final.select("cf", "key", F.when(zero, F.lit(0)).otherwise(F.col("seq")).cast("bigint").alias("seq"), "op", "value", *more)


def rewrite(log: DataFrame, snapshots: list[int] | None = None, bottommost: bool = False) -> DataFrame:
    """(cf, key, seq, op, value, end_key): what ``compact`` leaves, and the range deletions that still hide something.

    Points of older stripes and of lower levels lie under them. At the bottommost level those of the oldest stripe have done their
    work; they must go, as numbers under them become 0.
    """
    snapshots = sorted(snapshots or [])
    tombs = log.where((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("end_key")))
    if bottommost:
        tombs = tombs.where(stripe(snapshots) > 0)
    left = compact(log, snapshots, bottommost)
    return left.withColumn("end_key", F.lit(None).cast(log.schema["end_key"].dataType)).unionByName(tombs.select("cf", "key", "seq", "op", F.lit(None).cast(left.schema["value"].dataType).alias("value"), "end_key"), allowMissingColumns=True)


def annihilate_single_deletes(log: DataFrame, snapshots: list[int] | None = None) -> DataFrame:
    """A single deletion and the put right below it go together if no snapshot separates them; else the put loses its value."""
    snapshots = sorted(snapshots or [])
    w = Window.partitionBy("cf", "key").orderBy("seq")
    rows = log.where(F.col("op").isin(*POINTS)).withColumn("stripe", stripe(snapshots))
    rows = rows.withColumns({"above": F.lead("op").over(w), "above_stripe": F.lead("stripe").over(w), "below": F.lag("op").over(w), "below_stripe": F.lag("stripe").over(w)})
    single, put = F.col("op") == SINGLE_DELETE, F.col("op") == PUT
    paired = (single & (F.col("below") == PUT)) | (put & (F.col("above") == SINGLE_DELETE))
    together = (single & (F.col("below") == PUT) & (F.col("below_stripe") == F.col("stripe"))) | (put & (F.col("above") == SINGLE_DELETE) & (F.col("above_stripe") == F.col("stripe")))
    rows = rows.where(~F.coalesce(together, F.lit(False)))
    return rows.withColumn("value", F.when(F.coalesce(paired & put, F.lit(False)), F.lit(None)).otherwise(F.col("value"))).select("cf", "key", "seq", "op", "value")


def single_delete_violations(log: DataFrame) -> DataFrame:
    """(cf, key, seq, puts, others): single deletions that don't follow exactly one put since the last one, or follow other kinds."""
    w = Window.partitionBy("cf", "key").orderBy("seq")
    rows = log.where(F.col("op").isin(*POINTS)).withColumn("era", F.sum(F.when(F.col("op") == SINGLE_DELETE, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    era = rows.groupBy("cf", "key", F.coalesce("era", F.lit(0)).alias("era")).agg(F.max(F.when(F.col("op") == SINGLE_DELETE, F.col("seq"))).alias("seq"), F.count_if(F.col("op") == PUT).alias("puts"), F.count_if(~F.col("op").isin(PUT, SINGLE_DELETE)).alias("others"))
    return era.where(F.col("seq").isNotNull() & ((F.col("puts") != 1) | (F.col("others") > 0))).select("cf", "key", "seq", "puts", "others")


def filtered(log: DataFrame, decision: Column, new_value: Column) -> DataFrame:
    """A compaction filter: it sees the newest version of each key; ``decision`` is KEEP, REMOVE, CHANGE or PURGE.

    A removal leaves a deletion behind, which hides older versions; a purge leaves nothing, so they show again.
    """
    w = Window.partitionBy("cf", "key").orderBy(F.col("seq").desc())
    rows = log.withColumn("newest__", F.row_number().over(w) == 1).withColumn("decision", F.when(F.col("newest__"), decision).otherwise("KEEP"))
    rows = rows.where("decision <> 'PURGE'")
    return rows.withColumn("value", F.when(F.col("decision") == "CHANGE", new_value).when(F.col("decision") == "REMOVE", F.lit(None)).otherwise(F.col("value"))).withColumn("op", F.when(F.col("decision") == "REMOVE", "DELETE").otherwise(F.col("op"))).drop("newest__")


def skip_until(state: DataFrame, skips: DataFrame) -> DataFrame:
    """Drops keys in [begin_key, end_key) of any skip: the filter's decision to remove and go on at a later key."""
    return range_join(state, skips, F.lit(True), "left_anti")


def clip(log: DataFrame, begin, end) -> DataFrame:
    return log.where((F.col("key") >= F.lit(begin)) & (F.col("key") < F.lit(end)))


def trim_history(log: DataFrame, trim_ts: int) -> DataFrame:
    """Opening at a time: later writes go."""
    return log.where(F.col("ts") <= trim_ts)


def collect_history(log: DataFrame, low_ts: int) -> DataFrame:
    """Versions under the low watermark go if a newer version of the key is also under it."""
    w = Window.partitionBy("cf", "key", F.col("ts") < low_ts).orderBy(F.col("ts").desc(), F.col("seq").desc())
    return log.withColumn("r__", F.row_number().over(w)).where((F.col("ts") >= low_ts) | (F.col("r__") == 1)).drop("r__")


# --- expiry

MAX_MILLIS = (1 << 63) - 1


def live_db_ttl(log: DataFrame, ttl: int, now: int, time: str = "write_time") -> DataFrame:
    """A ttl of 0 or less never ends; else a row is stale once write time + ttl is less than now, in seconds."""
    return log if ttl <= 0 else log.where(F.col(time) + ttl >= now)


def live_until(log: DataFrame, now: int, expiration: str = "expiration") -> DataFrame:
    """Values with an expiration of their own; null never expires."""
    return log.where(F.col(expiration).isNull() | (F.col(expiration) > now))


def state_expired(ts: Column, ttl: int, now: int) -> Column:
    """Expired as soon as ts + ttl reaches now, in milliseconds; the sum is kept from overflowing. Null ts, a value too short for one, is kept."""
    room = F.when(ts > 0, F.least(F.lit(ttl), F.lit(MAX_MILLIS) - ts)).otherwise(F.lit(ttl))
    return F.coalesce(ts + room <= now, F.lit(False))


def live_list_suffix(elements: Column, ttl: int, now: int, ts: str = "ts") -> Column:
    """A list without its expired beginning; expired elements after a live one stay. Null if none is left."""
    first = F.array_position(F.transform(elements, lambda e: ~state_expired(e[ts], ttl, now)), F.lit(True))
    return F.when(first > 0, F.slice(elements, first.cast("int"), F.size(elements)))


def live_fixed_list(value: Column, width: int, expired: Callable[[Column], Column]) -> Column:
    """A list stored as elements of ``width`` characters or bytes, without its expired beginning; what doesn't fill an element is kept. Null if none is left."""
    n = F.floor(F.length(value) / width).cast("int")
    elements = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(value, i * width + 1, F.lit(width)))
    first = F.array_position(F.transform(elements, lambda e: ~expired(e)), F.lit(True)).cast("int")
    return F.when(n == 0, value).when(first > 0, F.substring(value, (first - 1) * width + 1, F.length(value)))


# --- rows of timestamped columns, with tombstones of rows and columns

def merge_rows(versions: DataFrame, by: str = "key") -> DataFrame:
    """(key, index, ts, ttl, mask, value): the winner of each column index across row versions.

    Row versions are (key, version, row_tombstone or null, columns array<struct<index, ts, ttl, mask, value>>): the newest write
    wins, ties go to the version that comes first, and what isn't newer than the latest row tombstone goes.
    """
    w = Window.partitionBy(by)
    cells = versions.withColumn("dead", F.max("row_tombstone").over(w)).select(by, "version", "dead", F.explode_outer("columns").alias("c")).where("c IS NOT NULL AND (dead IS NULL OR c.ts > dead)")
    return cells.groupBy(by, F.col("c.index").alias("index")).agg(F.max_by("c", F.struct("c.ts", (-F.col("version")).alias("v"))).alias("c")).select(by, "index", F.col("c.ts").alias("ts"), F.col("c.ttl").alias("ttl"), F.col("c.mask").alias("mask"), F.col("c.value").alias("value"))


def expire_cells(cells: DataFrame, now: int, purge: bool) -> DataFrame:
    """Cells with a ttl (seconds; ts in microseconds) expire once ts + ttl is before now, in seconds: they go, or become tombstones."""
    expired = F.col("ttl").isNotNull() & (F.floor(F.col("ts") / 1_000_000) + F.col("ttl") < now)
    if purge:
        return cells.where(~expired)
    return cells.withColumns({"mask": F.when(expired, F.lit(1)).otherwise(F.col("mask")), "value": F.when(expired, F.lit(None)).otherwise(F.col("value"))})


def collect_tombstones(cells: DataFrame, now: int, grace: int, deleted_at: str = "deleted_at") -> DataFrame:
    return cells.where(F.col(deleted_at).isNull() | (F.col(deleted_at) + grace >= now))


# --- files

def fifo_ttl(files: DataFrame, ttl: int, now: int) -> DataFrame:
    return files.where((F.col("create_time") == 0) | (F.col("create_time") >= now - ttl))


def temperatures(files: DataFrame, now: int, older: dict[str, int]) -> DataFrame:
    """Files with their temperature: that of the greatest age that they are beyond; hot if none."""
    out = F.lit("hot")
    for name, age in sorted(older.items(), key=lambda x: x[1]):
        out = F.when(F.col("create_time") < now - age, name).otherwise(out)
    return files.withColumn("temperature", out)


def fifo_size(files: DataFrame, most: int) -> DataFrame:
    """The newest files whose sizes add up to ``most`` at most. A catalog of files is small: one task orders it."""
    w = Window.orderBy(F.col("create_time").desc(), F.col("file").desc())
    return files.withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= most)


def deletion_triggered(log: DataFrame, window: int, trigger: int, buckets: int = 128, file: str = "cf") -> DataFrame:
    """(file, entries, deletes, needs_compaction): whether some window of entries in key order holds enough deletions.

    The window moves by whole buckets of entries, as a ring of ``buckets`` of them does.
    """
    size = max(1, -(-window // buckets))
    ring = max(1, -(-window // size))
    order = Window.partitionBy(file).orderBy("key", F.col("seq").desc())
    rows = log.withColumn("n", F.row_number().over(order)).withColumn("bucket", F.floor((F.col("n") - 1) / size)).withColumn("d", F.when(F.col("op").isin(*DELETIONS, RANGE_DELETE), 1).otherwise(0))
    per = rows.groupBy(file, "bucket").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    w = Window.partitionBy(file).orderBy("bucket").rangeBetween(-(ring - 1), 0)
    return per.withColumn("seen", F.sum("d").over(w)).groupBy(file).agg(F.sum("n").alias("entries"), F.sum("d").alias("deletes"), (F.max("seen") >= trigger).alias("needs_compaction"))


def placement(log: DataFrame, cutoff: int) -> DataFrame:
    """Records newer than the cutoff are hot."""
    return log.withColumn("tier", F.when(F.col("seq") > cutoff, "hot").otherwise("cold"))
