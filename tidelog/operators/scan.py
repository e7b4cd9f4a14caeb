"""Point lookups and ordered scans over state. Key predicates reach the scan of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import array_of, cut_points, place
from .skew import running

#: Probe tables of more rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _probe_hint(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def multi_get(state: DataFrame, keys: DataFrame, on: str | list[str] = "key") -> DataFrame:
    """Every probe with its value and a status. State should come from the probed keys' records (``resolve.of_keys``), not from all."""
    on = [on] if isinstance(on, str) else on
    hits = state.join(_probe_hint(keys.select(*on).distinct()), on, "left_semi").withColumn("found__", F.lit(True))
    return keys.join(hits, on, "left").withColumn("status", F.when(F.col("found__"), "OK").otherwise("NotFound")).drop("found__")


def may_exist(state: DataFrame, keys: DataFrame, on: str = "key") -> DataFrame:
    """Probes that exist. Exact answers are allowed ones: there are no false negatives."""
    return keys.join(state.select(on), on, "left_semi")


def scan(state: DataFrame, lower=None, upper=None, reverse: bool = False, limit: int | None = None, key: str = "key") -> DataFrame:
    """Keys in [lower, upper) in order."""
    if lower is not None:
        state = state.where(F.col(key) >= F.lit(lower))
    if upper is not None:
        state = state.where(F.col(key) < F.lit(upper))
    out = state.orderBy(F.col(key).desc() if reverse else F.col(key).asc())
    return out.limit(limit) if limit is not None else out


def numbered(rows: DataFrame, key: str = "key", run: int = 1_000_000, least: int = 8) -> DataFrame:
    """Rows with their ``position`` in key order, from 1: ranges of keys are ordered apart, and a row for each tells how many come before it."""
    cuts = cut_points(rows, key, max(least, rows.count() // run))
    dealt = rows.withColumn("p__", place(F.col(key), cuts))
    before = dealt.groupBy("p__").agg(F.count("*").alias("c")).select("p__", F.coalesce(F.sum("c").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    return dealt.withColumn("at__", F.row_number().over(Window.partitionBy("p__").orderBy(key))).join(F.broadcast(before), "p__").withColumn("position", F.col("before__") + F.col("at__")).drop("p__", "at__", "before__")


def coalesced(states: dict[str, DataFrame], key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, family): one entry for a key of several families, that of the first family that has it."""
    order = list(states)
    rows = None
    for n, name in enumerate(order):
        one = states[name].select(key, F.col(value).alias("v__"), F.lit(n).alias("n__"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(key).agg(F.min(F.struct("n__", "v__")).alias("f"))
    return first.select(key, F.col("f.v__").alias(value), F.get(F.lit(order), F.col("f.n__")).alias("family"))


def prefix_scan(state: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return state.where(F.startswith(F.col(key), F.lit(prefix)))


#: Probes that the plan holds at most.
FEW = 10_000


def seek(state: DataFrame, probes: DataFrame, forward: bool = True, key: str = "key", probe: str = "probe", few: int = FEW) -> DataFrame:
    """(probe, key): for each probe the first key >= it, or with ``forward=False`` the last key <= it; null if none.

    Few probes cut the keys into slots: one pass takes each slot's first or last key, before any shuffle, and the
    slots beyond a probe's own are looked through in order. Many probes meet the keys in buckets between quantiles of the probes.
    """
    kind = state.schema[key].dataType
    asked = probes.select(F.col(probe).cast(kind).alias("k"))
    cuts = sorted({r[0] for r in asked.where("k IS NOT NULL").limit(few + 1).collect()})
    rows = Window.orderBy("b")
    if len(cuts) <= few and asked.count() <= few:
        slot = place(F.col(key), cuts)
        if not forward:  # a key that equals a probe lies before it
            slot = F.when(F.get(array_of(cuts), slot - 1) == F.col(key), slot - 1).otherwise(slot) if cuts else slot
        edge = state.where(F.col(key).isNotNull()).groupBy(slot.alias("b")).agg((F.min(key) if forward else F.max(key)).alias("edge"))
        all_slots = asked.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("b")).coalesce(1)
        frame = rows.rowsBetween(Window.currentRow, Window.unboundedFollowing) if forward else rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nearest = all_slots.join(edge, "b", "left").select("b", (F.min("edge") if forward else F.max("edge")).over(frame).alias("near"))
        # a probe's keys begin in the slot after the cut that it is, or end in the slot before it
        own = probes.withColumn("b", (place(F.col(probe).cast(kind), cuts) - F.lit(0 if forward else 1)).cast("int"))
        return own.join(F.broadcast(nearest), "b", "left").select(probe, F.when(F.col(probe).isNotNull(), F.col("near")).alias(key))
    cuts = cut_points(asked, "k", max(2, -(-asked.count() // few)))
    both = state.select(F.col(key).alias("k"), F.lit(False).alias("asked")).union(asked.withColumn("asked", F.lit(True))).withColumn("b", place(F.col("k"), cuts))
    own = F.when(~F.col("asked"), F.col("k"))
    edge = both.groupBy("b").agg((F.min(own) if forward else F.max(own)).alias("edge"))
    rows = rows.rowsBetween(1, Window.unboundedFollowing) if forward else rows.rowsBetween(Window.unboundedPreceding, -1)
    beyond = edge.select("b", (F.min("edge") if forward else F.max("edge")).over(rows).alias("beyond"))
    inner = Window.partitionBy("b").orderBy("k")
    frame = inner.rangeBetween(Window.currentRow, Window.unboundedFollowing) if forward else inner.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", (F.min(own) if forward else F.max(own)).over(frame)).where("asked")
    return near.join(F.broadcast(beyond), "b", "left").select(F.col("k").cast(probes.schema[probe].dataType).alias(probe), F.coalesce("near", "beyond").alias(key))


def as_of(events: DataFrame, versions: DataFrame, by: str, event_time: str, version_time: str, value: str, strict: bool = False) -> DataFrame:
    """Each event with the latest version of its key at or before (``strict``: before) its time, a whole number.

    One union, ordered by key in spans of time: no pairs are made, and no task has all of a hot key. ``versions`` should have one
    row for a key and time.
    """
    e = events.withColumn("t__", F.col(event_time)).withColumn("v__", F.lit(None).cast(versions.schema[value].dataType)).withColumn("side__", F.lit(0 if strict else 1))
    v = versions.select(F.col(by), F.col(version_time).alias("t__"), F.col(value).alias("v__"), F.lit(1 if strict else 0).alias("side__"))
    both = e.unionByName(v, allowMissingColumns=True).withColumn("event__", F.col("side__") == (0 if strict else 1))
    found = running(both, by, ["t__", "side__"], {"found__": F.col("v__")}, strictly=False).where("event__").drop("v__", "t__", "side__", "event__")
    return found.drop(value).withColumnRenamed("found__", value) if value in events.columns else found.withColumnRenamed("found__", value)


def history(log: DataFrame, lo: int, hi: int) -> DataFrame:
    """All versions with lo <= ts <= hi, deletions included."""
    return log.where(F.col("ts").between(lo, hi))


def size_limited(rows: DataFrame, limit: int, key: str = "key", size: str = "size", group: str | None = None) -> DataFrame:
    """Rows in key order until the sum of sizes passes the limit; the row that passes it is still read."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("read_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("read_before") < limit)


def attribute_groups(states: dict[str, DataFrame], key: str = "key", value: str = "value") -> DataFrame:
    """(key, a column for each family): one key's entries across families."""
    out = None
    for name, state in states.items():
        one = state.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out


def key_versions(log: DataFrame, begin, end, limit: int) -> DataFrame:
    """Raw versions of keys in [begin, end], both inclusive, newest first within a key, at most ``limit``."""
    return log.where(F.col("key").between(begin, end)).orderBy("key", F.col("seq").desc()).limit(limit)
