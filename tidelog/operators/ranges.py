"""Joins of keys with half-open ranges [begin, end).

What few ranges there are is known to the plan: a key's place among their bounds is a binary search in a literal. Beyond
FEW, keys and ranges are dealt into buckets between quantiles of the ranges' bounds, a range into each bucket that it
overlaps, and joined within buckets; so neither side is broadcast and no bucket has many bounds.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that the plan or a broadcast holds at most.
FEW = 20_000
#: Ranges in a bucket, about.
BUCKET = 400


def array_of(values: list) -> Column:
    """An array literal. Whole numbers and texts go as one text that is split when the plan is made, as each value would take a call of its own."""
    if values and all(type(v) is int and -(1 << 63) <= v < 1 << 63 for v in values):
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    if values and all(type(v) is str and "\x00" not in v for v in values):
        return F.split(F.lit("\x00".join(values)), "\x00", -1)
    return F.lit(values)


def place(x: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or before ``x``: a binary search, none of whose steps leaves the JVM."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    bounds = array_of(cuts)
    # beyond the last bound there is null, and null is not at or before anything
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= x, at + step).otherwise(at))


def sweep(ranges: list[tuple]) -> list[tuple]:
    """Disjoint (begin, end, greatest number) of ranges (begin, end, number), in order; neighbours differ in their number."""
    edges = sorted({x for b, e, _ in ranges for x in (b, e)})
    starts = sorted(ranges, key=lambda r: r[0])
    out: list[tuple] = []
    live: list[tuple] = []
    k = 0
    for begin, end in zip(edges, edges[1:]):
        while k < len(starts) and starts[k][0] <= begin:
            heappush(live, (-starts[k][2], starts[k][1]))
            k += 1
        while live and live[0][1] <= begin:
            heappop(live)
        if live:
            top = -live[0][0]
            if out and out[-1][1] == begin and out[-1][2] == top:
                out[-1] = (out[-1][0], end, top)
            else:
                out.append((begin, end, top))
    return out


def cover(key: Column, pieces: list[tuple]) -> Column:
    """The number of the piece of :func:`sweep` that holds the key; null if none does."""
    if not pieces:
        return F.lit(None).cast("bigint")
    cuts, tops = [], []
    for begin, end, top in pieces:
        if cuts and cuts[-1] == begin:
            tops[-1] = top
        else:
            cuts.append(begin)
            tops.append(top)
        cuts.append(end)
        tops.append(None)
    return F.get(array_of([-1 if t is None else t for t in tops]), place(key, cuts) - 1)


def cut_points(rows: DataFrame, key: str, buckets: int) -> list:
    """Bounds between runs of keys of about equal size, from the keys of a bounded sample: those that hash lowest."""
    sample = sorted(r[0] for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(40 * buckets).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if len(sample) >= buckets else []


def range_join(points: DataFrame, ranges: DataFrame, on: Column, how: str, key: str = "key", begin: str = "begin_key", end: str = "end_key", few: int = 2000, buckets: int | None = None) -> DataFrame:
    """``how`` is inner, left_anti, left_semi or left; ``on`` is what must hold besides the range."""
    within = (F.col(key) >= F.col(begin)) & (F.col(key) < F.col(end)) & on
    n = ranges.count()
    if n <= few:
        return points.join(F.broadcast(ranges), within, how)
    cuts = cut_points(ranges, begin, buckets or min(FEW, max(2, -(-n // BUCKET))))
    # a range without a bound holds no key; it would have no bucket either
    spread = ranges.where(F.col(begin) < F.col(end)).withColumn("bucket__", F.explode(F.sequence(place(F.col(begin), cuts), place(F.col(end), cuts))))
    keyed = points.withColumn("bucket__", place(F.col(key), cuts))
    dup = spread.withColumnRenamed("bucket__", "range_bucket__")
    return keyed.join(dup, (F.col("bucket__") == F.col("range_bucket__")) & within, how).drop("bucket__", "range_bucket__")


def fragments(tombs: DataFrame, begin: str = "begin_key", end: str = "end_key", group: list[str] | None = None) -> DataFrame:
    """(group, begin_key, end_key, seqs): disjoint ranges with the sequence numbers that cover each, newest first."""
    from pyspark.sql import Window

    group = group or []
    tombs = tombs.where(F.col(begin) < F.col(end))
    bounds = tombs.select(*group, F.col(begin).alias("b")).union(tombs.select(*group, F.col(end).alias("b"))).distinct()
    w = Window.partitionBy(*group).orderBy("b")
    pieces = bounds.withColumn("e", F.lead("b").over(w)).where("e IS NOT NULL")
    t = tombs.select(*(F.col(g).alias(f"t_{g}") for g in group), F.col(begin).alias("t_b"), F.col(end).alias("t_e"), F.col("seq").alias("t_seq"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"t_{g}"))
    hit = range_join(pieces, t, same, "inner", "b", "t_b", "t_e")
    return hit.groupBy(*group, F.col("b").alias("begin_key"), F.col("e").alias("end_key")).agg(F.sort_array(F.collect_set("t_seq"), False).alias("seqs"))
