"""Sizes, properties and histograms of logs and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..oplog import DELETIONS, MERGE, RANGE_DELETE, VALUES
from .ranges import cut_points, place, range_join
from .scan import seek


def range_sizes(rows: DataFrame, ranges: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """(range_id, n, bytes) of ranges (range_id, begin_key, end_key); empty ranges count 0."""
    hit = range_join(rows, ranges, F.lit(True), "inner", key).groupBy("range_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return ranges.select("range_id").join(hit, "range_id", "left").select("range_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def key_anchors(rows: DataFrame, n: int, key: str = "key", run: int = 1_000_000, least: int = 64) -> DataFrame:
    """(anchor, first_key, n): first keys of n runs of about equal size.

    Exact ranks without one task that sorts all: rows are dealt into ranges of about ``run`` rows and sorted there, ranges'
    counts give each one its first rank, and a row's rank is that plus its place.
    """
    cuts = cut_points(rows, key, max(least, rows.count() // run))
    ordered = rows.select(key).withColumn("p", place(F.col(key), cuts))
    counts = ordered.groupBy("p").agg(F.count("*").alias("c"))
    before = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    ranked = ordered.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1).join(F.broadcast(before), "p").withColumn("rank", F.col("before") + F.col("at"))
    small, extra = F.floor(F.col("total") / n), F.col("total") % n
    tile = F.when(F.col("rank") < extra * (small + 1), F.floor(F.col("rank") / (small + 1))).otherwise(extra + F.floor((F.col("rank") - extra * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return ranked.groupBy(tile.cast("int").alias("anchor")).agg(F.min(key).alias("first_key"), F.count("*").alias("n"))


def properties(log: DataFrame) -> DataFrame:
    """One row of counts by kind, distinct keys and value bytes."""
    kind = F.col("op")
    return log.agg(
        F.count("*").alias("num_entries"), F.count_if(kind.isin(*DELETIONS)).alias("num_deletes"), F.count_if(kind == RANGE_DELETE).alias("num_range_deletes"), F.count_if(kind == MERGE).alias("num_merges"),
        F.count_if(kind.isin(*VALUES)).alias("num_puts"), F.countDistinct("key").alias("num_keys"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.max("seq").alias("latest_seq"),
    )


def bucket_limits(most: int = 1 << 64) -> list[int]:
    """Powers of 1.5 times 2 up to ``most``, whole, and cut to leading digits under 110; the first is 1."""
    out, value = [1, 2], 3.0
    while value <= most:
        unit = next(10**k for k in range(40) if int(value) // 10**k < 110)
        out.append(int(value) // unit * unit)
        value *= 1.5
    return out


def histogram(rows: DataFrame, value: str, percents: list[int], limits: list[int] | None = None) -> DataFrame:
    """(percent, value): percentiles interpolated within buckets between limits, kept within the smallest and largest value.

    Buckets hold counts only, so the rows are aggregated once, before any ordering.
    """
    limits = limits or bucket_limits(1 << 40)
    bucket = F.least(F.size(F.filter(F.lit(limits), lambda x: x < F.col(value))), F.lit(len(limits) - 1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    all_rows = Window.partitionBy(F.lit(0))
    run = counts.withColumns({"before": F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(all_rows), "least": F.min("lo").over(all_rows), "most": F.max("hi").over(all_rows)})
    asked = rows.sparkSession.createDataFrame([(p,) for p in percents], "percent int")
    hit = F.broadcast(asked).join(run, (F.col("before") < F.col("n") * F.col("percent") / 100) & (F.col("before") + F.col("c") >= F.col("n") * F.col("percent") / 100))
    limit = lambda i: F.element_at(F.lit(limits), i.cast("int")).cast("double")
    left = F.when(F.col("b") == 0, F.lit(0.0)).otherwise(limit(F.greatest(F.col("b"), F.lit(1))))
    right = limit(F.col("b") + 1)
    at = left + (right - left) * (F.col("n") * F.col("percent") / 100 - F.col("before")) / F.col("c")
    return hit.select("percent", F.greatest(F.least(at, F.col("most").cast("double")), F.col("least").cast("double")).alias("value"))


def history_deltas(rows: DataFrame, time: str, value: str, by: list[str]) -> DataFrame:
    """Counters as differences between successive times."""
    w = Window.partitionBy(*by).orderBy(time)
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def order_check(rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row for each file: whether keys ascend, newest versions first, and how many records it holds."""
    w = Window.partitionBy("file").orderBy("position")
    prev_key, prev_seq = F.lag(key).over(w), F.lag(seq).over(w)
    bad = (prev_key > F.col(key)) | ((prev_key == F.col(key)) & (prev_seq <= F.col(seq)))
    return rows.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy("file").agg(F.count("*").alias("n"), F.count_if("bad").alias("out_of_order"))


def rising(pairs: DataFrame, run: int = 1 << 20) -> DataFrame:
    """Pairs (seq, time) whose times ascend with their numbers: each gets the latest time so far, and of equal times the greatest number stays.

    Numbers are dealt into runs: each is done on its own, and a row for each run tells the latest time before it.
    """
    rows = pairs.withColumn("run__", F.expr(f"seq div {run}"))
    before = rows.groupBy("run__").agg(F.max("time").alias("t")).select("run__", F.max("t").over(Window.orderBy("run__").rowsBetween(Window.unboundedPreceding, -1)).alias("before__"))
    inside = F.max("time").over(Window.partitionBy("run__").orderBy("seq"))
    top = rows.withColumn("time", inside).join(before, "run__").select("seq", F.greatest("time", "before__").alias("time"))
    return top.groupBy("time").agg(F.max("seq").alias("seq")).select("seq", "time")


def sequence_times(probes: DataFrame, pairs: DataFrame, to_time: bool) -> DataFrame:
    """(…probe, answer) by pairs (seq, time), each ascending with the other.

    To time: the time of the greatest pair with pair.seq < seq, strictly. To sequence: that of the greatest pair with
    pair.time <= t. Null where none is known. Probes seek their pair; neither side is gathered.
    """
    by, other = ("seq", "time") if to_time else ("time", "seq")
    asked = probes.select((F.col("probe") - F.lit(1 if to_time else 0)).alias("at__")).distinct()
    near = seek(pairs, asked, False, by, "at__")
    found = near.join(pairs, by).select("at__", F.col(other).alias("answer"))
    return probes.withColumn("at__", F.col("probe") - F.lit(1 if to_time else 0)).join(found, "at__", "left").drop("at__")


def windowed(rows: DataFrame, time: str, value: str, width: int) -> DataFrame:
    """(slot, n, least, most, total, squares): all parts add up, so wider windows are merged from them."""
    return rows.groupBy(F.floor(F.col(time) / width).alias("slot")).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def advise(properties_: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Each row with the names of the rules, SQL conditions over its columns, that it triggers."""
    names = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items())))
    return properties_.withColumn("rule", F.explode(names))


def collected(rows: DataFrame, collectors: dict[str, Column], by: str = "file") -> DataFrame:
    """(file, n, …): each file's number of records and what the collectors, aggregates by name, say of them."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in collectors.items()))
