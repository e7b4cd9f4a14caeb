"""Analytics of access traces (type, key, seq, access_time in microseconds, value_size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import running


def key_stats(trace: DataFrame) -> DataFrame:
    """Accesses and successes of each key by type: a GET succeeds iff its value isn't empty, others always."""
    ok = (F.col("type") != "GET") | (F.col("value_size") > 0)
    return trace.groupBy("type", "key").agg(F.count("*").alias("accesses"), F.count_if(ok).alias("successes"), F.sum("value_size").cast("bigint").alias("total_size"), F.max("value_size").alias("largest"))


def size_distribution(trace: DataFrame, interval: int) -> DataFrame:
    return trace.groupBy("type", F.floor(F.col("value_size") / interval).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def access_distribution(trace: DataFrame) -> DataFrame:
    """How many keys were accessed so many times."""
    return trace.groupBy("type", "key").agg(F.count("*").alias("accesses")).groupBy("type", "accesses").agg(F.count("*").alias("keys"))


def rates(trace: DataFrame, unit: int) -> DataFrame:
    """(slot, n, cumulative_keys): accesses in each unit of time, with zeros, and keys that were seen so far.

    Slots are few against accesses: they are summed up before the running sum is taken.
    """
    slot = F.floor(F.col("access_time") / unit).cast("bigint")
    t = trace.withColumn("slot", slot)
    counts = t.groupBy("slot").agg(F.count("*").alias("n"))
    new = t.groupBy("key").agg(F.min("slot").alias("slot")).groupBy("slot").agg(F.count("*").alias("new_keys"))
    span = counts.agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("slot"))
    rows = span.join(counts, "slot", "left").join(new, "slot", "left")
    w = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("slot", F.coalesce("n", F.lit(0)).alias("n"), F.sum(F.coalesce("new_keys", F.lit(0))).over(w).alias("cumulative_keys"))


def rate_summary(rates_: DataFrame) -> DataFrame:
    return rates_.agg(F.sum("n").alias("total"), F.max("n").alias("peak"), F.count("*").alias("slots"), F.max_by("slot", F.struct("n", (-F.col("slot")).alias("x"))).alias("peak_slot"))


def hottest(trace: DataFrame, k: int, by: str = "key") -> DataFrame:
    """The k most accessed; ties go to the smaller."""
    return trace.groupBy(by).agg(F.count("*").alias("accesses")).orderBy(F.col("accesses").desc(), F.col(by)).limit(k)


def correlation(trace: DataFrame) -> DataFrame:
    """(first_type, second_type, n, total_gap): each access with the latest earlier one of every other type on its key."""
    kinds = ["GET", "SEEK", "PUT", "DELETE", "MERGE"]
    rows = running(trace, "key", ["access_time", "seq"], {f"last_{k}": F.when(F.col("type") == k, F.col("access_time")) for k in kinds})
    pairs = rows.select("type", "access_time", F.explode(F.array(*(F.struct(F.lit(k).alias("first_type"), F.col(f"last_{k}").alias("t")) for k in kinds))).alias("p")).where("p.t IS NOT NULL")
    return pairs.groupBy(F.col("p.first_type").alias("first_type"), F.col("type").alias("second_type")).agg(F.count("*").alias("n"), F.sum(F.col("access_time") - F.col("p.t")).alias("total_gap"))


def coverage(keyspace: DataFrame, trace: DataFrame) -> DataFrame:
    """Every key of the key space with its accesses, 0 if it had none."""
    return keyspace.join(trace.groupBy("key").agg(F.count("*").alias("accesses")), "key", "left").select("key", F.coalesce("accesses", F.lit(0)).alias("accesses"))


def skewness(counts: DataFrame, parts: int) -> DataFrame:
    """(decile, keys, accesses) of keys (key, n) in ``parts`` equal runs, the most accessed first.

    Keys of one count are interchangeable here, so that only the different counts are ranked, with how many keys have each.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("c"))
    before = sizes.select("n", "c", F.coalesce(F.sum("c").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    small, extra = F.expr(f"total div {parts}"), F.col("total") % parts
    first = lambda p: p * small + F.least(p, extra)  # noqa: E731  the first rank of part p, counted from 0
    each = before.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    keys = F.least(F.col("a") + F.col("c"), first(F.col("p") + 1)) - F.greatest(F.col("a"), first(F.col("p")))
    return each.withColumn("keys", keys).where("keys > 0").groupBy((F.col("p") + 1).cast("int").alias("decile")).agg(F.sum("keys").alias("keys"), F.sum(F.col("keys") * F.col("n")).alias("accesses"))


def locality(trace: DataFrame, width: int) -> DataFrame:
    """(block, distinct_keys, gets, share_of_block) of blocks of ``width`` neighbouring keys."""
    per = trace.groupBy(F.floor(F.col("key") / width).alias("block"), "key").agg(F.count("*").alias("n"))
    return per.groupBy("block").agg(F.count("*").alias("distinct_keys"), F.sum("n").alias("gets"), F.round(F.count("*") / width, 6).alias("share_of_block"))


def reuse_timeline(trace: DataFrame, unit: int) -> DataFrame:
    rows = running(trace, "key", ["access_time", "seq"], {"last": F.col("access_time")}).select(F.floor(F.col("access_time") / unit).alias("to_day"), F.floor(F.col("last") / unit).alias("from_day"))
    return rows.where("from_day IS NOT NULL").groupBy("from_day", "to_day").agg(F.count("*").alias("n"))


def correlation_features(trace: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("access_time", "seq")
    rows = trace.select((F.col("access_time") - F.lag("access_time").over(w)).alias("past"), (F.lead("access_time").over(w) - F.col("access_time")).alias("next"), (F.row_number().over(w) - 1).alias("seen")).where("past IS NOT NULL AND next IS NOT NULL")
    return rows.agg(F.count("*").alias("n"), F.round(F.corr("past", "next"), 6).alias("past_interval"), F.round(F.corr("seen", "next"), 6).alias("past_accesses"))


def sampled(trace: DataFrame, frequency: int, without: list[str]) -> DataFrame:
    """Every ``frequency``-th record, without some kinds."""
    return trace.where((F.pmod(F.col("seq"), F.lit(frequency)) == 0) & ~F.col("type").isin(*without))


def as_log(trace: DataFrame) -> DataFrame:
    """The writes of a trace as a log, so that a replay is a read of it, by ``resolve`` as there are merges."""
    return trace.where(F.col("type").isin("PUT", "DELETE", "MERGE")).select(F.lit("trace").alias("cf"), "key", "seq", F.col("type").alias("op"), F.col("value_size").alias("value"), F.col("access_time").alias("ts"))


def handled(trace: DataFrame, handlers: dict[str, Column]) -> DataFrame:
    """Records whose type has a handler, each with its ``answer``; handlers are expressions over a record's columns."""
    answer = None
    for kind, handler in handlers.items():
        answer = F.when(F.col("type") == kind, handler) if answer is None else answer.when(F.col("type") == kind, handler)
    return trace.where(F.col("type").isin(*handlers)).withColumn("answer", answer)
