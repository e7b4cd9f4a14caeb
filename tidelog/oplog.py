"""The operation log, and its builders from the driver tables.

A log row is (cf, key, seq, op, value, cols, end_key, ts, write_time, txn_id). ``key`` may be of
any type that Spark orders; BINARY compares as unsigned bytes, shorter prefixes first. Operators need
only the columns that they read, so a builder may leave others out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, ENTITY, DELETE, SINGLE_DELETE, MERGE, RANGE_DELETE, LOG_DATA = "PUT", "ENTITY", "DELETE", "SINGLE_DELETE", "MERGE", "RANGE_DELETE", "LOG_DATA"
#: Kinds that give a value, that take it away, and that end the search for older versions.
VALUES, DELETIONS = (PUT, ENTITY), (DELETE, SINGLE_DELETE)
BASES = VALUES + DELETIONS
POINTS = (*BASES, MERGE)
SCHEMA = "cf string, key binary, seq bigint, op string, value binary, cols map<string,binary>, end_key binary, ts bigint, write_time bigint, txn_id string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = day * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def cents(x: str) -> Column:
    """A double as a whole number of hundredths, so that sums don't depend on their order."""
    return F.floor(F.col(x) * 100 + F.lit(0.5)).cast("bigint")


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed log: signups put, errors delete (each tenth sequence number a range of three users), others merge."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    ranged = error & (F.col("event_id") % 10 == 0)
    return e.select(
        F.lit("events").alias("cf"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", PUT).when(ranged, RANGE_DELETE).when(error, DELETE).otherwise(MERGE).alias("op"),
        cents("value").alias("value"), F.when(ranged, F.col("user_id") + 3).alias("end_key"), micros("ts").alias("ts"),
    )


def op_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of customers' totals: every order puts its price at its customer's key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("cf"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(PUT).alias("op"), cents("o_totalprice").alias("value"), F.lit(None).cast("bigint").alias("end_key"), micros("o_orderdate").alias("ts"))


def op_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge operands at parts' keys; rows are not unique, so nothing here may need a tie to be broken."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("lineitem").alias("cf"), F.col("l_partkey").alias("key"), F.lit(MERGE).alias("op"), F.col("l_quantity").cast("bigint").alias("value"), "l_returnflag", "l_orderkey", "l_linenumber")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as wide-column entities; the default column (of empty name) holds the market segment."""
    c = table(spark, sf_dir, "customer")
    cols = F.create_map(F.lit(""), F.col("c_mktsegment"), F.lit("acctbal"), cents("c_acctbal").cast("string"), F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select(F.lit("customer").alias("cf"), F.col("c_custkey").alias("key"), F.col("c_custkey").alias("seq"), F.lit(ENTITY).alias("op"), F.lit(None).cast("string").alias("value"), cols.alias("cols"))


def probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up, some of which don't exist."""
    n = table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") * 7).cast("bigint").alias("key"))


def docs_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under string keys ``source:doc_id``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key"), F.col("doc_id").alias("seq"), F.col("text").alias("value"), "lang")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses: the event type as the kind, the user as the key; small values count as misses."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "SEEK").when(F.col("event_type") == "signup", "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("MERGE")
    return e.select(kind.alias("type"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), micros("ts").alias("access_time"), F.when(F.col("value") > 100, F.length("props")).otherwise(0).cast("bigint").alias("value_size"))
