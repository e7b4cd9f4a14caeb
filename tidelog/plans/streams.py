"""Streams that read all there is and stop, held against the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import oplog as L
from ..shared import shared_folder
from ..streaming import streams
from .registry import EV, TR, query, resolved


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/tidelog/stream-{uuid.uuid4().hex}"


def _log(spark, sf):
    """The log in three files, as three batches of a stream."""
    folder = _folder(spark)
    log = L.op_events(spark, sf).select("cf", "key", "seq", "op", "value", "end_key")
    log.repartitionByRange(3, "seq").write.parquet(f"{folder}/log")
    return folder, streams.tail(spark, f"{folder}/log", log.schema, 1)


@query(f"WITH {EV} SELECT key, seq, op, value, end_key FROM ev")
def cdc_stream(spark, sf):
    folder, stream = _log(spark, sf)
    streams.capture(stream, f"{folder}/out", f"{folder}/offsets")
    return spark.read.parquet(f"{folder}/out").select("key", "seq", "op", "value", "end_key")


@query(f"WITH {EV}, {resolved()} SELECT key, value, seq FROM res")
def replica_stream(spark, sf):
    folder, stream = _log(spark, sf)
    streams.replica(stream, f"{folder}/out", f"{folder}/offsets")
    return streams.replica_state(spark, f"{folder}/out").select("key", "value", "seq")


@query(f"WITH {EV} SELECT key, seq, value FROM ev WHERE op = 'PUT' AND NOT (seq + 3000 <= 6000)")
def ttl_stream(spark, sf):
    """Expiry of stream state by its own time, in the stream."""
    from ..operators.compact import state_expired

    folder, stream = _log(spark, sf)
    live = stream.where((F.col("op") == L.PUT) & ~state_expired(F.col("seq"), 3000, 6000))
    streams.capture(live, f"{folder}/out", f"{folder}/offsets")
    return spark.read.parquet(f"{folder}/out").select("key", "seq", "value")


def _timed(spark, sf, parts: int = 3):
    """Events with their times, in files in the order of their ids."""
    folder = _folder(spark)
    e = L.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.timestamp_micros(L.micros("ts")).alias("t"), L.cents("value").alias("value"))
    e.repartitionByRange(parts, "event_id").write.parquet(f"{folder}/in")
    return folder, streams.tail(spark, f"{folder}/in", e.schema, 1)


def _last_updates(spark, folder, counts, by):
    streams.run_to_end(counts, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets", "update")
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(*by).agg(F.max_by("n", "batch").alias("n"))


@query("SELECT CAST(epoch_us(ts) // 21600000000 - k AS BIGINT) AS slot, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def sliding_windows(spark, sf):
    """Windows of twelve hours that begin every six; the last update of a window is its count."""
    folder, stream = _timed(spark, sf)
    counts = streams.sliding_rates(stream, "t", "12 hours", "6 hours", "60 days").select(F.expr("unix_micros(window.start) div 21600000000").alias("slot"), "n")
    return _last_updates(spark, folder, counts, ["slot"])


@query(
    """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 3600000000 * 6 THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT key, min(t) AS started, max(t) + 3600000000 * 6 AS ended, count(*) AS n FROM s GROUP BY key, session"""
)
def session_windows(spark, sf):
    """Sessions of each user, ended by six hours without an event. Files may come in any order; a mark far ahead closes all."""
    from datetime import datetime, timedelta

    folder, stream = _timed(spark, sf)
    last = spark.read.parquet(f"{folder}/in").agg(F.max("t")).first()[0]
    for k in (1, 2):  # a late row of its own, and one more batch in which the mark counts
        spark.createDataFrame([(-k, -1, (last or datetime(2024, 1, 1)) + timedelta(days=100 * k), 0)], "event_id bigint, key bigint, t timestamp, value bigint").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    found = streams.sessions(stream, "t", "6 hours", "60 days", ["key"]).select("key", F.unix_micros("session_window.start").alias("started"), F.unix_micros("session_window.end").alias("ended"), "n")
    streams.run_to_end(found, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets", "append")
    return spark.read.parquet(f"{folder}/out").where("key >= 0").select("key", "started", "ended", "n")


@query(f"WITH {EV}, r AS (SELECT key, seq, ts, value, row_number() OVER (PARTITION BY key, ts < (SELECT max(ts) FROM ev) - 864000000000 ORDER BY ts DESC, seq DESC) AS n FROM ev WHERE op = 'PUT') SELECT key, seq, value FROM r WHERE n = 1 OR ts >= (SELECT max(ts) FROM ev) - 864000000000")
def watermark_gc(spark, sf):
    """History that a rising low watermark collects: ten days stay, and before them each key's newest version."""
    folder = _folder(spark)
    log = L.op_events(spark, sf).select("cf", "key", "seq", "op", "value", "ts")
    # the newest time comes with the first batch, so that what is collected doesn't depend on the order of batches
    top = log.agg(F.max("ts")).first()[0]
    log.where((F.col("op") == L.PUT) | (F.col("ts") == top)).repartitionByRange(3, F.col("ts").desc()).write.parquet(f"{folder}/log")
    streams.trimmed(streams.tail(spark, f"{folder}/log", log.schema, 1), f"{folder}/out", f"{folder}/offsets", 864_000_000_000)
    out = spark.read.parquet(f"{folder}/out")
    return out.where((F.col("version") == out.agg(F.max("version")).first()[0]) & (F.col("op") == L.PUT)).select("key", "seq", "value")


@query(f"WITH {EV}, l AS (SELECT key, ts, value FROM ev WHERE op = 'PUT'), n AS (SELECT *, max(ts) OVER (PARTITION BY key) AS now FROM l) SELECT key, count(*) AS n, min(ts) AS oldest, CAST(sum(value) AS BIGINT) AS total FROM n WHERE ts + 864000000000 > now GROUP BY key")
def list_state_ttl(spark, sf):
    """A list state whose elements expire ten days before the key's newest one."""
    folder = _folder(spark)
    log = L.op_events(spark, sf).where(F.col("op") == L.PUT).select("key", "ts", "value")
    log.repartitionByRange(3, "ts").write.parquet(f"{folder}/log")
    stream = streams.tail(spark, f"{folder}/log", log.schema, 1)
    streams.run_to_end(streams.expiring_lists(stream, 864_000_000_000), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets", "update", processors=True)
    out = spark.read.parquet(f"{folder}/out")
    newest = lambda c: F.max_by(c, "batch").alias(c)
    return out.groupBy("key").agg(newest("n"), newest("oldest"), newest("total"))


@query(f"WITH {EV}, m AS (SELECT min(seq) AS lo, max(seq) AS hi FROM ev), b AS (SELECT k, lo + (hi + 1 - lo) * (k + 1) // 3 AS upto FROM m, (VALUES (0), (1), (2)) v(k)), " + "".join(f"s{k} AS (SELECT ev.* FROM ev, b WHERE k = {k} AND seq < upto), {resolved(f's{k}', name=f'r{k}')}, " for k in range(3)) + "x AS (SELECT 0 AS batch, key, value FROM r0 UNION ALL SELECT 1, key, value FROM r1 UNION ALL SELECT 2, key, value FROM r2) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_keys, CAST(sum(value) AS BIGINT) AS total FROM x GROUP BY 1")
def tailing_state(spark, sf):
    """A tailing read: after each batch of the log, the state that is there by then."""
    folder = _folder(spark)
    log = L.op_events(spark, sf).select("cf", "key", "seq", "op", "value", "end_key")
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    for k in range(3):
        a, b = (lo + (hi + 1 - lo) * x // 3 for x in (k, k + 1))
        log.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/log")

    def note(n: int) -> None:
        state = streams.replica_state(spark, f"{folder}/out")
        state.agg(F.lit(n).cast("bigint").alias("batch"), F.count("*").alias("n_keys"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{folder}/seen/at={n}")

    streams.replica(streams.tail(spark, f"{folder}/log", log.schema, 1), f"{folder}/out", f"{folder}/offsets", note)
    return spark.read.parquet(f"{folder}/seen").select("batch", "n_keys", "total")


@query(
    f"""WITH {TR}, w AS (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nxt FROM tr),
c AS (SELECT w.seq, count(*) AS n FROM w JOIN w o ON o.seq > w.prev AND o.seq < w.seq AND coalesce(o.nxt, 9223372036854775807) > w.seq GROUP BY w.seq),
d AS (SELECT w.seq, CASE WHEN w.prev IS NOT NULL THEN coalesce(c.n, 0) END AS distance FROM w LEFT JOIN c ON c.seq = w.seq)
SELECT CAST(c.c AS BIGINT) AS capacity, count(*) AS n, count(*) FILTER (distance < c.c) AS hits FROM d, (VALUES (20), (60), (120)) c(c) GROUP BY 1"""
)
def online_cache(spark, sf):
    """A simulated cache of several capacities beside a stream of accesses, with its keys kept between batches."""
    folder = _folder(spark)
    t = L.trace(spark, sf).select("key", "seq")
    lo, hi = t.agg(F.min("seq"), F.max("seq")).first()
    for k in range(3):
        a, b = (lo + (hi + 1 - lo) * x // 3 for x in (k, k + 1))
        t.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/trace")
    stream = streams.tail(spark, f"{folder}/trace", t.schema, 1)
    streams.run_to_end(streams.online_lru(stream, [20, 60, 120]), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets", "update", processors=True)
    return spark.read.parquet(f"{folder}/out").groupBy("capacity").agg(F.max("n").alias("n"), F.max("hits").alias("hits"))
