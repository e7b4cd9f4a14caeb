"""Range tombstones, compaction, filters and expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..operators import compact as C
from ..operators.ranges import fragments, range_join
from .registry import EV, ORD, query

S1, S2, S3 = 2000, 5000, 8000
_STRIPE = f"((seq > {S1})::INT + (seq > {S2})::INT + (seq > {S3})::INT)"
_TOMBS = "t AS (SELECT key AS b, end_key AS e, seq FROM ev WHERE op = 'RANGE_DELETE' AND key < end_key)"
_FRAGS = f"WITH {EV}, {_TOMBS}, bounds AS (SELECT b FROM t UNION SELECT e FROM t), f AS (SELECT b AS begin_key, lead(b) OVER (ORDER BY b) AS end_key FROM bounds)"


def _tombs(spark, sf):
    return L.op_events(spark, sf).where(F.col("op") == L.RANGE_DELETE).select(F.col("key").alias("begin_key"), "end_key", "seq")


@query(_FRAGS + " SELECT begin_key, end_key, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) AS seqs FROM f JOIN t ON t.b <= f.begin_key AND f.begin_key < t.e WHERE end_key IS NOT NULL GROUP BY 1, 2")
def tombstone_fragments(spark, sf):
    return fragments(_tombs(spark, sf)).select("begin_key", "end_key", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))


@query(f"WITH {EV}, {_TOMBS}, k AS (SELECT DISTINCT key FROM ev) SELECT k.key, coalesce((SELECT max(seq) FROM t WHERE t.b <= k.key AND k.key < t.e), 0) AS max_seq FROM k")
def max_covering_seq(spark, sf):
    keys = L.op_events(spark, sf).select("key").distinct()
    hit = range_join(keys, _tombs(spark, sf), F.lit(True), "inner").groupBy("key").agg(F.max("seq").alias("max_seq"))
    return keys.join(hit, "key", "left").select("key", F.coalesce("max_seq", F.lit(0)).cast("bigint").alias("max_seq"))


@query(f"WITH {EV} SELECT {_STRIPE} AS stripe, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ev WHERE op = 'RANGE_DELETE' GROUP BY 1")
def tombstones_by_stripe(spark, sf):
    t = _tombs(spark, sf).withColumn("stripe", C.stripe([S1, S2, S3]))
    return t.groupBy("stripe").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {ORD}, r AS (SELECT *, row_number() OVER (PARTITION BY key, {_STRIPE} ORDER BY seq DESC) AS n FROM o) SELECT key, seq, value FROM r WHERE n = 1")
def compact_stripes(spark, sf):
    return C.compact(L.op_orders(spark, sf), [S1, S2, S3]).select("key", "seq", "value")


_COMPACT = f"""WITH {EV}, s AS (SELECT *, {_STRIPE} AS stripe FROM ev),
p AS (SELECT * FROM s WHERE op <> 'RANGE_DELETE' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.op = 'RANGE_DELETE' AND t.stripe = s.stripe AND t.seq > s.seq AND s.key >= t.key AND s.key < t.end_key)),
b AS (SELECT *, max(CASE WHEN op <> 'MERGE' THEN seq END) OVER (PARTITION BY key, stripe) AS base_seq FROM p),
g AS (SELECT key, stripe, max(seq) AS seq, count(*) FILTER (op = 'MERGE') AS m, max(op) FILTER (op <> 'MERGE') AS base_op, max(value) FILTER (op = 'PUT') AS base, sum(value) FILTER (op = 'MERGE') AS folded
      FROM b WHERE seq >= coalesce(base_seq, -1) GROUP BY key, stripe),
c AS (SELECT key, stripe, seq, CASE WHEN m = 0 THEN base_op WHEN base_op IS NULL THEN 'MERGE' ELSE 'PUT' END AS op, CAST(CASE WHEN m > 0 THEN coalesce(base, 0) + folded ELSE base END AS BIGINT) AS value FROM g)"""


_LEFT = "SELECT key, seq, op, CAST(NULL AS BIGINT), end_key FROM s WHERE op = 'RANGE_DELETE' AND key < end_key"


@query(_COMPACT + f" SELECT key, seq, op, value, CAST(NULL AS BIGINT) AS end_key FROM c UNION ALL {_LEFT}")
def compact_merge_collapse(spark, sf):
    return C.rewrite(L.op_events(spark, sf), [S1, S2, S3]).select("key", "seq", "op", "value", "end_key")


_BOTTOM = (
    _COMPACT
    + """, d AS (SELECT *, coalesce(max(CASE WHEN op <> 'DELETE' THEN 1 END) OVER (PARTITION BY key ORDER BY stripe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
k AS (SELECT *, min(stripe) OVER (PARTITION BY key) AS lowest FROM d WHERE NOT (op = 'DELETE' AND below = 0))
SELECT key, CAST(CASE WHEN stripe = 0 AND op <> 'DELETE' THEN 0 ELSE seq END AS BIGINT) AS seq, CASE WHEN op = 'MERGE' AND stripe = lowest THEN 'PUT' ELSE op END AS op, value, CAST(NULL AS BIGINT) AS end_key FROM k
UNION ALL """
    + _LEFT
    + " AND stripe > 0"
)


@query(_BOTTOM)
def compact_bottommost(spark, sf):
    return C.rewrite(L.op_events(spark, sf), [S1, S2, S3], bottommost=True).select("key", "seq", "op", "value", "end_key")


def _single(spark, sf):
    """Signups put, errors delete singly."""
    log = L.op_events(spark, sf).where(F.col("op").isin(L.PUT, L.DELETE, L.RANGE_DELETE))
    return log.withColumn("op", F.when(F.col("op") == L.PUT, L.PUT).otherwise(L.SINGLE_DELETE))


_SINGLE = f"WITH {EV}, s AS (SELECT key, seq, CASE WHEN op = 'PUT' THEN 'PUT' ELSE 'SINGLE_DELETE' END AS op, value, (seq > {S2})::INT AS stripe FROM ev WHERE op <> 'MERGE')"


@query(
    _SINGLE
    + """, n AS (SELECT *, lead(op) OVER w AS a, lead(stripe) OVER w AS sa, lag(op) OVER w AS b, lag(stripe) OVER w AS sb FROM s WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, op, CASE WHEN op = 'PUT' AND a = 'SINGLE_DELETE' THEN NULL ELSE value END AS value FROM n
WHERE NOT coalesce((op = 'SINGLE_DELETE' AND b = 'PUT' AND sb = stripe) OR (op = 'PUT' AND a = 'SINGLE_DELETE' AND sa = stripe), FALSE)"""
)
def compact_single_delete(spark, sf):
    return C.annihilate_single_deletes(_single(spark, sf), [S2]).select("key", "seq", "op", "value")


@query(
    _SINGLE
    + """, e AS (SELECT *, coalesce(sum((op = 'SINGLE_DELETE')::INT) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM s)
SELECT key, max(seq) FILTER (op = 'SINGLE_DELETE') AS seq, count(*) FILTER (op = 'PUT') AS puts, CAST(0 AS BIGINT) AS others FROM e GROUP BY key, era HAVING max(seq) FILTER (op = 'SINGLE_DELETE') IS NOT NULL AND count(*) FILTER (op = 'PUT') <> 1"""
)
def single_delete_violations(spark, sf):
    return C.single_delete_violations(_single(spark, sf)).select("key", "seq", "puts", "others")


@query(
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ev WHERE op = 'PUT'),
d AS (SELECT *, CASE WHEN n > 1 THEN 'KEEP' WHEN value % 5 = 0 THEN 'REMOVE' WHEN value % 5 = 1 THEN 'CHANGE' WHEN value % 5 = 2 THEN 'PURGE' ELSE 'KEEP' END AS decision FROM r)
SELECT key, seq, CASE WHEN decision = 'REMOVE' THEN 'DELETE' ELSE op END AS op, CASE WHEN decision = 'CHANGE' THEN value * 2 WHEN decision = 'REMOVE' THEN NULL ELSE value END AS value, decision FROM d WHERE decision <> 'PURGE'"""
)
def compaction_filter_decisions(spark, sf):
    kind = F.col("value") % 5
    log = L.op_events(spark, sf).where(F.col("op") == L.PUT)
    decision = F.when(kind == 0, "REMOVE").when(kind == 1, "CHANGE").when(kind == 2, "PURGE").otherwise("KEEP")
    return C.filtered(log, decision, F.col("value") * 2).select("key", "seq", "op", "value", "decision")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0")
def remove_empty_value(spark, sf):
    return L.table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value FROM o GROUP BY key), skip AS (SELECT key AS b, key + 3 AS e FROM s WHERE value % 11 = 0) SELECT key, value FROM s WHERE NOT EXISTS (SELECT 1 FROM skip WHERE s.key >= b AND s.key < e)")
def skip_until(spark, sf):
    from ..operators.resolve import latest

    state = latest(L.op_orders(spark, sf)).select("key", "value")
    return C.skip_until(state, state.where("value % 11 = 0").select(F.col("key").alias("begin_key"), (F.col("key") + 3).alias("end_key")))


_NOW = 1_704_160_000  # seconds


@query(f"SELECT event_id, user_id FROM events WHERE floor(epoch_us(ts) / 1000000.0) + 3600 >= (SELECT max(floor(epoch_us(ts) / 1000000.0)) - 7200 FROM events)")
def ttl_db(spark, sf):
    e = L.table(spark, sf, "events").withColumn("write_time", F.floor(L.micros("ts") / 1_000_000))
    now = e.agg(F.max("write_time")).first()[0] - 7200
    return C.live_db_ttl(e, 3600, now).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 OR event_id * 10 > 30000")
def ttl_blob_until(spark, sf):
    e = L.table(spark, sf, "events").withColumn("expiration", F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 10))
    return C.live_until(e, 30_000).select("event_id", "user_id")


@query(f"WITH {EV} SELECT key, seq, value FROM ev WHERE op = 'PUT' AND NOT (seq + 3000 <= 6000)")
def ttl_state_value(spark, sf):
    log = L.op_events(spark, sf).where(F.col("op") == L.PUT)
    return log.where(~C.state_expired(F.col("seq"), 3000, 6000)).select("key", "seq", "value")


@query(
    "WITH e AS (SELECT conv_id, turn, (turn * 37 + conv_id) % 100 AS ts FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (NOT (ts + 30 <= 70)) AS first_live FROM e GROUP BY conv_id) "
    "SELECT e.conv_id, string_agg(CAST(e.turn AS VARCHAR), ',' ORDER BY e.turn) AS turns FROM e JOIN f ON e.conv_id = f.conv_id AND e.turn >= f.first_live GROUP BY e.conv_id"
)
def ttl_state_list(spark, sf):
    e = L.table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("turn") * 37 + F.col("conv_id")) % 100).alias("ts"))
    lists = e.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ts"))).alias("elements"))
    live = lists.withColumn("elements", C.live_list_suffix(F.col("elements"), 30, 70)).where("elements IS NOT NULL")
    return live.select("conv_id", F.array_join(F.transform("elements", lambda x: x["turn"].cast("string")), ",").alias("turns"))


def _row_versions(spark, sf):
    """Three versions of each customer's row with two columns each; some have a row tombstone."""
    c = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.lit([0, 1, 2])).alias("version"))
    ts = lambda i: (F.col("key") * 7 + F.col("version") * 13 + i * 3) % 50 * 3 + F.col("version")
    cell = lambda i: F.struct(((F.col("version") + i) % 3).cast("int").alias("index"), ts(i).alias("ts"), F.when((F.col("key") + i) % 4 == 0, (F.col("key") % 40)).alias("ttl"), F.lit(0).alias("mask"), (F.col("key") * 10 + F.col("version") * 2 + i).alias("value"))
    return c.select("key", "version", F.when((F.col("key") + F.col("version")) % 5 == 0, ts(9)).alias("row_tombstone"), F.array(cell(0), cell(1)).alias("columns"))


_CASS = """WITH v AS (SELECT c_custkey AS key, x.version AS version, i.i AS i FROM customer CROSS JOIN (VALUES (0), (1), (2)) x(version) CROSS JOIN (VALUES (0), (1)) i(i)),
r AS (SELECT key, version, (version + i) % 3 AS index, (key * 7 + version * 13 + i * 3) % 50 * 3 + version AS ts, CASE WHEN (key + i) % 4 = 0 THEN key % 40 END AS ttl, key * 10 + version * 2 + i AS value,
  max(CASE WHEN (key + version) % 5 = 0 THEN (key * 7 + version * 13 + 27) % 50 * 3 + version END) OVER (PARTITION BY key) AS dead FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY key, index ORDER BY ts DESC, version) AS n FROM r WHERE dead IS NULL OR ts > dead),
m AS (SELECT key, index, ts, ttl, value FROM w WHERE n = 1)"""


@query(_CASS + " SELECT key, CAST(index AS INT) AS index, ts, ttl, value FROM m")
def cassandra_merge(spark, sf):
    return C.merge_rows(_row_versions(spark, sf)).select("key", "index", "ts", "ttl", "value")


@query(_CASS + " SELECT key, CAST(index AS INT) AS index, CAST(CASE WHEN ttl IS NOT NULL AND ts + ttl < 100 THEN 1 ELSE 0 END AS INT) AS mask, CASE WHEN ttl IS NOT NULL AND ts + ttl < 100 THEN NULL ELSE value END AS value FROM m")
def cassandra_expire(spark, sf):
    cells = C.merge_rows(_row_versions(spark, sf)).withColumn("ts", F.col("ts") * 1_000_000)
    return C.expire_cells(cells, 100, purge=False).select("key", "index", "mask", "value")


@query(_CASS + " SELECT key, CAST(index AS INT) AS index, value FROM m WHERE NOT (ttl IS NOT NULL AND ts + ttl < 100)")
def cassandra_purge(spark, sf):
    cells = C.merge_rows(_row_versions(spark, sf)).withColumn("ts", F.col("ts") * 1_000_000)
    return C.expire_cells(cells, 100, purge=True).select("key", "index", "value")


@query(
    f"""WITH {EV}, x AS (SELECT 'f' || CAST(seq % 8 AS VARCHAR) AS file, key, seq, (op IN ('DELETE', 'RANGE_DELETE'))::INT AS d FROM ev),
r AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY key, seq DESC) - 1) // 1 AS b FROM x),
s AS (SELECT file, d, sum(d) OVER (PARTITION BY file ORDER BY b RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS seen FROM r)
SELECT file, count(*) AS entries, CAST(sum(d) AS BIGINT) AS deletes, max(seen) >= 28 AS needs_compaction FROM s GROUP BY file"""
)
def compact_on_deletion(spark, sf):
    log = L.op_events(spark, sf).withColumn("file", F.concat(F.lit("f"), (F.col("seq") % 8).cast("string")))
    return C.deletion_triggered(log, 100, 28, file="file").select("file", "entries", "deletes", "needs_compaction")


_FILES = "f AS (SELECT CAST(date_diff('month', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS create_time, count(*) AS size FROM lineitem GROUP BY 1)"


def _files(spark, sf):
    month = F.timestamp_diff("MONTH", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"))
    return L.table(spark, sf, "lineitem").groupBy(month.alias("create_time")).agg(F.count("*").alias("size")).withColumn("file", F.col("create_time"))


@query(f"WITH {_FILES} SELECT create_time, size FROM f WHERE create_time >= 330 - 24")
def fifo_ttl(spark, sf):
    return C.fifo_ttl(_files(spark, sf), 24, 330).select("create_time", "size")


@query(f"WITH {_FILES}, r AS (SELECT *, sum(size) OVER (ORDER BY create_time DESC) AS total FROM f) SELECT create_time, size, CAST(total AS BIGINT) AS total FROM r WHERE total <= 20000")
def fifo_size(spark, sf):
    return C.fifo_size(_files(spark, sf), 20_000).select("create_time", "size", "total")


@query(f"WITH {ORD} SELECT key, seq, value FROM o WHERE key >= 100 AND key < 200")
def clip_range(spark, sf):
    return C.clip(L.op_orders(spark, sf), 100, 200).select("key", "seq", "value")


@query(f"WITH {ORD} SELECT key, seq, value FROM o WHERE ts <= 852076800000000")
def trim_history(spark, sf):
    return C.trim_history(L.op_orders(spark, sf), 852_076_800_000_000).select("key", "seq", "value")


@query(f"WITH {ORD}, r AS (SELECT *, row_number() OVER (PARTITION BY key, ts < 852076800000000 ORDER BY ts DESC, seq DESC) AS n FROM o) SELECT key, seq, value FROM r WHERE ts >= 852076800000000 OR n = 1")
def full_history_ts_low(spark, sf):
    return C.collect_history(L.op_orders(spark, sf), 852_076_800_000_000).select("key", "seq", "value")


@query(f"WITH {ORD} SELECT CASE WHEN seq > 30000 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS n FROM o GROUP BY 1")
def tier_placement(spark, sf):
    return C.placement(L.op_orders(spark, sf), 30_000).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT count(*) FILTER (length(CAST(value AS VARCHAR)) >= 4) AS n_large, count(*) FILTER (length(CAST(value AS VARCHAR)) < 4) AS n_small FROM ev WHERE op = 'PUT'")
def blob_separation(spark, sf):
    size = F.length(F.col("value").cast("string"))
    return L.op_events(spark, sf).where(F.col("op") == L.PUT).agg(F.count_if(size >= 4).alias("n_large"), F.count_if(size < 4).alias("n_small"))
