"""Batches, transactions, ingestion, change capture and recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import oplog as L
from ..operators import stats, txn
from ..operators.resolve import latest, of_keys, resolve
from .registry import EV, ORD, query, resolved


def _halves(spark, sf):
    o = L.op_orders(spark, sf)
    return o.where("seq % 2 = 0"), o.where("seq % 2 = 1")


@query(f"WITH {ORD}, s AS (SELECT key, value, CASE WHEN seq % 2 = 1 THEN seq + 1000000000 ELSE seq END AS seq FROM o) SELECT key, max_by(value, seq) AS value FROM s GROUP BY key")
def ingest_newer(spark, sf):
    """Ingested files are newer than all that is there."""
    from ..sources.files import ingest

    old, new = _halves(spark, sf)
    return latest(ingest(old, new.withColumn("seq", F.col("seq") + 1_000_000_000), keep_seq=True)).select("key", "value")


@query(f"WITH {ORD} SELECT key, CASE WHEN count(*) FILTER (seq % 2 = 0) > 0 THEN max_by(value, seq) FILTER (seq % 2 = 0) ELSE max_by(value, seq) FILTER (seq % 2 = 1) END AS value FROM o GROUP BY key")
def ingest_behind(spark, sf):
    """Files ingested behind show only where a key has nothing else."""
    from ..sources.files import ingest_behind as behind

    old, new = _halves(spark, sf)
    return latest(behind(old, latest(new).withColumn("op", F.lit(L.PUT)))).select("key", "value")


@query(f"WITH {EV}, {resolved()} SELECT key, value FROM res")
def batch_overlay(spark, sf):
    """Committed records with a batch of the later ones on top read as all of them."""
    log = L.op_events(spark, sf)
    batch = log.where("seq > 5000").withColumn("ordinal", F.col("seq") - 5001).drop("seq")
    return resolve(txn.overlay(log.where("seq <= 5000"), batch)).select("key", "value")


@query(f"WITH {EV} SELECT seq // 100 AS batch_id, count(*) AS n, count(*) FILTER (op = 'PUT') AS n_puts, count(*) FILTER (op = 'MERGE') AS n_merges, count(*) FILTER (op = 'DELETE') AS n_deletes, count(*) FILTER (op = 'RANGE_DELETE') AS n_range_deletes, bool_or(op = 'PUT') AS has_put, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY 1")
def batch_counts(spark, sf):
    return txn.batch_counts(L.op_events(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 100)))


@query(f"WITH {EV}, b AS (SELECT *, seq % 100 AS ordinal FROM ev) SELECT key, seq, op FROM b WHERE ordinal < 60")
def savepoint_rollback(spark, sf):
    return txn.rolled_back(L.op_events(spark, sf).withColumn("ordinal", F.col("seq") % 100), 60).select("key", "seq", "op")


_WS = "w AS (SELECT DISTINCT event_id // 50 AS txn, user_id AS key, (event_id // 50) * 50 - (event_id // 50) % 40 AS snap_seq FROM events)"


@query(f"WITH {EV}, {_WS}, l AS (SELECT key, max(seq) AS c FROM ev WHERE op IN ('PUT', 'DELETE') GROUP BY key), j AS (SELECT w.txn, coalesce(l.c > w.snap_seq, FALSE) AS late FROM w LEFT JOIN l ON l.key = w.key) SELECT txn, CASE WHEN bool_or(late) THEN 'Busy' ELSE 'OK' END AS status, count(*) FILTER (late) AS n_conflicts FROM j GROUP BY txn")
def occ_conflicts(spark, sf):
    """Every fifty events are a transaction that writes its users; puts and deletions are the commits."""
    t = F.floor(F.col("event_id") / 50)
    writes = L.table(spark, sf, "events").select(t.alias("txn"), F.col("user_id").alias("key"), (t * 50 - t % 40).alias("snap_seq")).distinct()
    return txn.conflicts(writes, L.op_events(spark, sf).where(F.col("op").isin(L.PUT, L.DELETE)))


@query(
    "WITH h AS (SELECT max(event_id) AS owner, user_id AS lo, user_id + count(*) % 3 AS hi FROM events GROUP BY user_id), w AS (SELECT min(event_id) AS waiter, user_id AS lo, user_id + 1 AS hi FROM events GROUP BY user_id) "
    "SELECT DISTINCT waiter, owner AS holder FROM w JOIN h ON h.lo <= w.hi AND w.lo <= h.hi AND owner <> waiter"
)
def range_lock_overlap(spark, sf):
    """Each user's last event holds a range that its first one of a neighbour may want."""
    e = L.table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("owner"), F.min("event_id").alias("waiter"), F.count("*").alias("n"))
    held = e.select("owner", F.col("user_id").alias("lo"), (F.col("user_id") + F.col("n") % 3).alias("hi"))
    return txn.lock_overlaps(held, e.select("waiter", F.col("user_id").alias("w_lo"), (F.col("user_id") + 1).alias("w_hi")))


@query("WITH c AS (SELECT event_id // 100 AS txn_id, max(event_id) + 50 AS commit_seq FROM events WHERE (event_id // 100) % 4 <> 3 GROUP BY 1) SELECT e.event_id, c.txn_id, c.commit_seq AS seq FROM events e JOIN c ON c.txn_id = e.event_id // 100 WHERE c.commit_seq <= 6000")
def commit_visibility(spark, sf):
    e = L.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("txn_id"))
    commits = e.where("txn_id % 4 <> 3").groupBy("txn_id").agg((F.max("event_id") + 50).alias("commit_seq"))
    return txn.committed_at(e, commits, 6000).select("event_id", "txn_id", "seq")


_WAITS = "e AS (SELECT DISTINCT user_id AS a, (user_id * 3 + event_id % 7) % (SELECT max(user_id) + 1 FROM events) AS b FROM events WHERE event_type = 'error' AND value > 100 AND user_id <> (user_id * 3 + event_id % 7) % (SELECT max(user_id) + 1 FROM events))"


@query(
    f"""WITH RECURSIVE {_WAITS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), cyc AS (SELECT a FROM r WHERE a = b),
down AS (SELECT DISTINCT r.a AS x FROM r JOIN cyc ON r.b = cyc.a), up AS (SELECT DISTINCT r.b AS x FROM r JOIN cyc ON r.a = cyc.a)
SELECT DISTINCT a AS node FROM e WHERE a IN (SELECT x FROM down) AND a IN (SELECT x FROM up)"""
)
def deadlock_cycles(spark, sf):
    """Users that wait for others, by what their errors say: those on a cycle, or between two."""
    e = L.table(spark, sf, "events")
    users = e.agg(F.max("user_id") + 1).first()[0]
    holder = (F.col("user_id") * 3 + F.col("event_id") % 7) % users
    return txn.deadlocked(e.where("event_type = 'error' AND value > 100").select(F.col("user_id").alias("waiter"), holder.alias("holder")))


@query(f"WITH {EV}, f AS (SELECT key, seq, CASE WHEN seq % 13 = 0 THEN 'IGNORE' WHEN value % 97 = 0 AND seq > 4000 THEN 'STOP' ELSE 'CONTINUE' END AS d, value FROM ev) SELECT key, seq, value FROM f WHERE d = 'CONTINUE' AND seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM f WHERE d = 'STOP')")
def wal_filter(spark, sf):
    from ..sources.changes import replay

    log = L.op_events(spark, sf)
    decision = F.when(F.col("seq") % 13 == 0, "IGNORE").when((F.col("value") % 97 == 0) & (F.col("seq") > 4000), "STOP").otherwise("CONTINUE")
    return replay(log, decision).select("key", "seq", "value")


_CORRUPT = "(seq % 1777 = 1776)"


@query(f"WITH {EV}, c AS (SELECT min(seq) AS m FROM ev WHERE {_CORRUPT}) SELECT 'point_in_time' AS mode, count(*) AS n FROM ev, c WHERE seq < coalesce(m, 9223372036854775807) UNION ALL SELECT 'skip_corrupt', count(*) FROM ev WHERE NOT {_CORRUPT}")
def recovery_prefix(spark, sf):
    from ..sources.changes import recover

    log, bad = L.op_events(spark, sf), F.expr(_CORRUPT)
    count = lambda mode: recover(log, bad, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count("point_in_time").union(count("skip_corrupt"))


@query(f"WITH {EV}, b AS (SELECT *, seq // 100 AS batch_id FROM ev), l AS (SELECT batch_id, max(seq) AS last_seq FROM b GROUP BY 1) SELECT b.batch_id, b.seq, b.key, b.op FROM b JOIN l USING (batch_id) WHERE l.last_seq >= 9550")
def cdc_since(spark, sf):
    from ..sources.changes import updates_since

    return updates_since(L.op_events(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 100)), 9550).select("batch_id", "seq", "key", "op")


_PAIRS = f"""WITH {ORD}, pairs AS (SELECT seq, max(ts) AS time FROM o WHERE seq % 100 = 0 GROUP BY seq), m AS (SELECT max(seq) AS seq, time FROM (SELECT seq, max(time) OVER (ORDER BY seq) AS time FROM pairs) GROUP BY time)"""


@query(_PAIRS + " SELECT p.probe, m.time AS answer FROM (SELECT DISTINCT event_id AS probe FROM events) p ASOF LEFT JOIN m ON p.probe > m.seq")
def seq_to_time(spark, sf):
    return stats.sequence_times(L.table(spark, sf, "events").select(F.col("event_id").alias("probe")).distinct(), _pairs(spark, sf), True)


@query(_PAIRS + " SELECT p.probe, m.seq AS answer FROM (SELECT DISTINCT ts + 3600000000 AS probe FROM o) p ASOF LEFT JOIN m ON p.probe >= m.time")
def time_to_seq(spark, sf):
    probes = L.op_orders(spark, sf).select((F.col("ts") + 3_600_000_000).alias("probe")).distinct()
    return stats.sequence_times(probes, _pairs(spark, sf), False)


def _pairs(spark, sf):
    """A mapping of sequence numbers to times that ascends in both: of each hundredth order, the latest time so far."""
    pairs = L.op_orders(spark, sf).where("seq % 100 = 0").groupBy("seq").agg(F.max("ts").alias("time"))
    return stats.rising(pairs)


@query(f"WITH {ORD} SELECT max(seq) AS latest_seq, count(*) AS n FROM o")
def latest_sequence_number(spark, sf):
    return L.op_orders(spark, sf).agg(F.max("seq").alias("latest_seq"), F.count("*").alias("n"))


@query(f"WITH {ORD}, {EV}, {resolved()}, t AS (SELECT key, max(seq) AS seq FROM o GROUP BY key) SELECT p.key, res.value, t.seq AS tracked_seq FROM (SELECT CAST(n_nationkey * 7 AS BIGINT) AS key FROM nation) p LEFT JOIN res ON res.key = p.key LEFT JOIN t ON t.key = p.key")
def get_for_update(spark, sf):
    """Values with the sequence number that a commit must find unchanged."""
    from ..operators.scan import multi_get

    keys = L.probe_keys(spark, sf)
    tracked = of_keys(L.op_orders(spark, sf), keys).groupBy("key").agg(F.max("seq").alias("tracked_seq"))
    read = multi_get(resolve(of_keys(L.op_events(spark, sf), keys)).select("key", "value"), keys).drop("status")
    return read.join(tracked, "key", "left").select("key", "value", "tracked_seq")


@query(f"WITH {EV}, {resolved()}, t AS (SELECT key, max(ts) // 1000000 AS write_time FROM res_live WHERE op <> 'DELETE' GROUP BY key) SELECT key, value, write_time FROM res JOIN t USING (key) WHERE n_operands > 0")
def merge_ttl(spark, sf):
    """Merges of values that carry their write times: the times are taken off, the values merged, and the result is stamped with the newest time."""
    from ..functions.merges import add, with_times

    stamped = L.op_events(spark, sf).withColumn("value", F.struct(F.col("value"), F.expr("ts div 1000000").alias("write_time")))
    state = resolve(stamped, fold=with_times(add)).where("n_operands > 0")
    return state.select("key", F.col("value.value").cast("bigint").alias("value"), F.col("value.write_time").alias("write_time"))


@query(f"WITH {EV} SELECT key, seq, op, max(ts) OVER (PARTITION BY seq // 100) AS ts FROM ev")
def batch_timestamps(spark, sf):
    """Batches whose records all get one time: that of their last one's commit."""
    return txn.stamped(L.op_events(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 100))).select("key", "seq", "op", "ts")


_TXN = "w AS (SELECT event_id, user_id AS key, event_id // 50 AS txn_id FROM events), e AS (SELECT DISTINCT txn_id, CASE txn_id % 5 WHEN 0 THEN 'ROLLED_BACK' WHEN 1 THEN 'PREPARED' ELSE 'COMMITTED' END AS state FROM w WHERE txn_id % 5 <> 2)"


@query(
    f"WITH {_TXN}, s AS (SELECT w.*, coalesce(e.state, 'OPEN') AS state FROM w LEFT JOIN e USING (txn_id)) SELECT policy, event_id, state, state = 'COMMITTED' OR (policy <> 'committed' AND state <> 'OPEN') OR policy = 'unprepared' AS written, state = 'COMMITTED' AS visible "
    "FROM s, (VALUES ('committed'), ('prepared'), ('unprepared')) p(policy)"
)
def transaction_states(spark, sf):
    """Every fifty events are a transaction: committed, rolled back, prepared or open, and what each write policy has in the log."""
    w = L.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 50).alias("txn_id"))
    k = F.col("txn_id") % 5
    ends = w.select("txn_id").distinct().where(k != 2).withColumn("state", F.when(k == 0, "ROLLED_BACK").when(k == 1, "PREPARED").otherwise("COMMITTED"))
    out = None
    for policy in txn.POLICIES:
        one = txn.written_and_visible(w, ends, policy).select(F.lit(policy).alias("policy"), "event_id", "state", "written", "visible")
        out = one if out is None else out.unionByName(one)
    return out


_OPS = "o AS (SELECT event_id // 500 AS txn, user_id % 20 AS key, event_id AS n, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'UNDO' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'WRITE' ELSE 'UNTRACKED' END ELSE 'UNTRACKED' END AS kind FROM events)"


@query(
    f"""WITH RECURSIVE {_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY txn, key ORDER BY n) AS i FROM o),
f AS (SELECT txn, key, i, CASE WHEN kind = 'READ' THEN 1 ELSE 0 END AS held, kind = 'WRITE' AS x FROM r WHERE i = 1
      UNION ALL SELECT r.txn, r.key, r.i, greatest(0, f.held + CASE r.kind WHEN 'READ' THEN 1 WHEN 'UNDO' THEN -1 ELSE 0 END), f.x OR r.kind = 'WRITE' FROM f JOIN r ON r.txn = f.txn AND r.key = f.key AND r.i = f.i + 1),
l AS (SELECT *, max(i) OVER (PARTITION BY txn, key) AS last FROM f)
SELECT txn, key, x AS exclusive FROM l WHERE i = last AND (held > 0 OR x)"""
)
def undo_get_for_update(spark, sf):
    """Keys that transactions still track after reads for update, undos of them, and tracked and untracked writes."""
    kind = F.col("event_type")
    write = F.when(F.col("event_id") % 9 == 0, "WRITE").otherwise("UNTRACKED")
    ops = L.table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("txn"), (F.col("user_id") % 20).alias("key"), F.col("event_id").alias("n"), F.when(kind == "view", "READ").when(kind == "click", "UNDO").when(kind == "signup", write).otherwise("UNTRACKED").alias("kind"))
    return txn.tracked(ops)


@query(
    "WITH t AS (SELECT DISTINCT event_id // 50 AS txn, user_id AS key FROM events), x AS (SELECT txn, key, txn * 50 - 25 AS read_ts, txn * 50 - 25 + (txn % 11) AS commit_ts FROM t), c AS (SELECT user_id AS key, max(event_id) AS ts FROM events WHERE event_type = 'signup' AND event_id % 40 = 0 GROUP BY 1) "
    "SELECT txn, CASE WHEN bool_or(commit_ts <= read_ts) THEN 'InvalidArgument' WHEN bool_or(coalesce(c.ts > read_ts, FALSE)) THEN 'Busy' ELSE 'OK' END AS status FROM x LEFT JOIN c USING (key) GROUP BY txn"
)
def commit_timestamps(spark, sf):
    """Transactions with read and commit times of their own."""
    e = L.table(spark, sf, "events")
    t = e.select(F.floor(F.col("event_id") / 50).alias("txn"), F.col("user_id").alias("key")).distinct().withColumn("read_ts", F.col("txn") * 50 - 25).withColumn("commit_ts", F.col("read_ts") + F.col("txn") % 11)
    return txn.commit_times(t, e.where("event_type = 'signup' AND event_id % 40 = 0").select(F.col("user_id").alias("key"), F.col("event_id").alias("ts")))


@query(f"WITH {EV}, c AS (SELECT min(seq) AS m FROM ev WHERE {_CORRUPT}) SELECT mode, count(seq) AS n FROM (VALUES ('absolute'), ('tolerate_tail'), ('point_in_time'), ('skip_corrupt')) v(mode) LEFT JOIN (SELECT ev.seq, m FROM ev, c) x ON CASE mode WHEN 'absolute' THEN m IS NULL WHEN 'tolerate_tail' THEN m IS NULL WHEN 'skip_corrupt' THEN NOT {_CORRUPT} WHEN 'point_in_time' THEN seq < coalesce(m, 9223372036854775807) ELSE FALSE END GROUP BY mode")
def recovery_modes(spark, sf):
    """What each mode reads of a log with corrupt records in its middle; two of them refuse it."""
    from ..sources.changes import recover

    log, bad, out = L.op_events(spark, sf), F.expr(_CORRUPT), []
    for mode in ("absolute", "tolerate_tail", "point_in_time", "skip_corrupt"):
        try:
            out.append((mode, recover(log, bad, mode).count()))
        except ValueError:
            out.append((mode, 0))
    return spark.createDataFrame(out, "mode string, n bigint")
