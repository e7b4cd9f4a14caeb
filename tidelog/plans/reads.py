"""Point reads, scans and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..functions import prefixes
from ..operators import scan
from ..operators.resolve import latest, live_records, of_keys, operands, resolve, uncovered
from .registry import DKV, EV, ORD, PROBE, query, resolved

SNAPSHOT, READ_TS = 5000, 852076800000000  # the latter is 1997-01-01


@query(f"WITH {ORD} SELECT key, max_by(value, seq) AS value, CAST(max(seq) AS BIGINT) AS seq FROM o GROUP BY key")
def get_latest(spark, sf):
    return latest(L.op_orders(spark, sf)).select("key", "value", "seq")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ev WHERE op IN ('PUT', 'DELETE')) SELECT key, value, seq FROM r WHERE n = 1 AND op = 'PUT'")
def get_with_deletes(spark, sf):
    return latest(L.op_events(spark, sf).where(F.col("op").isin(L.PUT, L.DELETE))).select("key", "value", "seq")


@query(f"WITH {EV}, {resolved()} SELECT key, value, seq, n_operands FROM res")
def get_resolved_full(spark, sf):
    return resolve(L.op_events(spark, sf)).select("key", "value", "seq", "n_operands")


@query(f"WITH {EV}, {resolved()} SELECT key, value, seq FROM res WHERE key = 42")
def get_point(spark, sf):
    return resolve(L.op_events(spark, sf)).where("key = 42").select("key", "value", "seq")


@query(f"WITH {ORD}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM o WHERE ts <= {READ_TS}) SELECT key, value, ts FROM r WHERE n = 1")
def get_with_timestamp(spark, sf):
    return latest(L.op_orders(spark, sf), read_ts=READ_TS).select("key", "value", "ts")


@query(f"WITH {EV}, {PROBE}, {resolved()} SELECT probe.key, res.value, CASE WHEN res.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM probe LEFT JOIN res ON probe.key = res.key")
def multiget_status(spark, sf):
    keys = L.probe_keys(spark, sf)
    return scan.multi_get(resolve(of_keys(L.op_events(spark, sf), keys)).select("key", "value"), keys)


@query(
    f"WITH {EV}, {ORD}, {PROBE}, {resolved()}, st AS (SELECT 'events' AS cf, key, value FROM res UNION ALL SELECT 'orders', key, max_by(value, seq) FROM o GROUP BY key), "
    "want AS (SELECT c.cf, key FROM probe CROSS JOIN (VALUES ('events'), ('orders')) c(cf)) SELECT want.cf, want.key, st.value, CASE WHEN st.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM want LEFT JOIN st ON st.cf = want.cf AND st.key = want.key"
)
def multiget_multi_cf(spark, sf):
    keys = L.probe_keys(spark, sf)
    state = resolve(of_keys(L.op_events(spark, sf), keys)).select("cf", "key", "value").union(latest(of_keys(L.op_orders(spark, sf), keys)).select("cf", "key", "value"))
    keys = keys.select(F.explode(F.lit(["events", "orders"])).alias("cf"), "key")
    return scan.multi_get(state, keys, ["cf", "key"])


@query(f"WITH {EV}, {PROBE}, {resolved()} SELECT key FROM probe WHERE key IN (SELECT key FROM res)")
def key_may_exist(spark, sf):
    keys = L.probe_keys(spark, sf)
    return scan.may_exist(resolve(of_keys(L.op_events(spark, sf), keys)), keys)


@query(f"WITH {EV}, s AS (SELECT * FROM ev WHERE seq <= {SNAPSHOT}), {resolved('s')} SELECT key, value, seq FROM res")
def snapshot_read(spark, sf):
    return resolve(L.op_events(spark, sf), snapshot=SNAPSHOT).select("key", "value", "seq")


@query(f"WITH {ORD} SELECT key, max_by(value, seq) AS value, CAST(max(seq) AS BIGINT) AS seq FROM o WHERE ts <= {READ_TS} GROUP BY key")
def timestamp_asof_read(spark, sf):
    return latest(L.op_orders(spark, sf), read_ts=READ_TS).select("key", "value", "seq")


@query(
    f"WITH {ORD}, v AS (SELECT key, ts, max(value) AS value FROM o GROUP BY key, ts), e AS (SELECT event_id, user_id AS key, epoch_us(ts) - 900000000000000 AS at FROM events) "
    "SELECT e.event_id, e.key, v.value FROM e ASOF LEFT JOIN v ON e.key = v.key AND e.at >= v.ts"
)
def asof_probe(spark, sf):
    versions = L.op_orders(spark, sf).groupBy("key", "ts").agg(F.max("value").alias("value"))
    events = L.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), (L.micros("ts") - 900000000000000).alias("at"))
    return scan.as_of(events, versions, "key", "at", "ts", "value").select("event_id", "key", "value")


@query(f"WITH {ORD} SELECT key, seq, value, ts FROM o WHERE ts BETWEEN {READ_TS} AND {READ_TS} + 31536000000000")
def history_scan(spark, sf):
    return scan.history(L.op_orders(spark, sf), READ_TS, READ_TS + 31_536_000_000_000).select("key", "seq", "value", "ts")


@query(f"WITH {ORD} SELECT key, max_by(value, seq) AS value FROM o WHERE key >= 100 AND key < 300 GROUP BY key")
def scan_range_bounds(spark, sf):
    return scan.scan(latest(L.op_orders(spark, sf)), 100, 300).select("key", "value")


@query(f"WITH {ORD} SELECT key, max_by(value, seq) AS value FROM o GROUP BY key ORDER BY key DESC LIMIT 25")
def scan_reverse_limit(spark, sf):
    return scan.scan(latest(L.op_orders(spark, sf)), reverse=True, limit=25).select("key", "value")


@query(f"WITH {EV}, {PROBE}, {resolved()} SELECT probe.key AS probe, (SELECT min(key) FROM res WHERE res.key >= probe.key) AS key FROM probe")
def seek_ge(spark, sf):
    return scan.seek(resolve(L.op_events(spark, sf)).select("key"), L.probe_keys(spark, sf).withColumnRenamed("key", "probe"))


@query(f"WITH {EV}, {PROBE}, {resolved()} SELECT probe.key AS probe, (SELECT max(key) FROM res WHERE res.key <= probe.key) AS key FROM probe")
def seek_for_prev(spark, sf):
    return scan.seek(resolve(L.op_events(spark, sf)).select("key"), L.probe_keys(spark, sf).withColumnRenamed("key", "probe"), forward=False)


@query(f"WITH {DKV} SELECT key, CAST(length(value) AS BIGINT) AS size FROM kv WHERE starts_with(key, 'src1:')")
def prefix_scan(spark, sf):
    return scan.prefix_scan(L.docs_kv(spark, sf), "src1:").select("key", F.length("value").cast("bigint").alias("size"))


@query(f"WITH {DKV} SELECT split_part(key, ':', 1) AS prefix, count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM kv GROUP BY 1")
def prefix_count(spark, sf):
    return L.docs_kv(spark, sf).groupBy(F.substring_index("key", ":", 1).alias("prefix")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query(f"WITH {DKV} SELECT key, CASE WHEN length(key) >= 7 THEN substr(key, 1, 7) END AS fixed7, substr(key, 1, 7) AS capped7 FROM kv")
def prefix_capped_fixed(spark, sf):
    return L.docs_kv(spark, sf).select("key", prefixes.from_string("fixed:7")(F.col("key")).alias("fixed7"), prefixes.from_string("capped:7")(F.col("key")).alias("capped7"))


@query(
    f"WITH {DKV}, s AS (SELECT split_part(key, ':', 1) AS g, key, CAST(strlen(value) AS BIGINT) AS size FROM kv), r AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY g ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS read_before FROM s) "
    "SELECT g, key, size, read_before FROM r WHERE read_before < 20000"
)
def scan_value_size_limit(spark, sf):
    rows = L.docs_kv(spark, sf).select(F.substring_index("key", ":", 1).alias("g"), "key", F.octet_length("value").cast("bigint").alias("size"))
    return scan.size_limited(rows, 20_000, group="g")


@query(f"WITH {ORD} SELECT key, seq, value FROM o WHERE key BETWEEN 10 AND 20 ORDER BY key, seq DESC LIMIT 40")
def key_versions(spark, sf):
    return scan.key_versions(L.op_orders(spark, sf), 10, 20, 40).select("key", "seq", "value")


@query(f"WITH {EV}, {resolved(ranges=False)} SELECT key, value, seq FROM res")
def ignore_range_deletions(spark, sf):
    return resolve(L.op_events(spark, sf), ranges=False).select("key", "value", "seq")


@query(f"WITH {EV}, {resolved()} SELECT key, n_operands, n_operands > 10 AS over_threshold FROM res")
def merge_count_threshold(spark, sf):
    return resolve(L.op_events(spark, sf)).select("key", "n_operands", (F.col("n_operands") > 10).alias("over_threshold"))


@query(f"WITH {EV} SELECT p.key, p.seq, p.op, p.value FROM ev p WHERE p.op <> 'RANGE_DELETE' AND NOT EXISTS (SELECT 1 FROM ev t WHERE t.op = 'RANGE_DELETE' AND t.seq > p.seq AND p.key >= t.key AND p.key < t.end_key)")
def delete_range_anti(spark, sf):
    return uncovered(L.op_events(spark, sf)).select("key", "seq", "op", "value")


_LIVE = f"WITH {EV}, {resolved()}, l AS (SELECT * FROM res_live WHERE op <> 'DELETE')"


@query(_LIVE + " SELECT key, count(*) AS n, CASE WHEN count(*) <= 20 THEN string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq) END AS operands, CASE WHEN count(*) > 20 THEN 'Incomplete' ELSE 'OK' END AS status FROM l GROUP BY key")
def merge_operands(spark, sf):
    return operands(L.op_events(spark, sf), expected=20).select("key", "n", F.array_join(F.col("operands").cast("array<string>"), ",").alias("operands"), "status")


@query(_LIVE + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM res_live WHERE op = 'MERGE') SELECT key, CAST(sum(value) AS BIGINT) AS value FROM r WHERE n <= 3 GROUP BY key")
def should_merge_last_n(spark, sf):
    from ..functions.merges import last_n

    return resolve(L.op_events(spark, sf), fold=last_n(3)).where("n_operands > 0").select("key", "value")


@query(f"WITH {EV} SELECT key, seq, op, value FROM ev")
def raw_version_scan(spark, sf):
    return L.op_events(spark, sf).select("key", "seq", "op", "value").orderBy("key", F.col("seq").desc())


@query(f"WITH {EV}, {resolved()}, a AS (SELECT key, count(*) AS n FROM ev WHERE op <> 'RANGE_DELETE' GROUP BY key), b AS (SELECT key, count(*) AS n FROM res_live GROUP BY key) SELECT a.key, a.n - coalesce(b.n, 0) AS hidden FROM a LEFT JOIN b USING (key)")
def hidden_versions(spark, sf):
    log = L.op_events(spark, sf)
    all_rows = log.where(F.col("op") != L.RANGE_DELETE).groupBy("key").agg(F.count("*").alias("a"))
    live = live_records(log).groupBy("key").agg(F.count("*").alias("b"))
    return all_rows.join(live, "key", "left").select("key", (F.col("a") - F.coalesce("b", F.lit(0))).alias("hidden"))
