"""Statistics, and access- and cache-trace analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..operators import cache, stats, trace
from .registry import DKV, EV, TR, query, resolved

_RANGES = "r AS (SELECT CAST(n_nationkey AS BIGINT) AS range_id, 'src' || CAST(n_nationkey AS VARCHAR) AS b, 'src' || CAST(n_nationkey AS VARCHAR) || ':5' AS e FROM nation)"


@query(f"WITH {DKV}, {_RANGES} SELECT r.range_id, count(kv.key) AS n, CAST(coalesce(sum(length(kv.key) + strlen(kv.value)), 0) AS BIGINT) AS bytes FROM r LEFT JOIN kv ON kv.key >= r.b AND kv.key < r.e GROUP BY 1")
def approx_sizes(spark, sf):
    name = F.concat(F.lit("src"), F.col("n_nationkey").cast("string"))
    ranges = L.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("range_id"), name.alias("begin_key"), F.concat(name, F.lit(":5")).alias("end_key"))
    rows = L.docs_kv(spark, sf).select("key", (F.length("key") + F.octet_length("value")).cast("bigint").alias("size"))
    return stats.range_sizes(rows, ranges)


@query(f"WITH {DKV}, t AS (SELECT key, ntile(16) OVER (ORDER BY key) AS anchor FROM kv) SELECT CAST(anchor AS INT) AS anchor, min(key) AS first_key, count(*) AS n FROM t GROUP BY 1")
def key_anchors(spark, sf):
    return stats.key_anchors(L.docs_kv(spark, sf), 16)


@query(f"WITH {EV} SELECT count(*) AS num_entries, count(*) FILTER (op = 'DELETE') AS num_deletes, count(*) FILTER (op = 'RANGE_DELETE') AS num_range_deletes, count(*) FILTER (op = 'MERGE') AS num_merges, count(*) FILTER (op = 'PUT') AS num_puts, count(DISTINCT key) AS num_keys, min(key) AS smallest_key, max(key) AS largest_key, max(seq) AS latest_seq FROM ev")
def props_counts(spark, sf):
    return stats.properties(L.op_events(spark, sf))


@query("SELECT source AS file, count(*) AS num_entries, CAST(sum(strlen(text)) AS BIGINT) AS raw_value_size, min(doc_id) AS smallest_key, max(doc_id) AS largest_key FROM documents GROUP BY 1")
def live_bytes(spark, sf):
    """Table properties, with sources as files."""
    return L.table(spark, sf, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("num_entries"), F.sum(F.octet_length("text")).alias("raw_value_size"), F.min("doc_id").alias("smallest_key"), F.max("doc_id").alias("largest_key"))


_LIMITS = "[10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]"


@query(
    f"""WITH {EV}, l AS (SELECT {_LIMITS} AS lim), b AS (SELECT len(list_filter(lim, lambda x: x < value)) AS b, count(*) AS c FROM ev, l WHERE value IS NOT NULL GROUP BY 1),
s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM ev), r AS (SELECT b, c, coalesce(sum(c) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT CAST(p.p AS INT) AS percent, round(greatest(least(CASE WHEN b = 0 THEN 0 ELSE lim[greatest(b, 1)] END + (lim[least(b + 1, 13)] - CASE WHEN b = 0 THEN 0 ELSE lim[greatest(b, 1)] END) * (n * p.p / 100.0 - before) / c, hi), lo), 6) AS value
FROM (VALUES (50), (95), (99)) p(p), s, l JOIN r ON TRUE WHERE before < n * p.p / 100.0 AND before + c >= n * p.p / 100.0"""
)
def histogram_percentile(spark, sf):
    rows = L.op_events(spark, sf)
    return stats.histogram(rows, "value", [50, 95, 99], [10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]).select("percent", F.round("value", 6).alias("value"))


@query("WITH d AS (SELECT event_type AS name, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS c FROM events GROUP BY 1, 2), k AS (SELECT name, day, CAST(sum(c) OVER (PARTITION BY name ORDER BY day) AS BIGINT) AS total FROM d) SELECT name, day, total, total - coalesce(lag(total) OVER (PARTITION BY name ORDER BY day), 0) AS delta FROM k")
def stats_history_delta(spark, sf):
    from pyspark.sql import Window

    d = L.table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), F.floor(L.micros("ts") / 86_400_000_000).alias("day")).agg(F.count("*").alias("c"))
    totals = d.select("name", "day", F.sum("c").over(Window.partitionBy("name").orderBy("day")).alias("total"))
    return stats.history_deltas(totals, "day", "total", ["name"])


@query(f"WITH {TR} SELECT type, key, count(*) AS accesses, count(*) FILTER (type <> 'GET' OR value_size > 0) AS successes, CAST(sum(value_size) AS BIGINT) AS total_size, max(value_size) AS largest FROM tr GROUP BY 1, 2")
def trace_key_stats(spark, sf):
    return trace.key_stats(L.trace(spark, sf))


@query(f"WITH {TR} SELECT type, value_size // 8 AS bucket, count(*) AS n FROM tr GROUP BY 1, 2")
def trace_size_dist(spark, sf):
    return trace.size_distribution(L.trace(spark, sf), 8)


@query(f"WITH {TR}, k AS (SELECT type, key, count(*) AS accesses FROM tr GROUP BY 1, 2) SELECT type, accesses, count(*) AS keys FROM k GROUP BY 1, 2")
def trace_access_dist(spark, sf):
    return trace.access_distribution(L.trace(spark, sf))


_RATES = f"""WITH {TR}, s AS (SELECT *, access_time // 3600000000 AS slot FROM tr), g AS (SELECT unnest(generate_series((SELECT min(slot) FROM s), (SELECT max(slot) FROM s))) AS slot),
c AS (SELECT slot, count(*) AS n FROM s GROUP BY 1), f AS (SELECT slot, count(*) AS k FROM (SELECT key, min(slot) AS slot FROM s GROUP BY 1) GROUP BY 1)"""


@query(_RATES + " SELECT g.slot, coalesce(c.n, 0) AS n, CAST(sum(coalesce(f.k, 0)) OVER (ORDER BY g.slot) AS BIGINT) AS cumulative_keys FROM g LEFT JOIN c USING (slot) LEFT JOIN f USING (slot)")
def trace_qps(spark, sf):
    return trace.rates(L.trace(spark, sf), 3_600_000_000)


@query(_RATES + " SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS peak, (SELECT count(*) FROM g) AS slots, (SELECT min(slot) FROM c WHERE n = (SELECT max(n) FROM c)) AS peak_slot FROM c")
def trace_qps_summary(spark, sf):
    return trace.rate_summary(trace.rates(L.trace(spark, sf), 3_600_000_000))


@query(f"WITH {TR} SELECT key // 10 AS prefix, count(*) AS accesses FROM tr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def trace_topk_prefix(spark, sf):
    return trace.hottest(L.trace(spark, sf).withColumn("prefix", F.floor(F.col("key") / 10)), 10, "prefix")


@query(
    f"""WITH {TR}, k AS (SELECT unnest(['GET', 'SEEK', 'PUT', 'DELETE', 'MERGE']) AS first_type),
x AS (SELECT k.first_type, tr.type AS second_type, tr.access_time, max(CASE WHEN tr.type = k.first_type THEN tr.access_time END) OVER (PARTITION BY k.first_type, tr.key ORDER BY tr.access_time, tr.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM tr CROSS JOIN k)
SELECT first_type, second_type, count(*) AS n, CAST(sum(access_time - t) AS BIGINT) AS total_gap FROM x WHERE t IS NOT NULL GROUP BY 1, 2"""
)
def trace_correlation(spark, sf):
    return trace.correlation(L.trace(spark, sf))


@query(f"WITH {TR}, a AS (SELECT key, count(*) AS n FROM tr GROUP BY 1) SELECT c_custkey AS key, coalesce(a.n, 0) AS accesses FROM customer LEFT JOIN a ON a.key = c_custkey")
def trace_keyspace(spark, sf):
    return trace.coverage(L.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), L.trace(spark, sf))


@query("SELECT user_id % 16 AS cf, event_type AS caller, count(*) AS n, count(*) FILTER (value <= 100) AS misses, CAST(grouping(user_id % 16, event_type) AS BIGINT) AS gid FROM events GROUP BY GROUPING SETS ((), (user_id % 16), (event_type), (user_id % 16, event_type))")
def cache_miss_ratio(spark, sf):
    e = L.table(spark, sf, "events").select((F.col("user_id") % 16).alias("cf"), F.col("event_type").alias("caller"), (F.col("value") > 100).alias("hit"))
    return cache.miss_ratios(e, ["cf", "caller"]).withColumn("gid", F.col("gid").cast("bigint"))


@query(f"WITH {TR} SELECT CAST(access_time // 86400000000 AS BIGINT) AS day, type, count(*) AS n, count(*) FILTER (value_size = 0) AS misses FROM tr GROUP BY 1, 2")
def cache_miss_timeline(spark, sf):
    t = L.trace(spark, sf)
    return t.groupBy(F.floor(F.col("access_time") / 86_400_000_000).alias("day"), "type").agg(F.count("*").alias("n"), F.count_if(F.col("value_size") == 0).alias("misses"))


@query(f"WITH {TR}, l AS (SELECT key, seq, access_time - lag(access_time) OVER (PARTITION BY key ORDER BY access_time, seq) AS interval FROM tr) SELECT * FROM l WHERE interval IS NOT NULL")
def reuse_interval(spark, sf):
    return cache.reuse_intervals(L.trace(spark, sf))


@query(f"WITH {TR} SELECT key, max(access_time) - min(access_time) AS lifetime, count(*) AS accesses FROM tr GROUP BY 1")
def reuse_lifetime(spark, sf):
    return cache.lifetimes(L.trace(spark, sf))


_REUSE = f"""WITH {TR}, w AS (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nxt FROM tr),
c AS (SELECT w.seq, count(*) AS n FROM w JOIN w o ON o.seq > w.prev AND o.seq < w.seq AND coalesce(o.nxt, 9223372036854775807) > w.seq GROUP BY w.seq),
d AS (SELECT w.key, w.seq, CASE WHEN w.prev IS NOT NULL THEN coalesce(c.n, 0) END AS distance FROM w LEFT JOIN c ON c.seq = w.seq)"""


@query(_REUSE + " SELECT key, seq, distance FROM d")
def reuse_distance(spark, sf):
    return cache.reuse_distances(L.trace(spark, sf))


@query(_REUSE + " SELECT CAST(c.c AS INT) AS capacity, count(*) AS n, count(*) FILTER (distance < c.c) AS hits FROM d, (VALUES (10), (50), (100), (140)) c(c) GROUP BY 1")
def lru_sim(spark, sf):
    return cache.lru_curve(cache.reuse_distances(L.trace(spark, sf)), [10, 50, 100, 140])


@query()
def cache_policies(spark, sf):
    """Simulators of policies at three capacities, of entries and of bytes; SQL has no such loops, and tests hold them to direct ones."""
    from ..operators import simulate

    t = L.trace(spark, sf).withColumn("size", F.col("key") % 13 * 8 + 16)
    return cache.simulate_all(t, [(p, c) for p in sorted(cache.POLICIES) for c in (10, 50, 100)] + [(p, c) for p in sorted(simulate.SIZED) for c in (1000, 4000, 8000)])


@query("WITH b AS (SELECT event_type AS op, CAST(floor(value) AS BIGINT) AS latency FROM events) SELECT op, count(*) AS n, min(latency) AS fastest, max(latency) AS slowest, CAST(sum(latency) AS BIGINT) AS total FROM b GROUP BY 1")
def io_trace_summary(spark, sf):
    b = L.table(spark, sf, "events").select(F.col("event_type").alias("op"), F.floor("value").alias("latency"))
    return b.groupBy("op").agg(F.count("*").alias("n"), F.min("latency").alias("fastest"), F.max("latency").alias("slowest"), F.sum("latency").alias("total"))


@query(
    f"""WITH {TR}, k AS (SELECT key, count(*) AS n FROM tr GROUP BY 1), r AS (SELECT key, n, ntile(10) OVER (ORDER BY n DESC, key) AS decile FROM k)
SELECT CAST(decile AS INT) AS decile, count(*) AS keys, CAST(sum(n) AS BIGINT) AS accesses FROM r GROUP BY 1"""
)
def cache_skewness(spark, sf):
    """How accesses spread over tenths of the keys, the most accessed first. Keys' counts are ranked, not accesses."""
    k = L.trace(spark, sf).groupBy("key").agg(F.count("*").alias("n"))
    return trace.skewness(k, 10)


@query(f"WITH {TR}, g AS (SELECT key // 10 AS block, key, count(*) AS n FROM tr WHERE type = 'GET' GROUP BY 1, 2) SELECT block, count(*) AS distinct_keys, CAST(sum(n) AS BIGINT) AS gets, CAST(round(count(*) / 10.0, 6) AS DOUBLE) AS share_of_block FROM g GROUP BY 1")
def get_spatial_locality(spark, sf):
    """Of each block of ten keys, how many are read."""
    return trace.locality(L.trace(spark, sf).where("type = 'GET'"), 10)


@query(f"WITH {TR} SELECT CAST(access_time // 86400000000 AS BIGINT) AS slot, key // 50 AS label, count(*) AS n FROM tr GROUP BY 1, 2")
def cache_access_timeline(spark, sf):
    t = L.trace(spark, sf)
    return t.groupBy(F.floor(F.col("access_time") / 86_400_000_000).alias("slot"), F.floor(F.col("key") / 50).alias("label")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TR}, l AS (SELECT access_time // 86400000000 AS day, lag(access_time // 86400000000) OVER (PARTITION BY key ORDER BY access_time, seq) AS before FROM tr)
SELECT CAST(before AS BIGINT) AS from_day, CAST(day AS BIGINT) AS to_day, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY 1, 2"""
)
def block_reuse_timeline(spark, sf):
    """Reuses by the day of an access and of the one before it."""
    return trace.reuse_timeline(L.trace(spark, sf), 86_400_000_000)


@query(
    f"""WITH {TR}, i AS (SELECT key, access_time, seq, access_time - lag(access_time) OVER w AS past, lead(access_time) OVER w - access_time AS next FROM tr WINDOW w AS (PARTITION BY key ORDER BY access_time, seq)),
r AS (SELECT past, next, row_number() OVER (PARTITION BY key ORDER BY access_time, seq) AS past_accesses FROM i WHERE past IS NOT NULL AND next IS NOT NULL)
SELECT count(*) AS n, round(corr(past, next), 6) AS past_interval, round(corr(past_accesses, next), 6) AS past_accesses FROM r"""
)
def cache_correlation_features(spark, sf):
    """How the past interval and the number of past accesses go with the interval that follows."""
    return trace.correlation_features(L.trace(spark, sf))


@query(f"WITH {TR} SELECT type, key, seq FROM tr WHERE seq % 10 = 0 AND type <> 'DELETE'")
def trace_sampled(spark, sf):
    """A trace taken with a sampling frequency of ten and a filter on kinds: sampling is what is asked for here."""
    return trace.sampled(L.trace(spark, sf), 10, ["DELETE"]).select("type", "key", "seq")


@query(f"WITH {TR}, w AS (SELECT key, seq, type AS op, value_size AS value FROM tr WHERE type IN ('PUT', 'DELETE', 'MERGE')), {resolved('w', ranges=False)} SELECT key, seq, value, n_operands FROM res")
def trace_replay(spark, sf):
    """The state after a trace's writes are done again."""
    from ..operators.resolve import resolve

    return resolve(trace.as_log(L.trace(spark, sf)), ranges=False).select("key", "seq", "value", "n_operands")


@query(f"WITH {EV} SELECT CAST(floor(ts / 86400000000.0) AS BIGINT) AS slot, count(value) AS n, min(value) AS least, max(value) AS most, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * value) AS BIGINT) AS squares FROM ev GROUP BY 1")
def histogram_windows(spark, sf):
    """Statistics of each window, from sums that windows can be merged by."""
    return stats.windowed(L.op_events(spark, sf), "ts", "value", 86_400_000_000)


@query(f"WITH {EV} SELECT round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most, count(value) AS n FROM ev")
def histogram_moments(spark, sf):
    return L.op_events(spark, sf).agg(F.round(F.avg("value"), 6).alias("average"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


@query(
    f"""WITH {EV}, f AS (SELECT seq // 1000 AS file, count(*) AS entries, count(*) FILTER (op IN ('DELETE', 'RANGE_DELETE')) AS deletes, count(*) FILTER (op = 'MERGE') AS merges FROM ev GROUP BY 1)
SELECT file, 'many-deletes' AS rule FROM f WHERE deletes * 10 > entries UNION ALL SELECT file, 'many-merges' FROM f WHERE merges * 10 > entries * 6 UNION ALL SELECT file, 'small-file' FROM f WHERE entries < 1000"""
)
def advisor_rules(spark, sf):
    """Rules over properties of files: each file with each rule that it triggers."""
    f = L.op_events(spark, sf).groupBy(F.floor(F.col("seq") / 1000).alias("file")).agg(F.count("*").alias("entries"), F.count_if(F.col("op").isin(L.DELETE, L.RANGE_DELETE)).alias("deletes"), F.count_if(F.col("op") == L.MERGE).alias("merges"))
    return stats.advise(f, {"many-deletes": "deletes * 10 > entries", "many-merges": "merges * 10 > entries * 6", "small-file": "entries < 1000"}).select("file", "rule")


@query("WITH m AS (SELECT CAST(date_diff('month', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS create_time, count(*) AS size FROM lineitem GROUP BY 1) SELECT min(create_time) AS oldest, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM m")
def oldest_file(spark, sf):
    from .rewriting import _files

    return _files(spark, sf).agg(F.min("create_time").alias("oldest"), F.count("*").alias("files"), F.sum("size").alias("total_size"))


@query(f"WITH {EV} SELECT key // 25 AS range_id, count(*) AS n, CAST(sum(length(CAST(key AS VARCHAR)) + coalesce(length(CAST(value AS VARCHAR)), 0)) AS BIGINT) AS bytes FROM ev GROUP BY 1")
def memtable_range_stats(spark, sf):
    """Entries and bytes of unresolved records by range of keys."""
    size = F.length(F.col("key").cast("string")) + F.coalesce(F.length(F.col("value").cast("string")), F.lit(0))
    return L.op_events(spark, sf).groupBy(F.floor(F.col("key") / 25).alias("range_id")).agg(F.count("*").alias("n"), F.sum(size).cast("bigint").alias("bytes"))
