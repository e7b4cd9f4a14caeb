"""Points at which a user adds to the engine: comparators, batch handlers, listeners, collectors, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..functions import batches, comparators
from ..operators import scan, stats, trace
from ..operators.resolve import latest
from ..sources import files
from ..sources.table import LogTable, WriteBatch
from .registry import DKV, EV, ORD, TR, query
from .streams import _folder
from .tables import _written


@query(f"WITH {DKV} SELECT row_number() OVER (ORDER BY key DESC) AS position, key FROM kv")
def comparator_order(spark, sf):
    """All keys in the order of a comparator that goes downwards."""
    rows = L.docs_kv(spark, sf).select("key", comparators.get("reverse_bytewise")(F.col("key")).alias("order"))
    return scan.numbered(rows, "order").select("position", "key")


@query(
    f"WITH {EV}, b AS (SELECT *, seq // 100 AS batch_id FROM ev), s AS (SELECT batch_id, min(seq) AS stop FROM b WHERE op = 'PUT' AND value % 40 = 0 GROUP BY 1) "
    "SELECT b.batch_id, b.seq AS n, b.op, b.key FROM b LEFT JOIN s USING (batch_id) WHERE stop IS NULL OR b.seq < stop"
)
def batch_handler(spark, sf):
    """Packed batches, visited up to the first put of a certain value."""
    rows = L.op_events(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 100)).withColumnRenamed("seq", "n")
    stop = (F.col("op") == L.PUT) & (F.col("value") % 40 == 0)
    return batches.visited(batches.packed(rows, "batch_id"), "batch_id", stop).select("batch_id", "n", "op", "key")


@query("SELECT * FROM (VALUES ('batch_written', 3), ('family_created', 1), ('compacted', 2), ('family_dropped', 1)) v(event, n)")
def event_listener(spark, sf):
    """What a listener of a table hears of writes, families and compactions."""
    t = LogTable.create(spark, f"{_folder(spark)}/table")
    heard: list[str] = []
    t.listeners.append(lambda event, entry: heard.append(event))
    first = L.op_events(spark, sf).where("seq < 100").withColumn("cf", F.lit("default")).withColumn("ordinal", F.col("seq")).drop("seq")
    t.write(first)
    t.write(WriteBatch().put(1, 1).delete(2))
    t.create_family("more")
    t.write(WriteBatch().put(1, 1, cf="more"))
    t.compact_files(list(t.state()["files"])[:2])
    t.compact_range()
    t.drop_family("more")
    return spark.createDataFrame([(e, heard.count(e)) for e in dict.fromkeys(heard)], "event string, n int")


@query("SELECT source AS file, count(*) AS n, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, max(length(text)) AS longest, count(*) FILTER (contains(text, '@')) AS with_at FROM documents WHERE text IS NOT NULL GROUP BY 1")
def property_collectors(spark, sf):
    """Properties of files by collectors of the user's, beside the engine's count."""
    d = L.table(spark, sf, "documents").where("text IS NOT NULL").withColumnRenamed("source", "file")
    mine = {"lines": F.sum(F.size(F.split("text", "\n"))), "longest": F.max(F.length("text")).cast("bigint"), "with_at": F.count_if(F.contains("text", F.lit("@")))}
    return stats.collected(d, mine)


@query(f"WITH {TR} SELECT seq, CASE type WHEN 'GET' THEN value_size WHEN 'SEEK' THEN key % 10 WHEN 'PUT' THEN 1 END AS answer FROM tr WHERE type IN ('GET', 'SEEK', 'PUT')")
def trace_handler(spark, sf):
    """Records of a trace given to a handler of their kind; kinds without one are passed over."""
    return trace.handled(L.trace(spark, sf), {"GET": F.col("value_size"), "SEEK": F.col("key") % 10, "PUT": F.lit(1).cast("bigint")}).select("seq", "answer")


@query("SELECT codec, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer, (VALUES ('none'), ('snappy'), ('zlib'), ('lz4'), ('lz4hc'), ('zstd'), ('bzip2')) v(codec) GROUP BY 1")
def codecs_round_trip(spark, sf):
    """Tables written with each codec and read again."""
    rows, out = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name"), None
    for codec in ("none", "snappy", "zlib", "lz4", "lz4hc", "zstd", "bzip2"):
        path = f"{_folder(spark)}/{codec}"
        files.write_sorted(rows, path, codec=codec)
        one = files.read_sorted(spark, path, codec, rows.schema).groupBy(F.lit(codec).alias("codec")).agg(F.count("*").alias("n"), F.sum("key").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value, CAST(max(seq) AS BIGINT) AS seq FROM o GROUP BY key) SELECT key, value, seq FROM s WHERE key >= 30 AND key < 60")
def sorted_table_scan(spark, sf):
    """A sorted table with Bloom filters, of which a range is read."""
    path = f"{_folder(spark)}/sorted"
    files.write_sorted(latest(L.op_orders(spark, sf)).select("key", "value", "seq"), path, bloom=True)
    return scan.scan(spark.read.parquet(path), 30, 60)


@query(f"WITH {ORD}, f AS (SELECT *, seq // ((max(seq) OVER () + 1 + 3) // 4) AS log FROM o) SELECT log, min(seq) + 1 AS first_seq, count(*) AS n, log = max(log) OVER () AS current FROM f GROUP BY log")
def wal_files(spark, sf):
    """The sorted log files of a table, the last of which is the current one."""
    t = _written(spark, L.op_orders(spark, sf).withColumn("cf", F.lit("default")))
    about = list(t.state()["files"].values())
    rows = [(n, a["from"], a["rows"], n == len(about) - 1) for n, a in enumerate(about)]
    return spark.createDataFrame(rows, "log bigint, first_seq bigint, n bigint, current boolean")


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value FROM o GROUP BY key) SELECT key, value FROM s")
def dump_undump(spark, sf):
    """State dumped to a portable file and loaded from it."""
    path = f"{_folder(spark)}/dump"
    files.dump(latest(L.op_orders(spark, sf)).select("cf", "key", "value"), path)
    return latest(files.undump(spark, path)).select("key", "value")


@query(f"WITH {ORD} SELECT key, seq, array_to_string(list_transform(list_filter(range(10), lambda i: i = 0 OR (value >> (7 * i)) > 0), lambda i: printf('%02X', ((value >> (7 * i)) & 127) + CASE WHEN (value >> (7 * (i + 1))) > 0 THEN 128 ELSE 0 END)), '') AS packed, value AS back FROM (SELECT key, seq, value * 100000007 + seq AS value FROM o)")
def varint_round_trip(spark, sf):
    """Numbers beyond 53 bits packed seven bits a byte, and read back."""
    from ..functions.codecs import decode_varint, encode_varint

    o = L.op_orders(spark, sf).select("key", "seq", (F.col("value") * 100_000_007 + F.col("seq")).alias("value"))
    as_bytes = o.withColumn("b", encode_varint(F.col("value")))
    return as_bytes.select("key", "seq", F.hex("b").alias("packed"), decode_varint(F.col("b")).alias("back"))


@query("SELECT user_id AS key, max(props) AS value FROM events GROUP BY 1")
def merge_max_bytes(spark, sf):
    """The largest of binary operands, byte by byte."""
    from ..functions import merges

    e = L.table(spark, sf, "events").select("user_id", F.struct(F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("value")).alias("o"))
    # operands of one key are put together in spans first, as the operator is associative
    spans = e.groupBy("user_id", F.expr("o.seq div 4096").alias("span")).agg(merges.get("max")(F.lit(None).cast("binary"), F.collect_list("o")).alias("value"))
    whole = spans.groupBy("user_id").agg(merges.get("max")(F.lit(None).cast("binary"), F.collect_list(F.struct(F.col("span").alias("seq"), "value"))).alias("value"))
    return whole.select(F.col("user_id").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {EV}, l AS (SELECT key, ts, max(ts) OVER (PARTITION BY key) AS now FROM ev WHERE op = 'PUT'), f AS (SELECT key, min(ts) FILTER (ts + 864000000000 > now) AS first FROM l GROUP BY key) SELECT l.key, string_agg(lpad(CAST(ts AS VARCHAR), 18, '0'), '' ORDER BY ts) AS value FROM l JOIN f ON l.key = f.key AND l.ts >= f.first GROUP BY l.key")
def ttl_list_fixed(spark, sf):
    """Lists stored as strings of elements of one width, each a time: those at the beginning that have expired are cut off."""
    from ..operators.compact import live_fixed_list

    log = L.op_events(spark, sf).where(F.col("op") == L.PUT)
    lists = log.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ts")), lambda t: F.lpad(t.cast("string"), 18, "0")), "").alias("value"), F.max("ts").alias("now"))
    ttl = F.lit(864_000_000_000)
    return lists.select("key", live_fixed_list(F.col("value"), 18, lambda e: e.cast("bigint") + ttl <= F.col("now")).alias("value"))


@query("WITH f AS (SELECT CAST(date_diff('month', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS create_time, count(*) AS size FROM lineitem GROUP BY 1) SELECT create_time, size, CASE WHEN create_time < (SELECT max(create_time) FROM f) - 60 THEN 'cold' WHEN create_time < (SELECT max(create_time) FROM f) - 24 THEN 'warm' ELSE 'hot' END AS temperature FROM f")
def fifo_temperature(spark, sf):
    """Files that move to colder storage by their age."""
    from ..operators.compact import temperatures
    from .rewriting import _files

    f = _files(spark, sf)
    return temperatures(f, f.agg(F.max("create_time")).first()[0], {"warm": 24, "cold": 60}).select("create_time", "size", "temperature")


@query(f"WITH {EV}, p AS (SELECT * FROM ev WHERE op = 'PUT'), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM p) SELECT 'manual' AS context, key, seq, value FROM r WHERE NOT (n = 1 AND value % 5 = 0) UNION ALL SELECT 'automatic', key, seq, value FROM r WHERE NOT (n = 1 AND value % 5 IN (1, 2))")
def filter_factory(spark, sf):
    """Filters that a factory makes for each compaction by its context."""
    from ..operators.compact import filtered

    def factory(context: dict):
        rest = F.col("value") % 5
        return F.when(rest == 0 if context["is_manual"] else rest.isin(1, 2), "PURGE").otherwise("KEEP")

    log, out = L.op_events(spark, sf).where(F.col("op") == L.PUT), None
    for name, manual in (("manual", True), ("automatic", False)):
        one = filtered(log, factory({"is_manual": manual, "is_full": True}), F.col("value")).select(F.lit(name).alias("context"), "key", "seq", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value FROM o GROUP BY key), p AS (SELECT CAST(n_nationkey * 7 AS BIGINT) AS key FROM nation) SELECT p.key, s.value FROM p LEFT JOIN s USING (key)")
def hashed_table_lookup(spark, sf):
    """A table of hash buckets: a lookup opens the buckets of its keys alone."""
    path = f"{_folder(spark)}/hashed"
    files.write_hashed(latest(L.op_orders(spark, sf)).select("key", "value"), path, 16)
    return files.read_hashed(spark, path, L.probe_keys(spark, sf), 16)


@query(f"WITH {EV}, p AS (SELECT * FROM ev WHERE op = 'PUT'), m AS (SELECT max(ts) - 432000000000 AS mark FROM p), a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM p, m WHERE seq % 4 <> 0 AND ts < mark) SELECT key, seq FROM a WHERE n = 1 UNION ALL SELECT key, seq FROM p, m WHERE seq % 4 = 0 OR ts >= mark")
def late_data(spark, sf):
    """Writes that come late, from before the low watermark, stay until the next collection."""
    from ..streaming import streams

    folder = _folder(spark)
    log = L.op_events(spark, sf).where(F.col("op") == L.PUT).select("cf", "key", "seq", "op", "value", "ts")
    top = log.agg(F.max("ts")).first()[0]
    # every fourth record but the newest comes in the second batch, after which nothing is collected
    second = (F.col("seq") % 4 == 0) & (F.col("ts") != top)
    log.where(~second).coalesce(1).write.parquet(f"{folder}/log")
    log.where(second).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    streams.trimmed(streams.tail(spark, f"{folder}/log", log.schema, 1), f"{folder}/out", f"{folder}/offsets", 432_000_000_000, every=2)
    out = spark.read.parquet(f"{folder}/out")
    return out.where(F.col("version") == out.agg(F.max("version")).first()[0]).select("key", "seq")
