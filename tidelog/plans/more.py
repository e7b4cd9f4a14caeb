"""Sorted runs, user merges, layered filters, exports and event-time rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..operators.resolve import latest, resolve
from .registry import DKV, EV, ORD, query, resolved


@query(f"WITH {EV}, {resolved()} SELECT key, value, seq FROM res")
def merging_runs(spark, sf):
    """Several sorted runs read as one: their union is resolved, and the shuffle's sort takes the heap's place."""
    log = L.op_events(spark, sf)
    runs = [log.where(F.pmod(F.col("seq"), F.lit(3)) == k) for k in range(3)]
    return resolve(runs[0].unionByName(runs[1]).unionByName(runs[2])).select("key", "value", "seq")


@query(
    f"""WITH {EV}, {resolved()}, l AS (SELECT key, max(value) FILTER (op = 'PUT') AS base, list(value ORDER BY seq) FILTER (op = 'MERGE') AS ops, bool_or(op <> 'DELETE') AS live FROM res_live GROUP BY key)
SELECT key, CAST(CASE WHEN ops IS NULL THEN base ELSE list_reduce(list_prepend(coalesce(base, 7), ops), lambda a, x: (a * 31 + x) % 1000003) END AS BIGINT) AS value FROM l WHERE live"""
)
def merge_user_fold(spark, sf):
    """A merge operator in Python whose result depends on the order of its operands."""
    from ..functions.user import python_merge

    def rolling(base, operands):
        a = 7 if base is None else base
        for x in operands:
            a = (a * 31 + x) % 1000003
        return a

    return python_merge(L.op_events(spark, sf), rolling).select("key", "value")


@query(f"WITH {EV}, {resolved()} SELECT key, value, 'PUT' AS op FROM res WHERE n_operands > 0")
def collapse_key(spark, sf):
    """Merge chains replaced by a put of their result."""
    return resolve(L.op_events(spark, sf)).where("n_operands > 0").select("key", "value", F.lit(L.PUT).alias("op"))


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value FROM o GROUP BY key), a AS (SELECT key, CASE WHEN value % 2 = 0 THEN value // 2 ELSE value END AS value FROM s WHERE value % 3 <> 0) SELECT key, value FROM a WHERE value >= 100000")
def layered_filter(spark, sf):
    """A user's filter, which drops and changes values, and the engine's own after it."""
    user = latest(L.op_orders(spark, sf)).where("value % 3 <> 0").withColumn("value", F.when(F.col("value") % 2 == 0, F.floor(F.col("value") / 2)).otherwise(F.col("value")))
    return user.where("value >= 100000").select("key", "value")


@query(f"WITH {EV}, b AS (SELECT min(ts) AS lo, max(ts) + 1 AS hi FROM ev) SELECT CAST((ts - lo) * 20 // (hi - lo) AS BIGINT) AS bucket, count(*) AS n FROM ev, b GROUP BY 1")
def dump_time_buckets(spark, sf):
    """Records in twenty equal spans of time."""
    log = L.op_events(spark, sf)
    span = log.agg(F.min("ts").alias("lo"), (F.max("ts") + 1).alias("hi"))
    bucket = F.expr("CAST((ts - lo) * 20 AS BIGINT) div (hi - lo)")
    return log.crossJoin(F.broadcast(span)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # one row


@query(f"WITH {ORD} SELECT key, max_by(value, seq) AS value, CAST(max(seq) AS BIGINT) AS seq FROM o GROUP BY key")
def export_import(spark, sf):
    """State written as a checkpoint and opened again."""
    from ..sources import files
    from .streams import _folder

    path = f"{_folder(spark)}/export"
    files.checkpoint(latest(L.op_orders(spark, sf)), path)
    return files.open_checkpoint(spark, path)[0].select("key", "value", "seq")


@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def list_state(spark, sf):
    """A list state: appended elements in order."""
    c = L.table(spark, sf, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["role"]), ",").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_type, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def rates_stream(spark, sf):
    """Tumbling windows of event time in a stream; the last update of a window is its count."""
    from ..streaming import streams
    from .streams import _folder

    folder = _folder(spark)
    e = L.table(spark, sf, "events").select("event_type", "event_id", F.timestamp_micros(L.micros("ts")).alias("t"))
    e.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    stream = streams.tail(spark, f"{folder}/in", e.schema, 1)
    day = F.floor(F.unix_micros("t") / 86_400_000_000)
    counts = stream.withColumn("day", day).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    streams.run_to_end(counts, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/offsets", "update")
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("event_type", "day").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT ps.s AS supplier, s.s_name AS name, ps.n AS parts FROM (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ps JOIN supplier s ON s.s_suppkey = ps.s")
def secondary_index_lookup(spark, sf):
    """Entries of a secondary index joined to the rows that they point to."""
    index = L.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.countDistinct("l_partkey").alias("parts"))
    return index.join(L.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name")), "supplier").select("supplier", "name", "parts")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dims, label FROM embeddings")
def array_payloads(spark, sf):
    """Values that are arrays."""
    return L.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims"), "label")
