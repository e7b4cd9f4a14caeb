"""Tables that are written to, iterators over them, and what their files are like."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oplog as L
from ..operators import scan, stats, txn
from ..operators.compact import live_db_ttl
from ..operators.resolve import latest, resolve
from ..sources import files
from ..sources.table import LogTable, TableIterator, WriteBatch
from .registry import DKV, EV, ORD, query, resolved
from .streams import _folder


def _written(spark, log, parts: int = 4, families=("default",), **more) -> LogTable:
    """A new table with the log's records in batches, in their order."""
    t = LogTable.create(spark, f"{_folder(spark)}/table", families=families, **more)
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    step = -(-(hi + 1 - lo) // parts)
    for a in range(lo, hi + 1, step):
        t.write(log.where((F.col("seq") >= a) & (F.col("seq") < a + step)).withColumn("ordinal", F.col("seq") - a).drop("seq"), write_time=0)
    return t


def _events(spark, sf, cf: str = "default"):
    return L.op_events(spark, sf).withColumn("cf", F.lit(cf))


@query(f"WITH {EV}, {resolved()} SELECT key, value, n_operands FROM res")
def write_batches(spark, sf):
    """Atomic batches; one that fails leaves data behind that no reader sees."""
    t = _written(spark, _events(spark, sf))
    try:
        t.write(WriteBatch().put(1, -1).put(2, -2, cf="not there"))
    except ValueError:
        pass
    return t.get().select("key", "value", "n_operands")


@query("WITH p AS (SELECT user_id AS key, max_by(CAST(floor(value * 100 + 0.5) AS BIGINT), event_id) AS value, max_by(epoch_us(ts) // 1000000, event_id) AS write_time FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT * FROM p WHERE write_time + 864000 >= (SELECT max(epoch_us(ts) // 1000000) FROM events)")
def timed_put(spark, sf):
    """Puts with write times of their own, and a time to live that goes by them."""
    puts = _events(spark, sf).where(F.col("op") == L.PUT).withColumn("write_time", F.expr("ts div 1000000"))
    newest = _written(spark, puts, 2).read().groupBy("cf", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("write_time", "seq").alias("write_time"))
    now = L.op_events(spark, sf).agg(F.expr("max(ts) div 1000000")).first()[0]
    return live_db_ttl(newest, 864_000, now).select("key", "value", "write_time")


@query("SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS notes, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS keys")
def put_log_data(spark, sf):
    """Notes that only the log holds."""
    e = L.table(spark, sf, "events")
    note = F.col("event_type") == "error"
    rows = e.where(note | (F.col("event_type") == "signup")).select(F.lit("default").alias("cf"), F.when(~note, F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), F.when(note, L.LOG_DATA).otherwise(L.PUT).alias("op"), F.when(~note, L.cents("value")).alias("value"), F.when(note, F.col("props")).alias("note"))
    t = _written(spark, rows, 2)
    notes = t.read().where((F.col("op") == L.LOG_DATA) & F.col("note").isNotNull()).agg(F.count("*").alias("notes"))
    return notes.crossJoin(t.get().agg(F.count("*").alias("keys")))  # one row each


@query("SELECT c_custkey AS key, c_mktsegment AS segment, c_name AS name FROM customer")
def put_entities(spark, sf):
    """Wide-column entities written to a table and read from it."""
    rows = L.entities(spark, sf).withColumn("cf", F.lit("default"))
    return _written(spark, rows, 2, value="string").read().select("key", F.col("cols")[""].alias("segment"), F.col("cols")["name"].alias("name"))


_PLAIN = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE op <> 'RANGE_DELETE' AND NOT EXISTS (SELECT 1 FROM ev t WHERE t.op = 'RANGE_DELETE' AND t.seq > ev.seq AND ev.key >= t.key AND ev.key < t.end_key)),
b AS (SELECT *, max(CASE WHEN op <> 'MERGE' THEN seq END) OVER (PARTITION BY key) AS base_seq FROM p),
g AS (SELECT key, count(*) FILTER (op = 'MERGE') AS m, max(op) FILTER (op <> 'MERGE') AS base_op, max(value) FILTER (op = 'PUT') AS base, sum(value) FILTER (op = 'MERGE') AS folded FROM b WHERE seq >= coalesce(base_seq, -1) GROUP BY key),
c AS (SELECT key, CASE WHEN m = 0 THEN base_op WHEN base_op IS NULL THEN 'MERGE' ELSE 'PUT' END AS op, CAST(CASE WHEN m > 0 THEN coalesce(base, 0) + folded ELSE base END AS BIGINT) AS value FROM g)"""


@query(_PLAIN + " SELECT key, op, value, 'compacted' AS part FROM c WHERE key >= 40 AND key < 90 UNION ALL SELECT key, op, value, 'kept' FROM ev WHERE op <> 'RANGE_DELETE' AND NOT (key >= 40 AND key < 90)")
def compact_range_stored(spark, sf):
    """A range of a stored table rewritten by hand: records within it are compacted, and others are what they were."""
    t = _written(spark, _events(spark, sf))
    t.compact_range(40, 90)
    inside = (F.col("key") >= 40) & (F.col("key") < 90)
    return t.read().where(F.col("op") != L.RANGE_DELETE).select("key", "op", "value", F.when(inside, "compacted").otherwise("kept").alias("part"))


@query(f"WITH {EV}, {resolved()} SELECT key, value FROM res")
def compact_files_stored(spark, sf):
    """Some of a table's files rewritten into one; what is read stays the same."""
    t = _written(spark, _events(spark, sf))
    t.compact_files(list(t.state()["files"])[1:3])
    return t.get().select("key", "value")


@query(f"WITH {EV}, {resolved()} SELECT 'events' AS family, count(*) AS n FROM res")
def column_families(spark, sf):
    """Families are created and dropped; a dropped one's records are gone, though a new one has its name."""
    t = _written(spark, _events(spark, sf, "events"), 2, families=("events", "old"))
    t.write(WriteBatch().put(1, 1, cf="old"))
    t.drop_family("old")
    t.create_family("old")
    t.create_family("empty")
    return t.get().groupBy(F.col("cf").alias("family")).agg(F.count("*").alias("n"))


@query(f"WITH {ORD}, s AS (SELECT key, max_by(value, seq) AS value FROM o GROUP BY key) SELECT row_number() OVER (ORDER BY key) AS position, key, value FROM s")
def full_scan(spark, sf):
    """All of the key space in order, with each key's place in it."""
    return scan.numbered(latest(L.op_orders(spark, sf)).select("key", "value")).select("position", "key", "value")


@query(f"WITH {EV}, {resolved()}, b AS (SELECT * FROM ev WHERE seq >= (SELECT max(seq) FROM ev) - 999), k AS (SELECT key, max_by(op, seq) AS op, max_by(value, seq) AS value FROM b WHERE op <> 'RANGE_DELETE' GROUP BY key) SELECT row_number() OVER (ORDER BY key) AS position, key, op, value FROM k")
def batch_iterator(spark, sf):
    """An indexed batch of the last thousand records in key order: the newest record of each of its keys."""
    newest = lambda c: F.max_by(c, "seq").alias(c)
    keys = _last(spark, sf).where(F.col("op") != L.RANGE_DELETE).groupBy("key").agg(newest("op"), newest("value"))
    return scan.numbered(keys).select("position", "key", "op", "value")


def _last(spark, sf, n: int = 1000):
    log = L.op_events(spark, sf)
    return log.where(F.col("seq") > log.agg(F.max("seq")).first()[0] - n)


@query(f"WITH {EV}, b AS (SELECT * FROM ev WHERE seq >= (SELECT max(seq) FROM ev) - 999), {resolved('b')} SELECT key, value FROM res")
def batch_get(spark, sf):
    """State from an indexed batch alone, without what is committed."""
    return resolve(_last(spark, sf)).select("key", "value")


@query(f"WITH {EV}, {resolved()}, t AS (SELECT key, bool_or(seq >= (SELECT max(seq) FROM ev) - 999) AS touched FROM ev WHERE op <> 'RANGE_DELETE' GROUP BY key) SELECT row_number() OVER (ORDER BY res.key) AS position, res.key, res.value, CASE WHEN touched THEN 'both' ELSE 'base' END AS source FROM res JOIN t USING (key)")
def overlay_iterator(spark, sf):
    """The base with a batch on top, in key order, and whether the batch has a record of the key."""
    batch = _last(spark, sf)
    first = batch.agg(F.min("seq")).first()[0]
    base = L.op_events(spark, sf).where(F.col("seq") < first)
    state = resolve(txn.overlay(base, batch.withColumn("ordinal", F.col("seq") - first).drop("seq"))).select("key", "value")
    touched = batch.where(F.col("op") != L.RANGE_DELETE).select("key").distinct().withColumn("source", F.lit("both"))
    return scan.numbered(state.join(touched, "key", "left").withColumn("source", F.coalesce("source", F.lit("base")))).select("position", "key", "value", "source")


_TWO = f"WITH {EV}, {ORD}, s AS (SELECT * FROM ev WHERE seq <= 5000), {resolved('s')}, q AS (SELECT key, max_by(value, seq) AS value FROM o WHERE seq <= 5000 GROUP BY key)"


@query(_TWO + " SELECT coalesce(res.key, q.key) AS key, coalesce(res.value, q.value) AS value, CASE WHEN res.key IS NULL THEN 'orders' ELSE 'events' END AS family FROM res FULL JOIN q ON res.key = q.key")
def multi_cf_scan(spark, sf):
    """Two families at one snapshot as one ordered run of keys: the first that has a key gives its entry."""
    log = L.op_events(spark, sf)
    states = {"events": resolve(log, 5000), "orders": latest(L.op_orders(spark, sf), 5000)}
    return scan.coalesced(states).select("key", "value", "family")


@query(_TWO + " SELECT coalesce(res.key, q.key) AS key, res.value AS events, q.value AS orders FROM res FULL JOIN q ON res.key = q.key")
def multi_cf_groups(spark, sf):
    """Two families at one snapshot, with a key's entries side by side."""
    return scan.attribute_groups({"events": resolve(L.op_events(spark, sf), 5000), "orders": latest(L.op_orders(spark, sf), 5000)})


@query(
    f"WITH {EV}, m AS (SELECT (max(seq) + 2) // 2 - 1 AS half FROM ev), s AS (SELECT ev.* FROM ev, m WHERE seq <= half), {resolved('s')}, {resolved('ev', name='now')} "
    "SELECT 'before' AS phase, key, value FROM res UNION ALL SELECT 'after', key, value FROM now"
)
def iterator_refresh(spark, sf):
    """An iterator sees the state it was made on until it is refreshed."""
    log = _events(spark, sf)
    hi = log.agg(F.max("seq")).first()[0]
    half = (hi + 2) // 2
    t = _written(spark, log.where(F.col("seq") < half), 1)
    it = TableIterator(t)
    t.write(log.where(F.col("seq") >= half).withColumn("ordinal", F.col("seq") - half).drop("seq"))
    before = it.rows().select(F.lit("before").alias("phase"), "key", "value")
    return before.unionByName(it.refresh().rows().select(F.lit("after").alias("phase"), "key", "value"))


# --- files


@query(f"WITH {DKV} SELECT substr(key, 1, 4) AS prefix, count(*) AS n, min(key) AS smallest_key, max(key) AS largest_key FROM kv GROUP BY 1")
def partitioned_output(spark, sf):
    """Files by a prefix of fixed size, read back: no file holds keys of two."""
    path = f"{_folder(spark)}/parts"
    files.write_sorted(L.docs_kv(spark, sf).select("key", "seq"), path, prefix=4)
    of_file = files.file_catalog(spark, path)
    prefix = F.regexp_extract("folder", "prefix=([^/]*)", 1)
    return of_file.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))


@query(f"WITH {DKV} SELECT split_part(key, ':', 1) AS file, count(*) AS n, min(key) AS smallest_key, max(key) AS largest_key FROM kv WHERE lang <> 'en' GROUP BY 1")
def table_filter(spark, sf):
    """Files skipped by a property of theirs: the filter is asked for each folder, and those it rejects aren't opened."""
    path = f"{_folder(spark)}/by_lang"
    L.docs_kv(spark, sf).select("key", "lang").write.partitionBy("lang").parquet(path)
    kept = files.read_chosen(spark, path, lambda folder: "lang=en" not in folder)
    return kept.groupBy(F.substring_index("key", ":", 1).alias("file")).agg(F.count("*").alias("n"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


@query("SELECT source AS file, count(*) AS n, min(doc_id) AS smallest_key, max(doc_id) AS largest_key, bit_xor(CAST('0x' || substr(md5(coalesce(text, '') || '/' || doc_id), 1, 15) AS BIGINT)) AS checksum FROM documents GROUP BY 1")
def file_checksums(spark, sf):
    """A checksum of each file's whole records that doesn't depend on their order."""
    d = L.table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id", "text")
    return files.checksums(d, "file", F.concat(F.coalesce("text", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))).join(d.groupBy("file").agg(F.min("doc_id").alias("smallest_key"), F.max("doc_id").alias("largest_key")), "file").select("file", "n", "smallest_key", "largest_key", "checksum")


@query("SELECT c_custkey AS pk, 'new' AS change FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal >= 0")
def backup_diff(spark, sf):
    """Two backups of a table: between them a file came and another went. What was copied, and what rows they don't share."""
    folder = _folder(spark)
    table, backups = f"{folder}/table", files.Backups(spark, f"{folder}/backups")
    c = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("pk"), "c_acctbal")
    old = c.where("c_acctbal >= 0")
    old.where("pk % 3 = 0").coalesce(1).write.parquet(table)
    first = files.listing(spark, table)
    old.where("pk % 3 <> 0").coalesce(1).write.mode("append").parquet(table)
    one, copied = backups.create(table)
    files.remove(spark, f"{table}/{first[0][0]}")
    c.where("c_acctbal < 0").coalesce(1).write.mode("append").parquet(table)
    two, again = backups.create(table)
    if (copied, again) != (2, 1) or not backups.verify(one) or not backups.verify(two):
        raise RuntimeError("a backup holds files that it shouldn't, or misses some")
    older, newer = backups.restore(one).select("pk"), backups.restore(two).select("pk")
    return newer.exceptAll(older).withColumn("change", F.lit("new")).union(older.exceptAll(newer).withColumn("change", F.lit("gone")))


_BAD = "CASE WHEN key % 4 = 3 THEN row_number() OVER (PARTITION BY key % 4 ORDER BY seq) ELSE row_number() OVER (PARTITION BY key % 4 ORDER BY key, seq DESC) END"


@query(
    f"""WITH {ORD}, p AS (SELECT key, seq, key % 4 AS file, {_BAD} AS position FROM o WHERE NOT (key % 4 = 2 AND seq % 50 = 0)),
l AS (SELECT *, lag(key) OVER w AS k, lag(seq) OVER w AS s FROM p WINDOW w AS (PARTITION BY file ORDER BY position)),
c AS (SELECT key % 4 AS file, count(*) AS expected FROM o GROUP BY 1)
SELECT file, count(*) AS n, count(*) FILTER (k > key OR (k = key AND s <= seq)) AS out_of_order, any_value(expected) - count(*) AS lost FROM l JOIN c USING (file) GROUP BY file"""
)
def output_validation(spark, sf):
    """Files as a job wrote them: one isn't in key order, and one has lost records."""
    from pyspark.sql import Window

    log = L.op_orders(spark, sf).withColumn("file", F.col("key") % 4)
    by = Window.partitionBy("file")
    wrong = F.col("file") == 3
    rows = log.where(~((F.col("file") == 2) & (F.col("seq") % 50 == 0)))
    rows = rows.withColumn("position", F.when(wrong, F.row_number().over(by.orderBy("seq"))).otherwise(F.row_number().over(by.orderBy("key", F.col("seq").desc()))))
    expected = log.groupBy("file").agg(F.count("*").alias("expected"))
    return stats.order_check(rows).join(expected, "file").select("file", "n", "out_of_order", (F.col("expected") - F.col("n")).alias("lost"))


@query(
    """WITH o AS (SELECT o_orderkey AS pk, max(o_custkey) AS secondary FROM orders GROUP BY 1),
x AS (SELECT pk, CASE WHEN pk % 89 = 1 THEN secondary + 1 ELSE secondary END AS secondary FROM o WHERE pk % 97 <> 2 UNION ALL SELECT -1 - pk, secondary FROM o WHERE pk % 83 = 3)
SELECT count(o.pk) AS n, count(*) FILTER (o.secondary = x.secondary) AS n_matching, count(*) FILTER (x.pk IS NULL) AS missing, count(*) FILTER (o.pk IS NULL) AS dangling, count(*) FILTER (o.secondary <> x.secondary) AS different FROM o FULL JOIN x ON o.pk = x.pk"""
)
def index_consistency(spark, sf):
    """Orders and an index from customers to orders that lacks some, has some too many, and some under another customer."""
    o = L.table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("pk")).agg(F.max("o_custkey").alias("secondary"))
    off = F.when(F.col("pk") % 89 == 1, F.col("secondary") + 1).otherwise(F.col("secondary"))
    index = o.where("pk % 97 <> 2").select("pk", off.alias("secondary")).union(o.where("pk % 83 = 3").select(-1 - F.col("pk"), "secondary"))
    return txn.index_check(o, index).select((F.col("matching") + F.col("missing") + F.col("different")).alias("n"), F.col("matching").alias("n_matching"), "missing", "dangling", "different")


@query(f"WITH {ORD} SELECT 'num-entries' AS name, count(*) AS value FROM o UNION ALL SELECT 'num-live-keys', count(DISTINCT key) FROM o UNION ALL SELECT 'num-puts', count(*) FROM o UNION ALL SELECT 'num-batches', 3 UNION ALL SELECT 'num-commits', 4 UNION ALL SELECT 'num-column-families', 1 UNION ALL SELECT 'latest-sequence-number', max(seq) + 1 FROM o")
def table_properties(spark, sf):
    """Properties of a stored table by name."""
    p = _written(spark, L.op_orders(spark, sf).withColumn("cf", F.lit("default")), 3).properties()
    names = ["num-entries", "num-live-keys", "num-puts", "num-batches", "num-commits", "num-column-families", "latest-sequence-number"]
    return spark.createDataFrame([(n, p[n]) for n in names], "name string, value bigint")


@query(f"WITH {ORD}, f AS (SELECT *, seq // ((max(seq) OVER () + 1 + 2) // 3) AS file FROM o) SELECT file, count(*) AS n, CAST(0 AS BIGINT) AS deletes, min(key) AS smallest_key, max(key) AS largest_key, min(seq) + 1 AS first_seq, max(seq) + 1 AS last_seq FROM f GROUP BY 1")
def live_file_metadata(spark, sf):
    """What each batch's files hold, from the files."""
    t = _written(spark, L.op_orders(spark, sf).withColumn("cf", F.lit("default")), 3)
    order = {name: n for n, name in enumerate(t.state()["files"])}
    number = F.create_map(*(x for name, n in order.items() for x in (F.lit(name), F.lit(n))))
    p = t.file_properties().withColumn("file", number[F.substring_index("file", "/", 1)].cast("bigint"))
    return p.groupBy("file").agg(F.sum("n").alias("n"), F.sum("deletes").alias("deletes"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
