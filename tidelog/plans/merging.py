"""Merge operators, wide columns and attribute groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import oplog as L
from ..functions import merges
from ..operators import scan
from ..operators.resolve import latest, resolve
from .registry import EV, LI, ORD, query, resolved


@query(f"WITH {EV}, {resolved()} SELECT key, CASE WHEN count(*) FILTER (op = 'MERGE') > 0 THEN max_by(value, seq) FILTER (op = 'MERGE') ELSE max(value) FILTER (op = 'PUT') END AS value FROM res_live GROUP BY key HAVING bool_or(op <> 'DELETE')")
def merge_put(spark, sf):
    return resolve(L.op_events(spark, sf), fold=merges.get("put")).select("key", "value")


@query(f"WITH {EV}, {resolved()} SELECT key, max(value) FILTER (op <> 'DELETE') AS value FROM res_live GROUP BY key HAVING bool_or(op <> 'DELETE')")
def merge_max(spark, sf):
    return resolve(L.op_events(spark, sf), fold=merges.get("max")).select("key", "value")


@query(f"WITH {LI} SELECT key, CAST(((sum(CAST(value AS HUGEINT) * 1000000007 * 1000000007)) % 18446744073709551616) AS VARCHAR) AS value FROM li GROUP BY key")
def merge_uint64add(spark, sf):
    """Additions that wrap at 2**64; partial sums are combined before the shuffle."""
    big = F.col("value").cast("decimal(20,0)") * F.lit("1000000014000000049").cast("decimal(20,0)")
    return L.op_lineitem(spark, sf).groupBy("key").agg(F.pmod(F.sum(big.cast("decimal(28,0)")), F.lit(str(merges.U64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias("value"))


@query(f"WITH {LI} SELECT key, bit_xor(value * 1000 + l_linenumber) AS value FROM li GROUP BY key")
def merge_bytesxor(spark, sf):
    return L.op_lineitem(spark, sf).groupBy("key").agg(F.bit_xor(F.col("value") * 1000 + F.col("l_linenumber")).alias("value"))


@query(f"WITH {LI} SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, value) AS value FROM li GROUP BY key")
def merge_stringappend(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "value")))
    return L.op_lineitem(spark, sf).groupBy("key").agg(F.array_join(F.transform(rows, lambda x: x["value"].cast("string")), ",").alias("value"))


@query(f"WITH {LI} SELECT key, array_to_string(list_sort(list(value)), ',') AS value FROM li GROUP BY key")
def merge_sortlist(spark, sf):
    lists = L.op_lineitem(spark, sf).groupBy("key", F.col("l_returnflag").alias("seq")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))
    return lists.groupBy("key").agg(merges.get("sortlist")(F.lit(None), F.collect_list(F.struct("seq", "value"))).alias("value"))


@query(f"WITH {EV}, {resolved()} SELECT key, value, n_operands FROM res WHERE n_operands > 0")
def merge_with_base(spark, sf):
    return resolve(L.op_events(spark, sf), fold=lambda b, o: merges.get("add")(b, o).cast("bigint")).where("n_operands > 0").select("key", "value", "n_operands")


@query(f"WITH {LI} SELECT key, CAST(sum(value) AS BIGINT) AS value, TRUE AS same FROM li GROUP BY key")
def merge_partial_vs_full(spark, sf):
    """Sums in two levels equal sums in one."""
    li = L.op_lineitem(spark, sf)
    two = li.groupBy("key", "l_returnflag").agg(F.sum("value").alias("p")).groupBy("key").agg(F.sum("p").alias("value"))
    return two.join(li.groupBy("key").agg(F.sum("value").alias("one")), "key").select("key", "value", (F.col("value") == F.col("one")).alias("same"))


_ISLANDS = f"""WITH {EV}, f AS (SELECT key, seq, CASE WHEN seq % 7 < 4 THEN 'sum' ELSE 'max' END AS func, value FROM ev WHERE op IN ('MERGE', 'PUT')),
g AS (SELECT *, CASE WHEN lag(func) OVER w IS DISTINCT FROM func THEN 1 ELSE 0 END AS starts FROM f WINDOW w AS (PARTITION BY key ORDER BY seq)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY seq) AS island FROM g),
s AS (SELECT key, island, any_value(func) AS func, CASE WHEN any_value(func) = 'sum' THEN sum(value) ELSE max(value) END AS v FROM i GROUP BY key, island),
fold AS (SELECT key, list(struct_pack(f := func, v := CAST(v AS BIGINT)) ORDER BY island) AS parts FROM s GROUP BY key)
SELECT key, list_reduce(parts, lambda a, b: struct_pack(f := b.f, v := CASE WHEN b.f = 'sum' THEN a.v + b.v ELSE greatest(a.v, b.v) END)).f AS func,
  list_reduce(parts, lambda a, b: struct_pack(f := b.f, v := CASE WHEN b.f = 'sum' THEN a.v + b.v ELSE greatest(a.v, b.v) END)).v AS value FROM fold"""


@query(_ISLANDS)
def agg_merge_switch(spark, sf):
    """Named aggregates whose function changes along a key's history."""
    rows = L.op_events(spark, sf).where(F.col("op").isin(L.MERGE, L.PUT)).select("key", "seq", F.when(F.col("seq") % 7 < 4, "sum").otherwise("max").alias("func"), F.col("value").cast("string").alias("value"))
    got = rows.groupBy("key").agg(merges.agg_switch(F.array_sort(F.collect_list(F.struct("seq", "func", "value")))).alias("a"))
    return got.select("key", "a.func", "a.value")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ev WHERE op = 'MERGE') SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq DESC) AS value FROM r WHERE n <= 3 GROUP BY key")
def agg_last3(spark, sf):
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    top = L.op_events(spark, sf).where(F.col("op") == L.MERGE).withColumn("n", F.row_number().over(w)).where("n <= 3")
    return top.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"].cast("string")), ",").alias("value"))


_ENT = "ent AS (SELECT c_custkey AS key, c_mktsegment AS dflt, CAST(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS VARCHAR) AS acctbal, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)"


@query(f"WITH {_ENT} SELECT key, '=' || dflt || ';acctbal=' || acctbal || ';name=' || name || ';nation=' || nation AS columns FROM ent")
def entity_get(spark, sf):
    """Columns in name order, the default one first."""
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return L.entities(spark, sf).select("key", F.array_join(F.transform(F.array_sort(F.map_entries("cols")), entry), ";").alias("columns"))


@query(f"WITH {_ENT} SELECT key, dflt AS value FROM ent")
def entity_default_column(spark, sf):
    return L.entities(spark, sf).select("key", F.coalesce(F.element_at("cols", F.lit("")), F.lit("")).alias("value"))


@query(f"WITH {_ENT} SELECT key, dflt || ',touched' AS value, name FROM ent WHERE key % 2 = 0 UNION ALL SELECT key, dflt, name FROM ent WHERE key % 2 = 1")
def entity_merge_default(spark, sf):
    """A merge onto an entity changes its default column alone."""
    e = L.entities(spark, sf)
    touched = F.map_concat(F.map_filter("cols", lambda k, _: k != ""), F.create_map(F.lit(""), F.concat(F.element_at("cols", F.lit("")), F.lit(",touched"))))
    e = e.withColumn("cols", F.when(F.col("key") % 2 == 0, touched).otherwise(F.col("cols")))
    return e.select("key", F.element_at("cols", F.lit("")).alias("value"), F.element_at("cols", F.lit("name")).alias("name"))


@query(f"WITH {EV}, {_ENT}, {ORD}, {resolved()}, a AS (SELECT key, max_by(value, seq) AS orders FROM o GROUP BY key), b AS (SELECT key, value AS events FROM res) SELECT coalesce(ent.key, a.key, b.key) AS key, ent.dflt AS customer, a.orders, b.events FROM ent FULL JOIN a ON ent.key = a.key FULL JOIN b ON coalesce(ent.key, a.key) = b.key")
def attribute_groups(spark, sf):
    customers = L.entities(spark, sf).select("key", F.element_at("cols", F.lit("")).alias("value"))
    return scan.attribute_groups({"customer": customers, "orders": latest(L.op_orders(spark, sf)), "events": resolve(L.op_events(spark, sf))})


@query(f"WITH {_ENT}, p AS (SELECT n_nationkey * 7 AS key FROM nation) SELECT p.key, ent.name, CASE WHEN ent.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM p LEFT JOIN ent ON ent.key = p.key")
def multiget_entity(spark, sf):
    state = L.entities(spark, sf).select("key", F.element_at("cols", F.lit("name")).alias("name"))
    return scan.multi_get(state, L.probe_keys(spark, sf)).select("key", "name", "status")
