"""Compaction and expiry against golden cases."""

import os

import pytest
from pyspark.sql import functions as F

from tests import golden
from tidelog import oplog as L
from tidelog.operators import compact as C
from tidelog.operators.resolve import resolve
from tidelog.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"

S = "cf string, key string, seq bigint, op string, value bigint, end_key string, ts bigint"


def compacted(spark, rows, snapshots=(), bottommost=False):
    log = spark.createDataFrame([("c", k, s, o, v, e, s) for k, s, o, v, e in rows], S)
    return {(r.key, r.seq, r.op) for r in C.compact(log, list(snapshots), bottommost).collect()}


def test_range_deletions(spark):
    rows = [("morning", 5, "PUT", 1, None), ("morning", 2, "PUT", 2, None), ("night", 3, "PUT", 3, None), ("ma", 4, "RANGE_DELETE", None, "mz")]
    assert compacted(spark, rows) == {("morning", 5, "PUT"), ("night", 3, "PUT")}
    rows = [("morning", 15, "PUT", 1, None), ("morning", 5, "PUT", 2, None), ("night", 40, "PUT", 3, None), ("night", 20, "PUT", 4, None), ("ma", 28, "RANGE_DELETE", None, "mz")]
    assert compacted(spark, rows, [10]) == {("morning", 5, "PUT"), ("night", 40, "PUT")}


def test_bottommost_level(spark):
    assert compacted(spark, [("a", 1, "PUT", 1, None), ("b", 2, "PUT", 2, None)], [1], True) == {("a", 0, "PUT"), ("b", 2, "PUT")}
    assert compacted(spark, [("a", 1, "DELETE", None, None), ("b", 3, "DELETE", None, None), ("b", 1, "PUT", 1, None)], [1], True) == {("b", 3, "DELETE"), ("b", 0, "PUT")}


def test_stripes_and_merges(spark):
    rows = [("foo", s, "PUT", s, None) for s in range(1, 5)]
    assert compacted(spark, rows, [1, 3]) == {("foo", 4, "PUT"), ("foo", 3, "PUT"), ("foo", 1, "PUT")}
    rows = [("foo", 1, "PUT", 1, None)] + [("foo", s, "MERGE", s, None) for s in range(2, 6)]
    log = spark.createDataFrame([("c", *r, r[1]) for r in rows], "cf string, key string, seq bigint, op string, value bigint, end_key string, ts bigint")
    got = {(r.seq, r.op, r.value) for r in C.compact(log, [1, 3, 4]).collect()}
    assert got == {(5, "MERGE", 5), (4, "MERGE", 4), (3, "MERGE", 5), (1, "PUT", 1)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bottommost", [False, True])
def test_compaction_changes_no_snapshot(spark, seed, bottommost):
    rows = golden.random_log(seed, 120, 6)
    snapshots = [30, 75]
    log = spark.createDataFrame(rows, golden.SCHEMA)
    small = C.compact(log, snapshots, bottommost).withColumns({"end_key": F.lit(None).cast("bigint"), "ts": F.lit(0).cast("bigint")})
    tombs = log.where("op = 'RANGE_DELETE'").select(*small.columns)
    both = small.unionByName(tombs)
    for s in [*snapshots, 120]:
        want = {k: v[0] for k, v in golden.state(rows, s).items()}
        if bottommost:  # zeroed numbers lie under range deletions, which a bottommost run would have dropped with what they cover
            kept = tombs.where(f"seq <= {s}")
            both = small.unionByName(kept.where("seq > 30"))
        assert {r.key: r.value for r in resolve(both, s).collect()} == want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bottommost", [False, True])
def test_output_alone_reads_the_same_at_every_snapshot(spark, seed, bottommost):
    rows = golden.random_log(seed, 120, 6)
    snapshots = [30, 75]
    log = spark.createDataFrame(rows, golden.SCHEMA)
    upper = log if bottommost else log.where("seq > 20")
    out = C.rewrite(upper, snapshots, bottommost)
    if not bottommost:  # with a lower level that the run didn't read
        out = out.unionByName(log.where("seq <= 20").select(*out.columns))
    for s in [*snapshots, 120]:
        assert {r.key: r.value for r in resolve(out, s).collect()} == {k: v[0] for k, v in golden.state(rows, s).items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", ["compact_merge_collapse", "compact_bottommost"])
def test_compaction_queries_read_alone(spark, name):
    log = L.op_events(spark, SF)
    out = QUERIES[name](spark, SF).withColumn("cf", F.lit("events")).localCheckpoint()
    for s in (2000, 5000, 8000, None):
        assert {r.key: r.value for r in resolve(out, s).collect()} == {r.key: r.value for r in resolve(log, s).collect()}
    small = spark.createDataFrame([("c", "k", 10, "PUT", 1, None), ("c", "k", 2500, "RANGE_DELETE", None, "l")], "cf string, key string, seq bigint, op string, value bigint, end_key string")
    assert resolve(C.rewrite(small, [2000, 5000, 8000], name == "compact_bottommost")).count() == 0


def test_single_deletions(spark):
    log = spark.createDataFrame([("c", "a", 1, "PUT", 1), ("c", "a", 2, "SINGLE_DELETE", None), ("c", "b", 1, "PUT", 1), ("c", "b", 6, "SINGLE_DELETE", None), ("c", "d", 3, "SINGLE_DELETE", None), ("c", "e", 1, "PUT", 1), ("c", "e", 2, "PUT", 1), ("c", "e", 3, "SINGLE_DELETE", None)], "cf string, key string, seq bigint, op string, value bigint")
    assert {(r.key, r.seq, r.op, r.value) for r in C.annihilate_single_deletes(log.where("key < 'd'"), [5]).collect()} == {("b", 1, "PUT", None), ("b", 6, "SINGLE_DELETE", None)}
    assert {(r.key, r.puts) for r in C.single_delete_violations(log).collect()} == {("d", 0), ("e", 2)}


def test_filter_decisions(spark):
    log = spark.createDataFrame([("c", "a", 1, "PUT", 1), ("c", "a", 2, "PUT", 20), ("c", "b", 1, "PUT", 30), ("c", "d", 4, "PUT", 40), ("c", "d", 3, "PUT", 41)], "cf string, key string, seq bigint, op string, value bigint")
    decision = F.when(F.col("value") == 20, "REMOVE").when(F.col("value") == 30, "CHANGE").when(F.col("value") == 40, "PURGE").otherwise("KEEP")
    assert {(r.key, r.seq, r.op, r.value) for r in C.filtered(log, decision, F.col("value") + 1).collect()} == {("a", 1, "PUT", 1), ("a", 2, "DELETE", None), ("b", 1, "PUT", 31), ("d", 3, "PUT", 41)}


def test_expiry_rules(spark):
    rows = spark.createDataFrame([(t,) for t in (1, 5, 9)], "write_time bigint")
    assert C.live_db_ttl(rows, 5, 10).count() == 2 and C.live_db_ttl(rows, 0, 10).count() == 3  # strict: 5 + 5 is not less than 10
    ts = spark.createDataFrame([(0,), (50,), (100,), (None,), ((1 << 63) - 1,)], "ts bigint")
    assert [r[0] for r in ts.select(C.state_expired(F.col("ts"), 100, 150)).collect()] == [True, True, False, False, False]
    lists = spark.createDataFrame([([(1, "a"), (90, "b"), (2, "c")],), ([(1, "a")],), ([(99, "z")],)], "e array<struct<ts:bigint,v:string>>")
    assert [None if r[0] is None else [x.v for x in r[0]] for r in lists.select(C.live_list_suffix(F.col("e"), 20, 100)).collect()] == [["b", "c"], None, ["z"]]
    blobs = spark.createDataFrame([(1, None), (2, 10), (3, 11)], "k int, expiration bigint")
    assert C.live_until(blobs, 10).count() == 2


def cells(spec):
    return [(i, t, ttl, mask, None if mask else 1) for i, t, ttl, mask in spec]


def test_row_merge_of_golden_cases(spark):
    schema = "key string, version int, row_tombstone bigint, columns array<struct<index:int,ts:bigint,ttl:int,mask:int,value:int>>"
    # (index, time, ttl, mask): 0 a column, 1 a tombstone; expiring columns have a ttl
    r1, r2, r3 = [(0, 5, None, 1), (1, 8, None, 0), (2, 5, 9, 0)], [(0, 2, None, 0), (1, 5, 9, 0), (2, 7, None, 1), (7, 17, 9, 0)], [(0, 6, 9, 0), (1, 5, None, 1), (2, 4, None, 0), (11, 11, None, 1)]
    got = C.merge_rows(spark.createDataFrame([("k", i, None, cells(r)) for i, r in enumerate((r1, r2, r3))], schema))
    assert {(r["index"], r.ts, r.mask) for r in got.collect()} == {(0, 6, 0), (1, 8, 0), (2, 7, 1), (7, 17, 0), (11, 11, 1)}
    rows = [[(0, 5, None, 0), (1, 6, None, 0)], [(2, 10, None, 0), (3, 12, None, 0)], [(4, 13, None, 0), (5, 14, None, 0)]]
    got = C.merge_rows(spark.createDataFrame([("k", i, None, cells(r)) for i, r in enumerate(rows)] + [("k", 9, 11, None)], schema))
    assert {(r["index"], r.ts) for r in got.collect()} == {(3, 12), (4, 13), (5, 14)}
    c = spark.createDataFrame([("k", 0, 5_000_000, 10, 0, 1), ("k", 1, 5_000_000, None, 0, 1), ("k", 2, 5_000_000, 90, 0, 1)], "key string, index int, ts bigint, ttl int, mask int, value int")
    assert C.expire_cells(c, 20, True).count() == 2 and C.expire_cells(c, 20, False).where("mask = 1 AND value IS NULL").count() == 1


def test_files_and_triggers(spark):
    files = spark.createDataFrame([("a", 0, 5), ("b", 10, 5), ("c", 20, 5)], "file string, create_time bigint, size bigint")
    assert {r.file for r in C.fifo_ttl(files, 8, 20).collect()} == {"a", "c"} and {r.file for r in C.fifo_size(files, 10).collect()} == {"b", "c"}
    log = spark.createDataFrame([("f", i, i, "DELETE" if 40 <= i < 50 else "PUT") for i in range(100)], "cf string, key int, seq bigint, op string")
    assert C.deletion_triggered(log, 20, 10).first().needs_compaction and not C.deletion_triggered(log, 20, 11).first().needs_compaction
