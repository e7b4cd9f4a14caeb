"""Reads against a plain fold over random logs, and against golden cases."""

import os

import pytest
from pyspark.sql import functions as F

from tests import golden
from tidelog import oplog as L
from tidelog.functions import codecs, merges, prefixes
from tidelog.operators import scan
from tidelog.operators.ranges import fragments, range_join
from tidelog.operators.resolve import latest, live_records, operands, resolve, uncovered
from tidelog.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_resolve_matches_the_fold(spark, seed):
    rows = golden.random_log(seed)
    log = spark.createDataFrame(rows, golden.SCHEMA)
    for snapshot, read_ts, ranges in [(None, None, True), (90, None, True), (None, 1200, True), (150, None, False)]:
        want = {k: (v[0], v[1], len(v[2])) for k, v in golden.state(rows, snapshot, read_ts, ranges).items()}
        for span in (1 << 20, 17):
            got = {r.key: (r.value, r.seq, r.n_operands) for r in resolve(log, snapshot, read_ts, ranges=ranges, span=span).collect()}
            assert got == want
    want = {k: v for k, v in golden.state(rows).items()}
    folded = {r.key: r.value for r in resolve(log.withColumn("value", F.col("value").cast("string")), fold=merges.string_append(",")).collect()}
    assert {k: folded[k] for k in want if want[k][2]} == {k: ",".join(str(x) for x in ([] if v[3] is None else [v[3]]) + v[2]) for k, v in want.items() if v[2]}


def log_of(spark, ops):
    """Rows from (key, seq, op, value)."""
    return spark.createDataFrame([("cf", k, s, o, v, None, s) for k, s, o, v in ops], "cf string, key string, seq bigint, op string, value string, end_key string, ts bigint")


def test_operands_of_golden_cases(spark):
    log = log_of(spark, [("k1", 1, "MERGE", "a"), ("k1", 2, "PUT", "x"), ("k1", 3, "MERGE", "b"), ("k1", 4, "MERGE", "c"), ("k1", 5, "MERGE", "d"), ("k1.1", 6, "MERGE", "r"), ("k1.1", 7, "DELETE", None), ("k1.1", 8, "MERGE", "c"), ("k1.1", 9, "MERGE", "k"), ("k1.1", 10, "MERGE", "s")])
    got = {r.key: r for r in operands(log).collect()}
    assert got["k1"].operands == ["x", "b", "c", "d"] and got["k1.1"].operands == ["c", "k", "s"]
    few = {r.key: r for r in operands(log, expected=3).collect()}
    assert (few["k1"].operands, few["k1"].n, few["k1"].status) == (None, 4, "Incomplete") and few["k1.1"].status == "OK"


def test_range_deletion_is_strict_and_half_open(spark):
    log = spark.createDataFrame([("c", 1, 5, "PUT", 1, None, 0), ("c", 2, 6, "PUT", 2, None, 0), ("c", 3, 7, "PUT", 3, None, 0), ("c", 1, 6, "RANGE_DELETE", None, 3, 0), ("c", 9, 9, "RANGE_DELETE", None, 8, 0), ("d", 1, 1, "PUT", 7, None, 0)], golden.SCHEMA)
    assert {(r.cf, r.key) for r in resolve(log).collect()} == {("c", 2), ("c", 3), ("d", 1)}


def test_binary_keys_order_by_unsigned_bytes(spark):
    keys = [b"\x00", b"\x00\x01", b"a", b"\x7f", b"\x80", b"\xff", b""]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert [bytes(r.key) for r in scan.scan(df).collect()] == sorted(keys)
    assert [bytes(r.key) for r in scan.prefix_scan(df, b"\x00").collect()] == [b"\x00", b"\x00\x01"]


@pytest.mark.parametrize("few", [2000, 1])
def test_range_joins_agree_beyond_the_broadcast(spark, few):
    points = spark.createDataFrame([(i,) for i in range(100)], "key bigint")
    ranges = [(a, a + a % 7, a) for a in range(0, 90, 3)]
    r = spark.createDataFrame(ranges, "begin_key bigint, end_key bigint, n bigint")
    covered = {k for k in range(100) if any(a <= k < b for a, b, _ in ranges)}
    assert {x.key for x in range_join(points, r, F.lit(True), "left_anti", few=few, buckets=4).collect()} == set(range(100)) - covered
    assert sorted((x.key, x.n) for x in range_join(points, r, F.lit(True), "inner", few=few, buckets=4).collect()) == sorted((k, n) for k in range(100) for a, b, n in ranges if a <= k < b)


def test_fragments_of_golden_cases(spark):
    cases = {(("a", "b", 10), ("c", "d", 5)): {("a", "b", (10,)), ("c", "d", (5,))}, (("a", "e", 10), ("c", "g", 15)): {("a", "c", (10,)), ("c", "e", (15, 10)), ("e", "g", (15,))}}
    for tombs, want in cases.items():
        got = fragments(spark.createDataFrame(list(tombs), "begin_key string, end_key string, seq bigint")).collect()
        assert {(r.begin_key, r.end_key, tuple(r.seqs)) for r in got} == want


@pytest.mark.parametrize("few", [10_000, 20])
def test_seek_finds_neighbours(spark, few):
    keys = sorted({(i * 37) % 1000 for i in range(300)})
    probes = list(range(-5, 1010, 7))
    k, p = spark.createDataFrame([(x,) for x in keys], "key bigint"), spark.createDataFrame([(x,) for x in probes], "probe bigint")
    up = {r.probe: r.key for r in scan.seek(k, p, True, few=few).collect()}
    down = {r.probe: r.key for r in scan.seek(k, p, False, few=few).collect()}
    assert up == {x: min((y for y in keys if y >= x), default=None) for x in probes}
    assert down == {x: max((y for y in keys if y <= x), default=None) for x in probes}


def test_as_of_is_inclusive_or_strict(spark):
    v = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, t int, value string")
    e = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 5), (3, 1)], "k int, at int")
    got = lambda strict: {(r.k, r["at"]): r.value for r in scan.as_of(e, v, "k", "at", "t", "value", strict).collect()}
    assert got(False) == {(1, 9): None, (1, 10): "a", (1, 25): "b", (2, 5): "c", (3, 1): None}
    assert got(True) == {(1, 9): None, (1, 10): None, (1, 25): "b", (2, 5): None, (3, 1): None}


def one(spark, column, values, kind):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 1 << 40, (1 << 53) + 1, (1 << 60) + 12345, (1 << 62) + 3, (1 << 63) - 1]
    packed = [bytes(x) for x in one(spark, codecs.encode_varint, numbers, "bigint")]

    def varint(n):
        out = b""
        while n >= 128:
            out += bytes([n % 128 + 128])
            n //= 128
        return out + bytes([n])

    assert packed == [varint(n) for n in numbers]
    assert one(spark, codecs.decode_varint, [bytearray(p + b"\xff") for p in packed], "binary") == numbers
    big = [0, 255, 1 << 63, (1 << 64) - 1]
    assert [int(x) for x in one(spark, codecs.decode_fixed_le, [bytearray(n.to_bytes(8, "little")) for n in big], "binary")] == big
    assert [bytes(x) for x in one(spark, codecs.encode_fixed_be, [0, 258], "bigint")] == [(0).to_bytes(8, "big"), (258).to_bytes(8, "big")]
    assert one(spark, prefixes.from_string("fixed:3"), ["ab", "abc", "abcd"], "string") == [None, "abc", "abc"]
    assert one(spark, prefixes.from_string("capped:3"), ["ab", "abc", "abcd"], "string") == ["ab", "abc", "abc"]


def fold(spark, name, base, values, kind):
    df = spark.createDataFrame([(base, [(i, v) for i, v in enumerate(values)])], f"base {kind}, ops array<struct<seq:bigint,value:{kind}>>")
    return df.select(merges.get(name)(F.col("base"), F.col("ops"))).first()[0]


def test_merge_operators(spark):
    assert fold(spark, "put", "old", ["a", "b"], "string") == "b"
    assert fold(spark, "max", b"b", [b"a", b"\xff", b"c"], "binary") == b"\xff"
    assert fold(spark, "stringappend", "x", ["", "b"], "string") == "x,,b" and fold(spark, "stringappend", None, ["a", "b"], "string") == "a,b"
    assert fold(spark, "sortlist", "9", ["1,5", "2,3"], "string") == "1,2,3,5"
    assert bytes(fold(spark, "bytesxor", b"\x0f\xf0", [b"\xff", b"\x01\x02\x03"], "binary")) == bytes([0x0F ^ 0xFF ^ 0x01, 0xF0 ^ 0x02, 0x03])
    assert int(fold(spark, "uint64add", (1 << 62), [(1 << 62)] * 3 + [5], "bigint")) == 5
    with pytest.raises(ValueError):
        merges.get("missing")


AGG = [
    ([("sum", "10"), ("sum", "20"), ("sum", "15")], ("sum", 45, False)),
    ([("", "30"), ("sum", "10"), ("sum", "20")], ("sum", 60, False)),
    ([("mul", "10"), ("mul", "20"), ("sum", "30"), ("sum", "40")], ("sum", 270, False)),
    ([("mul", "10"), ("mul", "10"), ("mul", "10"), ("sum", "10")], ("sum", 1010, False)),
    ([("non_existing", "1"), ("non_existing", "invalid")], (None, None, True)),
    ([("sum", "invalid"), ("sum", "20")], (None, None, True)),
]


def test_named_aggregates_of_golden_cases(spark):
    for ops, (func, value, failed) in AGG:
        df = spark.createDataFrame([([(i, f, v) for i, (f, v) in enumerate(ops)],)], "ops array<struct<seq:bigint,func:string,value:string>>")
        got = df.select(merges.agg_switch(F.col("ops")).alias("a")).select("a.*").first()
        assert got.failed == failed and (failed or (got.func, got.value) == (func, value))


def test_user_merges_in_python(spark):
    from tidelog.functions.user import python_merge

    rows = golden.random_log(5)
    log = spark.createDataFrame(rows, golden.SCHEMA)

    def rolling(base, operands):
        a = -1 if base is None else base
        for x in operands:
            a = (a * 3 + x) % 1009
        return a

    want = {k: (rolling(v[3], v[2]) if v[2] else v[3]) for k, v in golden.state(rows).items()}
    assert {r.key: r.value for r in python_merge(log, rolling).collect()} == want


def test_latest_and_history(spark):
    rows = [r for r in golden.random_log(9) if r[3] in ("PUT", "DELETE")]
    log = spark.createDataFrame(rows, golden.SCHEMA)
    want = {k: v[0] for k, v in golden.state(rows).items()}
    assert {r.key: r.value for r in latest(log).collect()} == want
    assert live_records(log).count() == len({r[1] for r in rows})
    assert scan.key_versions(log, 2, 4, 5).count() <= 5 and scan.history(log, 100, 500).where("ts < 100 OR ts > 500").count() == 0
    empty = log.limit(0)
    assert resolve(empty).count() == 0 and latest(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_timestamp_queries_read_whole_tables(spark):
    got = QUERIES["get_with_timestamp"](spark, SF).collect()
    assert {(r.key, r.value) for r in got} == {(r.key, r.value) for r in QUERIES["timestamp_asof_read"](spark, SF).collect()} and max(r.key for r in got) > 100
    stamped = QUERIES["batch_timestamps"](spark, SF)
    assert stamped.count() == L.op_events(spark, SF).count() and stamped.groupBy(F.floor(F.col("seq") / 100)).agg(F.countDistinct("ts").alias("n")).where("n > 1").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_plans_have_no_pairs_and_narrow_early(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("get_resolved_full", "delete_range_anti", "merge_with_base", "compact_bottommost", "seek_ge", "seek_for_prev", "reuse_distance", "seq_to_time", "time_to_seq"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
    text = plan(QUERIES["multiget_status"](spark, SF))
    # children are printed below their parents: the log meets the probed keys before any window
    assert "NestedLoop" not in text and text.rindex("asked__") > text.rindex("Window")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,42)]" in plan(QUERIES["get_point"](spark, SF))


def test_many_range_deletions_and_families_agree(spark):
    rows = golden.random_log(77, 300)
    log = spark.createDataFrame([(f"cf{r[0]}{r[2] % 3}", *r[1:]) for r in rows], golden.SCHEMA)
    one = sorted((r.cf, r.key, r.seq) for r in uncovered(log).collect())
    assert one == sorted((r.cf, r.key, r.seq) for r in uncovered(log, few=0).collect())
    tombs = [(r[0] + str(r[2] % 3), r[1], r[5], r[2]) for r in rows if r[3] == "RANGE_DELETE"]
    assert one == sorted((f"cf{r[0]}{r[2] % 3}", r[1], r[2]) for r in rows if r[3] != "RANGE_DELETE" and not any(f"cf{c}" == f"cf{r[0]}{r[2] % 3}" and b <= r[1] < e and s > r[2] for c, b, e, s in tombs))


def test_strings_and_bytes_as_keys_of_range_deletions(spark):
    rows = [("c", "a", 1, "PUT", 1, None), ("c", "ab", 2, "PUT", 2, None), ("c", "b", 3, "PUT", 3, None), ("c", "ab", 4, "RANGE_DELETE", None, "b"), ("c", "ab", 5, "MERGE", 7, None)]
    for kind in ("string", "binary"):
        cast = (lambda x: x) if kind == "string" else (lambda x: None if x is None else bytearray(x.encode()))
        log = spark.createDataFrame([(c, cast(k), s, o, v, cast(e)) for c, k, s, o, v, e in rows], f"cf string, key {kind}, seq bigint, op string, value bigint, end_key {kind}")
        got = {(r.key if kind == "string" else bytes(r.key).decode()): r.value for r in resolve(log).collect()}
        assert got == {"a": 1, "ab": 7, "b": 3}
