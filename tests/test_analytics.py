"""Transactions, statistics, traces and cache simulators against direct computations."""

import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from tidelog.operators import cache, scan, stats, trace, txn
from tidelog.operators.resolve import resolve


def test_conflicts_and_commits(spark):
    log = spark.createDataFrame([("a", 5), ("a", 9), ("b", 3)], "key string, seq bigint")
    writes = spark.createDataFrame([(1, "a", 8), (2, "a", 9), (2, "b", 9), (3, "new", 0)], "txn int, key string, snap_seq bigint")
    assert {(r.txn, r.status, r.n_conflicts) for r in txn.conflicts(writes, log).collect()} == {(1, "Busy", 1), (2, "OK", 0), (3, "OK", 0)}
    prepared = spark.createDataFrame([("t1", "a", 1), ("t2", "b", 2)], "txn_id string, key string, seq bigint")
    commits = spark.createDataFrame([("t1", 10), ("t2", 20)], "txn_id string, commit_seq bigint")
    assert [(r.key, r.seq) for r in txn.committed_at(prepared, commits, 15).collect()] == [("a", 10)]


def test_overlay_and_batches(spark):
    schema = "cf string, key string, op string, value bigint, ts bigint, end_key string"
    log = spark.createDataFrame([("c", "a", "PUT", 1, 0, None), ("c", "b", "PUT", 5, 0, None)], schema).withColumn("seq", F.when(F.col("key") == "a", 1).otherwise(2).cast("bigint"))
    batch = spark.createDataFrame([("c", "a", "MERGE", 10, 0, None), ("c", "b", "DELETE", None, 0, None), ("c", "d", "PUT", 7, 0, None)], schema).withColumn("ordinal", F.when(F.col("key") == "a", 0).when(F.col("key") == "b", 1).otherwise(2).cast("bigint"))
    assert {r.key: r.value for r in resolve(txn.overlay(log, batch)).collect()} == {"a": 11, "d": 7}
    assert {r.key: r.value for r in resolve(txn.overlay(log, txn.rolled_back(batch, 1))).collect()} == {"a": 11, "b": 5}
    n = txn.batch_counts(batch.withColumn("batch_id", F.lit(1)).withColumn("seq", F.col("ordinal"))).first()
    assert (n.n, n.n_puts, n.n_merges, n.n_deletes, n.has_put) == (3, 1, 1, 1, True)


def test_locks(spark):
    rng = random.Random(1)
    held = [(i, a := rng.randrange(50), a + rng.randrange(5)) for i in range(30)]
    wanted = [(100 + i if i % 3 else i, a := rng.randrange(50), a + rng.randrange(5)) for i in range(30)]
    got = {(r.waiter, r.holder) for r in txn.lock_overlaps(spark.createDataFrame(held, "owner int, lo int, hi int"), spark.createDataFrame(wanted, "waiter int, w_lo int, w_hi int")).collect()}
    assert got == {(w, h) for w, c, d in wanted for h, a, b in held if a <= d and c <= b and w != h}
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 7), (8, 8)]
    assert {r.node for r in txn.deadlocked(spark.createDataFrame(edges, "waiter int, holder int")).collect()} == {1, 2, 3}


def test_index_check(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk int, secondary string")
    index = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "pk int, secondary string")
    r = txn.index_check(rows, index).first()
    assert (r.matching, r.missing, r.dangling, r.different) == (1, 1, 1, 1)


@pytest.mark.parametrize("n", [1, 4, 7, 100])
def test_anchors_are_ntiles(spark, n):
    keys = [(i * 31) % 97 for i in range(97)]
    rows = spark.createDataFrame([(k,) for k in keys], "key int")
    order, want, at = sorted(keys), [], 0
    for t in range(min(n, 97)):
        size = 97 // n + (t < 97 % n)
        if size:
            want.append((t + 1, order[at], size))
            at += size
    assert sorted((r.anchor, r.first_key, r.n) for r in stats.key_anchors(rows, n).collect()) == want


def test_histogram_percentiles(spark):
    values = [(v,) for v in range(1, 101)]
    got = {r.percent: r.value for r in stats.histogram(spark.createDataFrame(values, "v bigint"), "v", [50, 100], [10, 50, 100]).collect()}
    assert got == {50: 50.0, 100: 100.0}
    limits = stats.bucket_limits(1 << 20)
    assert limits[:8] == [1, 2, 3, 4, 6, 10, 15, 22] and all(a < b for a, b in zip(limits, limits[1:]))


def test_sequence_times_of_golden_cases(spark):
    pairs = spark.createDataFrame([(10, 500), (20, 600)], "seq bigint, time bigint")
    ask = lambda values, way: [r.answer for r in stats.sequence_times(spark.createDataFrame([(v,) for v in values], "probe bigint").coalesce(1), pairs, way).orderBy("probe").collect()]
    assert ask([10, 11, 20, 21], True) == [None, 500, 500, 600] and ask([499, 500, 599, 600], False) == [None, 10, 10, 20]


def test_output_order_is_checked(spark):
    rows = spark.createDataFrame([("f", 1, "a", 5), ("f", 2, "a", 3), ("f", 3, "b", 9), ("g", 1, "b", 1), ("g", 2, "a", 1)], "file string, position int, key string, seq bigint")
    assert {(r.file, r.n, r.out_of_order) for r in stats.order_check(rows).collect()} == {("f", 3, 0), ("g", 2, 1)}


def test_size_limit_and_coverage(spark):
    rows = spark.createDataFrame([("g", k, 10) for k in range(5)], "grp string, key int, size bigint")
    assert scan.size_limited(rows, 25, group="grp").count() == 3
    t = spark.createDataFrame([("GET", 1)], "type string, key int")
    assert {(r.key, r.accesses) for r in trace.coverage(spark.createDataFrame([(1,), (2,)], "key int"), t).collect()} == {(1, 1), (2, 0)}


TRACE = "type string, key int, seq bigint, access_time bigint, value_size bigint"


def a_trace(seed, n=400, keys=40):
    rng = random.Random(seed)
    return [(rng.choice(["GET", "PUT", "SEEK"]), min(rng.randrange(keys), rng.randrange(keys)), i, i * 10 + rng.randrange(3), rng.randrange(3)) for i in range(n)]


def test_trace_tables(spark):
    rows = a_trace(1)
    t = spark.createDataFrame(rows, TRACE)
    want = Counter((r[0], r[1]) for r in rows)
    got = {(r.type, r.key): (r.accesses, r.successes) for r in trace.key_stats(t).collect()}
    assert got == {k: (n, sum(r[0] != "GET" or r[4] > 0 for r in rows if (r[0], r[1]) == k)) for k, n in want.items()}
    rates = trace.rates(t.where("seq < 50 OR seq > 90"), 100).orderBy("slot").collect()
    assert [r.n for r in rates if 5 <= r.slot <= 8] == [0, 0, 0, 0] or min(r.n for r in rates) == 0
    assert rates[-1].cumulative_keys == len({r[1] for r in rows if r[2] < 50 or r[2] > 90})
    top = Counter(r[1] for r in rows)
    assert [(r.key, r.accesses) for r in trace.hottest(t, 5).collect()] == sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5]
    pairs, gaps, last = Counter(), Counter(), {}
    for kind, key, _, at, _ in rows:
        for other in ("GET", "PUT", "SEEK"):
            if (key, other) in last:
                pairs[other, kind] += 1
                gaps[other, kind] += at - last[key, other]
        last[key, kind] = at
    assert {(r.first_type, r.second_type): (r.n, r.total_gap) for r in trace.correlation(t).collect()} == {k: (n, gaps[k]) for k, n in pairs.items()}


def test_reuse_distances_and_lru(spark):
    rows = a_trace(2, 1500, 60)
    keys = [r[1] for r in rows]
    want = []
    for i, k in enumerate(keys):
        before = [j for j in range(i) if keys[j] == k]
        want.append((i, len(set(keys[before[-1] + 1 : i])) if before else None))
    d = cache.reuse_distances(spark.createDataFrame(rows, TRACE))
    assert sorted((r.seq, r.distance) for r in d.collect()) == want
    curve = {r.capacity: r.hits for r in cache.lru_curve(d, [5, 20, 60]).collect()}
    sim = {(r.policy, r.capacity): r.hits for r in cache.simulate(spark.createDataFrame(rows, TRACE), sorted(cache.POLICIES), [5, 20, 60]).collect()}
    assert curve == {c: sim["lru", c] for c in (5, 20, 60)}
    assert all(sim["opt", c] >= sim[p, c] for p in cache.POLICIES for c in (5, 20, 60))
    assert len({sim[p, 60] for p in cache.POLICIES}) == 1  # all keys fit


def test_policies_step_by_step():
    keys = [1, 2, 3, 1, 4, 1, 2, 5, 1, 2]
    box, hits = OrderedDict(), 0
    for k in keys:
        if k in box:
            hits += 1
            box.move_to_end(k)
        else:
            if len(box) == 3:
                box.popitem(last=False)
            box[k] = 1
    assert cache.POLICIES["lru"](keys, 3) == hits
    assert cache.POLICIES["fifo"]([1, 2, 3, 1, 4, 1], 3) == 1 and cache.POLICIES["lfu"]([1, 1, 2, 3, 4, 1], 2) == 2
    assert cache.POLICIES["opt"]([1, 2, 3, 1, 2, 3], 2) == 2
    for policy in cache.POLICIES.values():
        assert policy([], 3) == 0 and policy([7] * 5, 1) == 4


def test_miss_ratios_have_all_sets(spark):
    t = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", False)], "cf string, caller string, hit boolean")
    got = {(r.cf, r.caller): (r.n, r.misses) for r in cache.miss_ratios(t, ["cf", "caller"]).collect()}
    assert got[None, None] == (3, 2) and got["a", None] == (2, 1) and got[None, "x"] == (2, 1) and got["b", "x"] == (1, 1) and len(got) == 8


def test_a_replay_does_merges_again(spark):
    rows = [("PUT", 1, 1, 10, 5), ("MERGE", 1, 2, 20, 3), ("MERGE", 2, 3, 30, 4), ("DELETE", 1, 4, 40, 0), ("MERGE", 1, 5, 50, 2), ("GET", 3, 6, 60, 1), ("PUT", 4, 7, 70, 1), ("DELETE", 4, 8, 80, 0)]
    log = trace.as_log(spark.createDataFrame(rows, "type string, key bigint, seq bigint, access_time bigint, value_size bigint"))
    assert {(r.key, r.value, r.seq) for r in resolve(log, ranges=False).collect()} == {(1, 2, 5), (2, 4, 3)}


def test_sized_caches():
    import math
    import random

    from tidelog.operators import simulate as S

    rng = random.Random(5)
    keys = [int(rng.paretovariate(0.8)) % 60 for _ in range(1500)]
    sizes = [k % 7 * 10 + 5 for k in keys]
    kinds = ["GET" if k % 3 else "SEEK" for k in keys]
    times = list(range(1500))
    hits = {p: S.run(p, 400, keys, sizes, times, kinds) for p in S.SIZED}

    def plain(order):  # an entry's place in ``order``, looked through at each eviction
        cache, n = {}, 0
        for i, (k, z) in enumerate(zip(keys, sizes)):
            if k in cache:
                n += 1
            else:
                while sum(s for s, *_ in cache.values()) + z > 400:
                    del cache[min(cache, key=lambda x: order(x, *cache[x][1:], i))]
                cache[k] = (z, i, 0, i)
            s, born, used, _ = cache[k]
            cache[k] = (s, born, used + 1, i)
        return n

    assert hits["lru_bytes"] == plain(lambda k, born, used, last, now: last)
    assert hits["mru_bytes"] == plain(lambda k, born, used, last, now: -last)
    assert hits["fifo_bytes"] == plain(lambda k, born, used, last, now: born)
    assert hits["lfu_bytes"] == plain(lambda k, born, used, last, now: (used, last))
    needed = lambda k, now: next((j for j in range(now, 1500) if keys[j] == k), math.inf)
    assert hits["opt_bytes"] == plain(lambda k, born, used, last, now: -needed(k, now))
    assert max(hits.values()) == hits["opt_bytes"] or hits["opt_bytes"] > hits["lru_bytes"]
    again = {p: S.run(p, 400, keys, sizes, times, kinds) for p in S.SIZED}
    assert again == hits and all(0 < n < 1500 for n in hits.values())
    # one that is larger than the budget never enters; a budget that holds all misses first accesses only, but for the ghost's second
    assert S.run("lru_bytes", 10, [1, 1, 1], [50, 50, 50], [0, 1, 2], ["", "", ""]) == 0
    for p in set(S.SIZED) - {"ghost_bytes", "hybrid_bytes"}:
        assert S.run(p, 10**6, keys, sizes, times, kinds) == 1500 - len(set(keys)), p
    assert S.run("ghost_bytes", 10**6, keys, sizes, times, kinds) == sum(max(0, keys.count(k) - 2) for k in set(keys))
    high = S.Priority(100, frozenset({"GET"}), 0.5)
    for k in range(4):
        high.access(S.Access(k, 25, k, "GET" if k < 2 else "SEEK"))
    assert not high.access(S.Access(9, 25, 9, "SEEK")) and set(high.entries) == {0, 1, 3, 9}
    row = S.Hybrid(10**6, 4)
    assert [row.access(S.Access(k, 10, 0)) for k in (1, 2, 1, 8)] == [False, True, True, False]


def test_reuse_distances_of_any_runs(spark):
    import random

    from tidelog.operators import cache

    rng = random.Random(6)
    keys = [rng.randrange(25) for _ in range(400)]
    df = spark.createDataFrame([(k, 3 * i + 7) for i, k in enumerate(keys)], "key bigint, seq bigint")
    want, last = {}, {}
    for i, k in enumerate(keys):
        want[3 * i + 7] = len(set(keys[last[k] + 1 : i])) if k in last else None
        last[k] = i
    for width in (8, 100, 1 << 16):
        assert {r.seq: r.distance for r in cache.reuse_distances(df, width).collect()} == want
    assert cache.reuse_distances(df.limit(0)).count() == 0


def test_running_values_of_hot_keys(spark):
    import random

    from pyspark.sql import functions as F

    from tidelog.operators.skew import running

    rng = random.Random(8)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(4), rng.randrange(300), i, rng.randrange(50) if rng.random() < 0.4 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, t bigint, seq bigint, v int")
    for strictly in (True, False):
        want, last = {}, {}
        for k, t, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
            if not strictly and v is not None:
                last[k] = v
            want[seq] = last.get(k)
            if v is not None:
                last[k] = v
        for spans in (1, 7, 1000):
            assert {r.seq: r.found for r in running(df, "k", ["t", "seq"], {"found": F.col("v")}, strictly, spans).collect()} == want
    assert running(df.limit(0), "k", ["t", "seq"], {"found": F.col("v")}).count() == 0
