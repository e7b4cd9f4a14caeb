"""Writes, column families, stored compaction and iterators of tables."""

import random

import pytest

from tests.golden import state
from tidelog.sources.table import LogTable, TableIterator, WriteBatch


def values(df):
    return {(r.cf, r.key): r.value for r in df.collect()}


def test_batches_are_atomic_and_ordered(spark, tmp_path):
    t = LogTable.create(spark, str(tmp_path / "t"))
    heard = []
    t.listeners.append(lambda event, entry: heard.append(event))
    assert t.write(WriteBatch().put(1, 10).merge(1, 5).log_data("hello").put(2, 7)) == (1, 3)
    with pytest.raises(ValueError):
        t.write(WriteBatch().put(1, 99, cf="nowhere"))  # left in no commit
    assert t.write(WriteBatch().delete(2).put(3, 1).single_delete(3).delete_range(1, 2).merge(1, 4)) == (4, 8)
    assert values(t.get()) == {("default", 1): 4}
    assert values(t.get(snapshot=3)) == {("default", 1): 15, ("default", 2): 7}
    assert heard == ["batch_written"] * 2 and t.latest() == 8
    assert [r.note for r in t.read().where("op = 'LOG_DATA'").collect()] == ["hello"]
    b = WriteBatch().put(1, 1)
    b.set_savepoint()
    b.put(2, 2).put(3, 3)
    seen = []
    b.visit(lambda r: seen.append(r["key"]) or len(seen) < 2)
    b.rollback()
    assert seen == [1, 2] and len(b) == 1
    with pytest.raises(ValueError):
        b.rollback()
    t.write(WriteBatch().timed_put(9, 9, 1234).put_entity(8, {"": "x", "a": "1"}).stamp(77), write_time=5000)
    assert {r.key: (r.write_time, r.ts) for r in t.read().where("key >= 8").collect()} == {9: (1234, 77), 8: (5000, 77)}
    assert t.read().where("key = 8").first().cols == {"": "x", "a": "1"}
    assert len(t.vacuum()) == 1 and values(t.get(snapshot=8)) == {("default", 1): 4}


def test_another_writer_in_between(spark, tmp_path):
    t = LogTable.create(spark, str(tmp_path / "t"))
    real, calls = t.state, []

    def slow(version=None):
        s = real(version)
        if len(calls) == 1:
            LogTable(spark, t.path).write(WriteBatch().put(5, 5))
        calls.append(1)
        return s

    t.state = slow
    assert t.write(WriteBatch().put(6, 6)) == (2, 2)
    assert values(t.get()) == {("default", 5): 5, ("default", 6): 6}


def test_families(spark, tmp_path):
    t = LogTable.create(spark, str(tmp_path / "t"), families=("a", "b"))
    t.write(WriteBatch().put(1, 1, "a").put(1, 2, "b"))
    t.drop_family("a")
    assert t.families() == ["b"] and values(t.get()) == {("b", 1): 2}
    t.create_family("a")
    with pytest.raises(ValueError):
        t.create_family("a")
    assert values(t.get()) == {("b", 1): 2}
    t.write(WriteBatch().put(7, 3, "a"))
    assert values(t.get()) == {("b", 1): 2, ("a", 7): 3}


def test_stored_compaction_keeps_what_is_read(spark, tmp_path):
    rng = random.Random(3)
    t = LogTable.create(spark, str(tmp_path / "t"))
    rows, seq = [], 0
    for _ in range(5):
        b = WriteBatch()
        for _ in range(50):
            k, v, op = rng.randrange(12), rng.randrange(100), rng.random()
            seq += 1
            if op < 0.1:
                b.delete_range(k, k + 3)
                rows.append(("c", k, seq, "RANGE_DELETE", None, k + 3, seq))
            elif op < 0.2:
                b.delete(k)
                rows.append(("c", k, seq, "DELETE", None, None, seq))
            else:
                kind = "PUT" if op < 0.5 else "MERGE"
                (b.put if kind == "PUT" else b.merge)(k, v)
                rows.append(("c", k, seq, kind, v, None, seq))
        t.write(b)
    snapshots = [60, 130, 250]
    want = {s: {k: v[0] for k, v in state(rows, snapshot=s).items()} for s in snapshots}
    check = lambda: {s: {r.key: r.value for r in t.get(snapshot=s).collect()} for s in snapshots}
    assert check() == want
    before = t.read().count()
    files = list(t.state()["files"])
    t.compact_files(files[1:3], snapshots)
    assert check() == want and t.read().count() < before and len(t.state()["files"]) == 4
    t.compact_range(2, 7, snapshots)
    assert check() == want and len(t.state()["files"]) == 1
    t.compact_range(snapshots=snapshots)
    assert check() == want
    t.compact_range()
    assert {r.key: r.value for r in t.get().collect()} == want[250] and t.read().count() == len(want[250])
    p = t.properties()
    assert p["num-entries"] == p["num-live-keys"] == len(want[250]) and p["num-files"] >= 1 and p["latest-sequence-number"] == seq
    with pytest.raises(ValueError):
        t.compact_files(["none"])


def test_iterators_refresh(spark, tmp_path):
    t = LogTable.create(spark, str(tmp_path / "t"), key="string")
    t.write(WriteBatch().put("b", 1).put("a", 2).put("c", 3))
    it = TableIterator(t, lower="a", upper="c")
    t.write(WriteBatch().put("aa", 4).delete("a"))
    assert [(r.key, r.value) for r in it.rows().collect()] == [("a", 2), ("b", 1)]
    assert [(r.key, r.value) for r in it.refresh().rows(reverse=True).collect()] == [("b", 1), ("aa", 4)]
    t.compact_range()
    assert [r.key for r in it.rows().collect()] == ["aa", "b"]
