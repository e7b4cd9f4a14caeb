"""A log that is written to: batches become visible as a whole, and compaction replaces files.

A table is a folder of data folders, one for each batch, and of numbered commits, small JSON files that say which data folders
came and went. A commit is one file that is created only if its number is free, so that a batch is there for
readers or it isn't; what an unfinished write left behind is in no commit. Readers of an older commit keep their files until
:meth:`LogTable.vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..oplog import DELETE, ENTITY, LOG_DATA, MERGE, PUT, RANGE_DELETE, SINGLE_DELETE
from ..operators.compact import rewrite
from ..operators.resolve import Fold, resolve
from .files import _fs

DEFAULT = "default"


class WriteBatch:
    """Records that are written together, in order; savepoints go back to an earlier count."""

    def __init__(self) -> None:
        self.records: list[dict[str, Any]] = []
        self._marks: list[int] = []

    def _add(self, op: str, key: Any = None, cf: str = DEFAULT, **more: Any) -> WriteBatch:
        self.records.append({"op": op, "key": key, "cf": cf} | more)
        return self

    def put(self, key: Any, value: Any, cf: str = DEFAULT) -> WriteBatch:
        return self._add(PUT, key, cf, value=value)

    def timed_put(self, key: Any, value: Any, write_time: int, cf: str = DEFAULT) -> WriteBatch:
        """A put that counts as written at a time of the caller's, in seconds: expiry and tiers go by it."""
        return self._add(PUT, key, cf, value=value, write_time=write_time)

    def put_entity(self, key: Any, cols: dict[str, str], cf: str = DEFAULT) -> WriteBatch:
        return self._add(ENTITY, key, cf, cols=cols)

    def merge(self, key: Any, value: Any, cf: str = DEFAULT) -> WriteBatch:
        return self._add(MERGE, key, cf, value=value)

    def delete(self, key: Any, cf: str = DEFAULT) -> WriteBatch:
        return self._add(DELETE, key, cf)

    def single_delete(self, key: Any, cf: str = DEFAULT) -> WriteBatch:
        return self._add(SINGLE_DELETE, key, cf)

    def delete_range(self, begin: Any, end: Any, cf: str = DEFAULT) -> WriteBatch:
        return self._add(RANGE_DELETE, begin, cf, end_key=end)

    def log_data(self, note: str) -> WriteBatch:
        """A note that only the log holds: reads of state don't see it, and it takes no sequence number's place in any key."""
        return self._add(LOG_DATA, note=note)

    def set_savepoint(self) -> None:
        self._marks.append(len(self.records))

    def rollback(self) -> None:
        """To the newest savepoint, which goes, too."""
        if not self._marks:
            raise ValueError("there is no savepoint")
        del self.records[self._marks.pop() :]

    def visit(self, handler: Callable[[dict[str, Any]], bool | None]) -> None:
        """Gives each record to the handler, in order, until it returns False."""
        for r in self.records:
            if handler(r) is False:
                break

    def stamp(self, ts: int) -> WriteBatch:
        """Gives all records one timestamp."""
        for r in self.records:
            r["ts"] = ts
        return self

    def __len__(self) -> int:
        return sum(r["op"] != LOG_DATA for r in self.records)


class LogTable:
    """A table of (cf, key, seq, op, value, cols, end_key, ts, write_time, note)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.listeners: list[Callable[[str, dict], None]] = []
        fs, at = _fs(spark, f"{self.path}/commits/{0:012}.json")
        if not fs.exists(at):
            raise ValueError(f"there is no table in {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str = "bigint", value: str = "bigint", families: Iterable[str] = (DEFAULT,)) -> LogTable:
        _commit(spark, f"{path.rstrip('/')}/commits/{0:012}.json", {"key": key, "value": value, "families": {f: -1 for f in families}, "add": [], "remove": [], "top": 0})
        return cls(spark, path)

    # --- commits

    def commits(self) -> list[dict]:
        fs, at = _fs(self.spark, f"{self.path}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        found = {r[0].rsplit("/", 1)[-1]: json.loads(r[1]) for r in self.spark.read.option("wholetext", "true").text(f"{self.path}/commits").select(F.col("_metadata.file_path"), "value").collect()}
        return [found[n] for n in names if n in found]

    def state(self, version: int | None = None) -> dict:
        """(version, schema, live data folders by name, families with the number after which each counts, newest number)."""
        out: dict = {"files": {}, "families": {}}
        for n, c in enumerate(self.commits()):
            if version is not None and n > version:
                break
            for name in c["remove"]:
                out["files"].pop(name, None)
            for name, about in c["add"]:
                out["files"][name] = about
            for f, since in c["families"].items():
                if since is None:
                    out["families"].pop(f, None)
                else:
                    out["families"][f] = since
            out |= {"version": n, "top": max(out.get("top", 0), c["top"]), "key": c.get("key", out.get("key")), "value": c.get("value", out.get("value"))}
        return out

    def _do(self, event: str, change: Callable[[dict], dict], tries: int = 20) -> dict:
        """Commits ``change(state)`` under the next number; another writer's commit in between makes it try again on the new state."""
        for _ in range(tries):
            state = self.state()
            entry = {"add": [], "remove": [], "families": {}, "top": state["top"]} | change(state)
            try:
                _commit(self.spark, f"{self.path}/commits/{state['version'] + 1:012}.json", entry)
            except FileExistsError:
                continue
            for listener in self.listeners:
                listener(event, entry)
            return entry
        raise RuntimeError("other writers were faster each time")

    def _schema(self, state: dict) -> str:
        return f"cf string, key {state['key']}, seq bigint, op string, value {state['value']}, cols map<string,string>, end_key {state['key']}, ts bigint, write_time bigint, note string"

    # --- column families

    def create_family(self, name: str) -> None:
        def change(state: dict) -> dict:
            if name in state["families"]:
                raise ValueError(f"family {name!r} is there already")
            return {"families": {name: state["top"]}}

        self._do("family_created", change)

    def drop_family(self, name: str) -> None:
        """Its records are no longer read, not even by a family made anew under its name."""
        self._do("family_dropped", lambda state: {"families": {name: None}})

    def families(self) -> list[str]:
        return sorted(self.state()["families"])

    # --- writing

    def write(self, batch: WriteBatch | DataFrame, write_time: int | None = None) -> tuple[int, int]:
        """(first, last) number of a batch's records, which become visible together.

        A DataFrame has (key, op, ordinal) and any other columns of the log; the ordinal, from 0, is a record's place in the batch.
        """
        state = self.state()
        now = int(time.time()) if write_time is None else write_time
        if isinstance(batch, WriteBatch):
            names = ["cf", "key", "op", "value", "cols", "end_key", "ts", "write_time", "note"]
            rows, n = [], 0
            for r in batch.records:
                rows.append((*(r.get(c) for c in names), n))
                n += r["op"] != LOG_DATA
            kinds = {"key": state["key"], "end_key": state["key"], "value": state["value"], "cols": "map<string,string>", "ts": "bigint", "write_time": "bigint"}
            df = self.spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + ", ordinal bigint")
        else:
            df = batch
            for c, kind in (("cf", "string"), ("value", state["value"]), ("cols", "map<string,string>"), ("end_key", state["key"]), ("ts", "bigint"), ("write_time", "bigint"), ("note", "string")):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(DEFAULT if c == "cf" else None).cast(kind))
        df = df.withColumn("write_time", F.coalesce("write_time", F.lit(now)))
        name = f"batch-{uuid.uuid4().hex}"
        # ordinals are written; the numbers follow from the batch's first, which its commit decides
        df.select("cf", "key", F.col("ordinal").cast("bigint").alias("seq"), "op", "value", "cols", "end_key", "ts", "write_time", "note").write.parquet(f"{self.path}/data/{name}")
        back = self.spark.read.schema(self._schema(state)).parquet(f"{self.path}/data/{name}")
        about = back.agg(F.count("*").alias("rows"), F.coalesce(F.max("seq"), F.lit(-1)).alias("last"), F.collect_set("cf").alias("cf")).first()
        unknown = set(about["cf"]) - set(state["families"])
        if unknown:
            raise ValueError(f"there is no family {sorted(unknown)[0]!r}")
        entry = self._do("batch_written", lambda s: {"add": [[name, {"from": s["top"] + 1, "rows": about["rows"]}]], "top": s["top"] + 1 + about["last"]})
        return entry["add"][0][1]["from"], entry["top"]

    # --- reading

    def read(self, snapshot: int | None = None, version: int | None = None, files: list[str] | None = None) -> DataFrame:
        """The committed records, of live families; ``files`` names some of the data folders."""
        state = self.state(version)
        out = self.spark.createDataFrame([], self._schema(state))
        for name, about in state["files"].items():
            if files is None or name in files:
                rows = self.spark.read.schema(self._schema(state)).parquet(f"{self.path}/data/{name}")
                out = out.unionByName(rows.withColumn("seq", F.col("seq") + about["from"]))
        live = F.lit(False)
        for f, since in state["families"].items():
            live = live | ((F.col("cf") == f) & ((F.col("seq") > since) | F.lit(since <= 0)))
        out = out.where(live)
        return out if snapshot is None else out.where(F.col("seq") <= snapshot)

    def get(self, snapshot: int | None = None, fold: Fold | None = None) -> DataFrame:
        """The state of all keys."""
        return resolve(self.read(), snapshot, fold=fold)

    def latest(self) -> int:
        return self.state()["top"]

    def file_properties(self) -> DataFrame:
        """(file, bytes, cf, n, deletes, smallest_key, largest_key, first_seq, last_seq) of each data file, from the files themselves."""
        state = self.state()
        out = None
        for name, about in state["files"].items():
            rows = self.spark.read.schema(self._schema(state)).parquet(f"{self.path}/data/{name}")
            one = rows.select(F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.file_size").alias("bytes"), "cf", "key", "op", (F.col("seq") + about["from"]).alias("seq"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], f"file string, bytes bigint, cf string, n bigint, deletes bigint, smallest_key {state['key']}, largest_key {state['key']}, first_seq bigint, last_seq bigint")
        deletes = F.count_if(F.col("op").isin(DELETE, SINGLE_DELETE, RANGE_DELETE))
        return out.groupBy("file", "bytes", "cf").agg(F.count("*").alias("n"), deletes.alias("deletes"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def properties(self) -> dict[str, int]:
        """Counts by name, as an operator's dashboard asks for them."""
        state, files = self.state(), self.file_properties()
        kinds = {r["op"]: r["n"] for r in self.read().groupBy("op").agg(F.count("*").alias("n")).collect()}
        about = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("file").alias("files")).first()
        size = files.select("file", "bytes").distinct().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        live = self.get()
        return {
            "num-entries": about["n"], "num-files": about["files"], "total-file-size": size, "num-deletes": kinds.get(DELETE, 0) + kinds.get(SINGLE_DELETE, 0), "num-range-deletes": kinds.get(RANGE_DELETE, 0), "num-merges": kinds.get(MERGE, 0),
            "num-puts": kinds.get(PUT, 0), "num-entities": kinds.get(ENTITY, 0), "num-live-keys": live.count(), "estimate-num-keys": kinds.get(PUT, 0) + kinds.get(ENTITY, 0) - kinds.get(DELETE, 0), "latest-sequence-number": state["top"],
            "num-column-families": len(state["families"]), "num-batches": len(state["files"]), "num-commits": state["version"] + 1, "num-log-notes": kinds.get(LOG_DATA, 0),
        }

    # --- compaction

    def compact_range(self, begin: Any = None, end: Any = None, snapshots: list[int] | None = None, cf: str | None = None) -> dict:
        """Rewrites the stored records of keys in [begin, end) (null: no bound); others go along as they are. All files are read, so that range is at its bottommost level.

        Range deletions stay where they reach beyond the range.
        """
        inside = F.lit(True) if cf is None else F.col("cf") == cf
        if begin is not None:
            inside = inside & (F.col("key") >= F.lit(begin))
        if end is not None:
            inside = inside & (F.col("key") < F.lit(end))
        whole = begin is None and end is None and cf is None
        return self._compact(None, inside, snapshots, whole)

    def compact_files(self, names: list[str], snapshots: list[int] | None = None) -> dict:
        """Rewrites the records of the named data folders into one; older ones may lie elsewhere, so that deletions stay."""
        return self._compact(names, F.lit(True), snapshots, False)

    def _compact(self, names: list[str] | None, inside, snapshots: list[int] | None, bottommost: bool) -> dict:
        state = self.state()
        chosen = list(state["files"]) if names is None else names
        missing = [n for n in chosen if n not in state["files"]]
        if missing:
            raise ValueError(f"there is no data folder {missing[0]!r}")
        log = self.read(version=state["version"], files=chosen)
        dropped = inside & (F.col("op") != LOG_DATA)
        # a range deletion hides points of the range from outside it, too: all of them take part
        part = log.where(dropped | (F.col("op") == RANGE_DELETE))
        new = rewrite(part, snapshots, bottommost).where(F.col("op") != RANGE_DELETE) if not bottommost else rewrite(part, snapshots, True)
        rest = log.where(~dropped) if bottommost else log.where(~dropped | (F.col("op") == RANGE_DELETE))
        out = new.unionByName(rest, allowMissingColumns=True)
        name = f"compacted-{uuid.uuid4().hex}"
        out.select("cf", "key", "seq", "op", "value", "cols", "end_key", "ts", "write_time", "note").write.parquet(f"{self.path}/data/{name}")
        n = self.spark.read.schema(self._schema(state)).parquet(f"{self.path}/data/{name}").count()

        def change(now: dict) -> dict:
            if any(c not in now["files"] for c in chosen):
                raise RuntimeError("another compaction took some of these files")
            return {"remove": chosen, "add": [[name, {"from": 0, "rows": n}]]}

        return self._do("compacted", change)

    def vacuum(self) -> list[str]:
        """Deletes data folders that the newest commit doesn't name: those that were replaced, and those of writes that never ended."""
        keep = set(self.state()["files"])
        fs, at = _fs(self.spark, f"{self.path}/data")
        gone = []
        if fs.exists(at):
            for s in fs.listStatus(at):
                if s.getPath().getName() not in keep:
                    fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return sorted(gone)


class TableIterator:
    """State as of one number, in key order; :meth:`refresh` moves it to the newest."""

    def __init__(self, table: LogTable, lower: Any = None, upper: Any = None):
        self.table, self.lower, self.upper = table, lower, upper
        self.refresh()

    def refresh(self, snapshot: int | None = None) -> TableIterator:
        self.version, self.snapshot = self.table.state()["version"], self.table.latest() if snapshot is None else snapshot
        return self

    def rows(self, reverse: bool = False) -> DataFrame:
        from ..operators.scan import scan

        return scan(resolve(self.table.read(self.snapshot, self.version)), self.lower, self.upper, reverse)


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    """A file that is created only if its name is free."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # the JVM's own kind differs between file systems
        if fs.exists(at):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
