"""Structured Streaming forms of change capture, replica catch-up, event-time rates and expiring state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.compact import collect_history
from ..operators.resolve import Fold, live_records, resolve
from ..oplog import RANGE_DELETE


def tail(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The log's folder as an unbounded source; a batch's files become visible together."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Spark's own state store class that holds processors' state, by the name that its configuration takes.
PROCESSOR_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timers: bool = False, processors: bool = False) -> None:
    """Feeds all that is there to ``each`` batch by batch, and stops; a rerun goes on where this ended.

    State with timers of processing time asks for batches without data for ever, so that such a query (``timers``)
    is started with those switched off. State of a user's processors (``processors``) needs the one store of Spark that holds it.
    """
    conf, own = stream.sparkSession.conf, {}
    if timers:
        own["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    if processors:
        own["spark.sql.streaming.stateStore.providerClass"] = PROCESSOR_STORE
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    query.awaitTermination()


def capture(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Change capture to files: each batch writes a folder of its own, so that a repeated batch overwrites itself."""
    run_to_end(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint)


def _replica(spark: SparkSession, out: str) -> tuple[DataFrame | None, int, int, int]:
    """(records, rows of the newest whole version, rows of batches after it, that version) of a replica; -1 where there is none."""
    try:
        rows = spark.read.parquet(out)
    except AnalysisException:  # nothing was written yet
        return None, 0, 0, -1
    sizes = {(r["kind"], r["version"]): r["n"] for r in rows.groupBy("kind", "version").agg(F.count("*").alias("n")).collect()}
    full = max((v for k, v in sizes if k == "full"), default=-1)
    later = F.col("version") > full
    return rows.where(((F.col("kind") == "full") & (F.col("version") == full)) | ((F.col("kind") == "batch") & later)), sizes.get(("full", full), 0), sum(n for (k, v), n in sizes.items() if k == "batch" and v > full), full


def replica(stream: DataFrame, out: str, checkpoint: str, after_each: Callable[[int], None] | None = None) -> None:
    """A secondary's catch-up: each batch writes those of its own records that can still decide a key.

    These are a key's newest base, the operands above it, and all range deletions; batches may come in any order. Once the batches
    since the last whole version hold as many records as it does, all are folded into a new one: a record is rewritten a
    logarithmic number of times.
    """

    def kept(log: DataFrame) -> DataFrame:
        return live_records(log).drop("base_seq").unionByName(log.where(F.col("op") == RANGE_DELETE))

    def apply(df: DataFrame, n: int) -> None:
        if "end_key" not in df.columns:
            df = df.withColumn("end_key", F.lit(None).cast(df.schema["key"].dataType))
        columns = ["cf", "key", "seq", "op", "value", "end_key"]
        kept(df.select(*columns)).write.mode("overwrite").parquet(f"{out}/kind=batch/version={n}")
        rows, whole, later, full = _replica(df.sparkSession, out)
        if full < n and later >= whole:
            kept(rows.select(*columns)).write.mode("overwrite").parquet(f"{out}/kind=full/version={n}")
        if after_each:
            after_each(n)

    run_to_end(stream, apply, checkpoint)


def replica_state(spark: SparkSession, out: str, fold: Fold | None = None) -> DataFrame:
    """Live keys of the replica as far as it has come, merged as ``resolve`` does."""
    return resolve(_replica(spark, out)[0].drop("kind", "version"), fold=fold).select("cf", "key", "value", "seq")


def windowed_rates(stream: DataFrame, time: str, width: str, delay: str, by: list[str] | None = None) -> DataFrame:
    """Accesses in each window of event time; rows later than ``delay`` are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *(by or [])).agg(F.count("*").alias("n"))


def sliding_rates(stream: DataFrame, time: str, width: str, step: str, delay: str, by: list[str] | None = None) -> DataFrame:
    """Accesses in windows of event time that begin every ``step`` and overlap."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, step), *(by or [])).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Accesses of each key with no pause of ``gap`` between them."""
    return stream.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap)).agg(F.count("*").alias("n"))


def trimmed(stream: DataFrame, out: str, checkpoint: str, lag: int, by: str = "ts", every: int = 1) -> None:
    """Versions with garbage collection behind a low watermark: the latest time seen less ``lag``.

    The mark rises with each batch; at the first and then ``every`` so many, only the newest of a key's versions before it stays. A late
    write, from before the mark, is kept until a collection finds a newer one of its key that is before the mark, too.
    """

    def apply(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        log = df if n == 0 else spark.read.parquet(f"{out}/version={n - 1}").unionByName(df)
        top = log.agg(F.max(by)).first()[0]
        (log if top is None or n % every else collect_history(log, top - lag)).write.mode("overwrite").parquet(f"{out}/version={n}")

    run_to_end(stream, apply, checkpoint)


class ExpiringList(StatefulProcessor):
    """Appends a key's elements (ts, value) to a list; elements at its beginning go once they have expired by the newest time of the key."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.elements = handle.getListState("elements", "ts long, value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = list(self.elements.get()) if self.elements.exists() else []
        for p in rows:
            found += list(zip(p["ts"].tolist(), p["value"].tolist()))
        found.sort()
        now = found[-1][0]
        first = next(i for i, (ts, _) in enumerate(found) if ts + self.ttl > now or i == len(found) - 1)
        found = found[first:]
        self.elements.put(found)
        yield pd.DataFrame({"key": [key[0]], "n": [len(found)], "oldest": [found[0][0]], "total": [sum(v for _, v in found)]})

    def close(self) -> None:
        pass


def expiring_lists(stream: DataFrame, ttl: int) -> DataFrame:
    """(key, n, oldest, total) of each key's list after each batch, of rows (key, ts, value). ``run_to_end`` needs ``processors``."""
    return stream.groupBy("key").transformWithStateInPandas(ExpiringList(ttl), "key bigint, n bigint, oldest bigint, total bigint", "update", "none")


class OnlineLru(StatefulProcessor):
    """A simulated cache beside live traffic: its keys, the least recent first, are the state of its capacity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getListState("keys", "key long")
        self.counts = handle.getValueState("counts", "n long, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cache = dict.fromkeys(k for (k,) in self.keys.get()) if self.keys.exists() else {}
        n, hits = self.counts.get() if self.counts.exists() else (0, 0)
        seen = sorted(x for p in rows for x in zip(p["seq"].tolist(), p["key"].tolist()))
        for _, k in seen:
            n += 1
            if k in cache:
                hits += 1
                del cache[k]
            elif len(cache) >= key[0]:
                del cache[next(iter(cache))]
            cache[k] = None
        self.keys.put([(k,) for k in cache])
        self.counts.update((n, hits))
        yield pd.DataFrame({"capacity": [key[0]], "n": [n], "hits": [hits]})

    def close(self) -> None:
        pass


def online_lru(stream: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, n, hits) so far after each batch, of rows (key, seq) that come in order of seq from batch to batch. ``run_to_end`` needs ``processors``."""
    each = stream.select("key", "seq", F.explode(F.lit(capacities).cast("array<bigint>")).alias("capacity"))
    return each.groupBy("capacity").transformWithStateInPandas(OnlineLru(), "capacity bigint, n bigint, hits bigint", "update", "none")


class ExpiringCounter(StatefulProcessor):
    """Counts a key's rows in state that is dropped ``ttl_millis`` after its last update."""

    def __init__(self, ttl_millis: int):
        self.ttl = ttl_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = sum(len(p) for p in rows) + (self.count.get()[0] if self.count.exists() else 0)
        self.count.update((n,))
        yield pd.DataFrame({"key": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def expiring_counts(stream: DataFrame, ttl_millis: int) -> DataFrame:
    """(key, n) after each batch. ``run_to_end`` needs ``processors``."""
    return stream.groupBy("key").transformWithStateInPandas(ExpiringCounter(ttl_millis), "key bigint, n bigint", "update", "processingTime")
