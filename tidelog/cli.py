"""A thin command line over tables of a log: ``python -m tidelog.cli --log PATH COMMAND ...``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import merges
from .operators import scan, stats
from .operators.resolve import of_keys, resolve
from .sources import files


def _typed(spark: SparkSession, log: DataFrame, key: str):
    return F.lit(key).cast(log.schema["key"].dataType)


def _state(log: DataFrame, snapshot: int | None, merge: str | None) -> DataFrame:
    """Numbers add up and texts are appended, unless another merge operator is named."""
    merge = merge or ("stringappend" if log.schema["value"].dataType.simpleString() == "string" else None)
    return resolve(log, snapshot, fold=merges.get(merge) if merge else None)


def dump(log: DataFrame, state: DataFrame, delimiter: str | None, bucket: int | None, start: int = 0, end: int = 0) -> DataFrame:
    """All state; or counts and sizes by the key's part before a delimiter; or counts by bucket of write time."""
    if bucket:
        n = -(-(end - start) // bucket)
        at = F.floor((F.col("write_time") - start) / bucket)
        return log.where((F.col("write_time") >= start) & (F.col("write_time") < end)).groupBy(F.least(at, F.lit(n - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    if delimiter:
        return state.groupBy(F.substring_index(F.col("key").cast("string"), delimiter, 1).alias("prefix")).agg(F.count("*").alias("n"), F.sum(F.length(F.col("value").cast("string"))).alias("bytes"))
    return state.orderBy("key")


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--log", required=True, help="Parquet folder of a log")
    p.add_argument("--snapshot", type=int)
    p.add_argument("--merge", help="a registered merge operator")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("get", "multiget", "approxsize", "scan", "delete", "singledelete", "put", "batchput", "merge", "deleterange", "dump", "idump", "get_property", "checkpoint", "list_file_range_deletes", "dump_wal", "export", "import"):
        c = sub.add_parser(name)
        if name in ("get", "delete", "singledelete", "put", "merge"):
            c.add_argument("key")
        if name in ("put", "merge"):
            c.add_argument("value")
        if name == "multiget":
            c.add_argument("keys", nargs="+")
        if name == "batchput":
            c.add_argument("pairs", nargs="+", help="key value key value ...")
        if name in ("get", "multiget", "scan"):
            c.add_argument("--read-timestamp", type=int)
        if name in ("scan", "approxsize", "deleterange"):
            c.add_argument("--from", dest="lo")
            c.add_argument("--to", dest="hi")
        if name == "scan":
            c.add_argument("--max-keys", type=int)
            c.add_argument("--hex", action="store_true")
            c.add_argument("--start-time", type=int, help="only records written from this second on")
            c.add_argument("--end-time", type=int, help="and before this one")
        if name == "dump":
            c.add_argument("--count-delim")
            c.add_argument("--bucket", type=int)
            c.add_argument("--start", type=int, default=0)
            c.add_argument("--end", type=int, default=0)
        if name in ("checkpoint", "export", "import"):
            c.add_argument("path")
    a = p.parse_args(argv)
    log = spark.read.parquet(a.log)
    seen = log
    if getattr(a, "start_time", None) is not None:
        seen = seen.where(F.col("write_time") >= a.start_time)
    if getattr(a, "end_time", None) is not None:
        seen = seen.where(F.col("write_time") < a.end_time)
    if getattr(a, "read_timestamp", None) is not None:
        seen = seen.where(F.col("ts") <= a.read_timestamp)
    state = lambda: _state(seen, a.snapshot, a.merge)
    if a.command == "multiget":
        keys = spark.createDataFrame([(k,) for k in a.keys], "key string").select(F.col("key").cast(log.schema["key"].dataType))
        return scan.multi_get(_state(of_keys(seen, keys), a.snapshot, a.merge).select("key", "value"), keys)
    if a.command == "export":
        files.dump(state(), a.path)
        return spark.createDataFrame([(state().count(),)], "n bigint")
    if a.command == "get":
        return state().where(F.col("key") == _typed(spark, log, a.key)).select("key", "value")
    if a.command == "scan":
        lo, hi = (None if x is None else _typed(spark, log, x) for x in (a.lo, a.hi))
        rows = scan.scan(state(), lo, hi, limit=a.max_keys).select("key", "value")
        return rows.select(F.hex(F.col("key").cast("string")).alias("key"), F.hex(F.col("value").cast("string")).alias("value")) if a.hex else rows
    if a.command == "approxsize":
        rows = state().where((F.col("key") >= _typed(spark, log, a.lo)) & (F.col("key") < _typed(spark, log, a.hi)))
        return rows.agg(F.count("*").alias("n"), F.sum(F.length(F.col("key").cast("string")) + F.length(F.col("value").cast("string"))).alias("bytes"))
    if a.command == "dump":
        return dump(log, state(), a.count_delim, a.bucket, a.start, a.end)
    if a.command in ("idump", "dump_wal"):
        return log.orderBy("seq") if a.command == "dump_wal" else log.orderBy("key", F.col("seq").desc())
    if a.command == "list_file_range_deletes":
        return log.where("op = 'RANGE_DELETE'").select("key", "end_key", "seq").orderBy("key")
    if a.command == "get_property":
        return stats.properties(log)
    if a.command == "checkpoint":
        return spark.createDataFrame([(files.checkpoint(state(), a.path),)], "seq bigint")
    # writes append records above the newest, all in one file's commit
    top = log.agg(F.max("seq")).first()[0] or 0
    cf = log.select("cf").first()
    if a.command == "import":
        new = files.undump(spark, a.path).withColumn("seq", F.lit(top + 1))
    else:
        op = {"put": "PUT", "batchput": "PUT", "merge": "MERGE", "delete": "DELETE", "singledelete": "SINGLE_DELETE", "deleterange": "RANGE_DELETE"}[a.command]
        if a.command == "batchput":
            if len(a.pairs) % 2:
                raise ValueError("batchput takes a value for each key")
            pairs = list(zip(a.pairs[::2], a.pairs[1::2]))
        else:
            pairs = [(a.lo if a.command == "deleterange" else a.key, getattr(a, "value", None))]
        rows = [(top + 1 + n, op, cf[0] if cf else "default", k, v, getattr(a, "hi", None)) for n, (k, v) in enumerate(pairs)]
        new = spark.createDataFrame(rows, "seq bigint, op string, cf string, key string, value string, end_key string")
    new = new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema.fields))
    new.coalesce(1).write.mode("append").parquet(a.log)
    return new


def main() -> None:
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    run(spark, sys.argv[1:]).show(1000, truncate=False)


if __name__ == "__main__":
    main()
