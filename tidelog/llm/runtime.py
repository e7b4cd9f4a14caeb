"""What the operators share: tables in the shared folder, checked broadcasts, packed exchanges."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidelog.shipping import ship

#: A table of more bytes is never broadcast.
BROADCAST_BYTES = 128 << 20


#: Documents in an Arrow batch, where the session doesn't say: texts are long, and a batch is held in the JVM and in Python.
BATCH_RECORDS = 2000


def prepare(spark: SparkSession) -> None:
    """What a session needs before these operators run in it: the package on its workers, and smaller batches than Spark's default."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_RECORDS)


def prepared(query):
    """A query ``(spark, sf_dir)`` that prepares the session first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def shared(spark: SparkSession) -> str:
    """The folder that all executors see. Only where none is set, as in tests, one is made here."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes beside ``path`` and then takes its place, so that a reader finds the old or the new value."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = at.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What :func:`write_json` wrote last, if anything."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in (path, path + ".new"):
        at = jvm.org.apache.hadoop.fs.Path(name)
        if at.getFileSystem(conf).exists(at):
            return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(name).collect()))
    return None


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame, written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    # the shuffles of this write are of no use once it has ended; without this they stay until the driver collects garbage
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether the table is proven small enough to broadcast: its rows are counted, and the bytes of its texts added up."""
    lengths = [F.sum(F.octet_length(f.name)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    rows, *bytes_ = df.agg(F.count(F.lit(1)), *lengths).first()
    return 16 * rows * len(df.columns) + sum(b or 0 for b in bytes_) <= BROADCAST_BYTES


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join that broadcasts ``right`` only where it is proven small; else Spark shuffles."""
    return left.join(F.broadcast(right) if is_small(right) else right.hint("shuffle_merge"), on, how)


def join_apart(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A shuffled join on a BIGINT, whose right side was aggregated by it.

    Spark can split the hot keys of a join only if both sides come straight from a shuffle. It would take the
    aggregate as it lies; joining by the complement of the key makes it shuffle the small side once more.
    """
    key = F.bitwise_not(F.col(on)).alias("apart__")
    joined = left.withColumn("apart__", key).join(right.withColumn("apart__", key).drop(on).hint("shuffle_merge"), "apart__", how)
    return joined.drop("apart__")


def fold(column: str, m: int):
    """crc32 of the id's text, modulo m."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def routes(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` shuffle partitions a long that Spark's hash partitioning sends there."""
    found = spark.range(0, 24 * parts + 64, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
    out = np.full(parts, -1, np.int64)
    for r in found:
        out[r["to"]] = r["id"]
    at = 24 * parts + 64
    while (out < 0).any():
        more = spark.range(at, at + 24 * parts, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("to")).collect()
        for r in more:
            if out[r["to"]] < 0:
                out[r["to"]] = r["id"]
        at += 24 * parts
    return out


def integer_ids(docs: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a BIGINT for an id, and (the id, ``number__``) in the ids' order; without the latter if ids are whole numbers already."""
    if isinstance(docs.schema[id_column].dataType, IntegralType):
        return docs.withColumn(id_column, F.col(id_column).cast("bigint")), None
    ids = docs.select(id_column).where(F.col(id_column).isNotNull()).distinct().orderBy(id_column)
    ids = written(ids.select(id_column, F.monotonically_increasing_id().alias("number__")), "ids")
    return docs.join(ids, id_column, "left").withColumn(id_column, F.col("number__")).drop("number__"), ids


def own_ids(rows: DataFrame, ids: DataFrame | None, id_column: str, *columns: str) -> DataFrame:
    """Columns that hold numbers of :func:`integer_ids` with the ids in their place."""
    if ids is None:
        return rows
    order = rows.columns
    for c in columns:
        rows = rows.join(ids.select(F.col(id_column).alias("own__"), F.col("number__").alias(c)).hint("shuffle_merge"), c, "left").withColumn(c, F.col("own__")).drop("own__")
    return rows.select(*order)


def task_count(spark: SparkSession, size: int, most: int) -> int:
    """How many tasks get at most ``most`` bytes each of ``size`` evenly dealt ones; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
