"""Sorted tables, ingestion, checkpoints and incremental backups, on any file system that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of codecs and what they are called in Parquet files; bzip2, which those don't know, makes JSON files.
CODECS = {"none": "uncompressed", "snappy": "snappy", "zlib": "gzip", "lz4": "lz4_raw", "lz4hc": "lz4_raw", "zstd": "zstd", "bzip2": None}


def write_sorted(rows: DataFrame, path: str, key: str = "key", files: int | None = None, codec: str = "zstd", bloom: bool = False, prefix: int | None = None) -> None:
    """A table in key order, so that row groups can be skipped by key; with ``prefix``, one folder for each prefix of that length."""
    order = [key] + ([F.col("seq").desc()] if "seq" in rows.columns else [])
    if prefix:
        rows = rows.withColumn("prefix", F.substring(F.col(key).cast("string"), 1, prefix))
    out = (rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)).sortWithinPartitions(*order)
    if codec not in CODECS:
        raise ValueError(f"there is no codec of the name {codec!r}")
    if CODECS[codec] is None:
        out.write.option("compression", codec).json(path)
        return
    writer = out.write.option("compression", CODECS[codec])
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.partitionBy("prefix") if prefix else writer).parquet(path)


def read_sorted(spark: SparkSession, path: str, codec: str = "zstd", schema=None) -> DataFrame:
    """A table of :func:`write_sorted`; ``schema`` is needed for codecs whose files don't keep it."""
    return spark.read.parquet(path) if CODECS[codec] else spark.read.schema(schema).json(path)


def write_hashed(rows: DataFrame, path: str, buckets: int, key: str = "key") -> None:
    """A table for lookups: a folder for each bucket of keys' hashes, in key order. A bucket is one task's, unless it is too large for a file."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)


def read_hashed(spark: SparkSession, path: str, keys: DataFrame, buckets: int, key: str = "key", few: int = 10_000) -> DataFrame:
    """Every key with its value, null if it has none. The buckets of few keys are known when the plan is made, and no others are opened."""
    rows = spark.read.parquet(path)
    asked = keys.select(F.col(key), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"))
    wanted = [r[0] for r in asked.select("bucket").distinct().limit(few + 1).collect()]
    if len(wanted) <= few:
        rows = rows.where(F.col("bucket").isin(*wanted)) if wanted else rows.limit(0)
    return asked.join(rows.withColumn("bucket", F.col("bucket").cast("bigint")), [key, "bucket"], "left").drop("bucket")


def dump(rows: DataFrame, path: str) -> None:
    """Rows (cf, key, value) as lines of text that any version reads, with their types in a line of its own file."""
    types = {c: rows.schema[c].dataType.simpleString() for c in ("cf", "key", "value")}
    rows.select("cf", "key", "value").write.option("compression", "gzip").json(f"{path}/rows")
    _put(rows.sparkSession, f"{path}/TYPES.json", json.dumps(types))


def undump(spark: SparkSession, path: str) -> DataFrame:
    """A log whose puts are the dumped rows."""
    types = _get(spark, f"{path}/TYPES.json")
    rows = spark.read.schema(", ".join(f"{c} {k}" for c, k in types.items())).json(f"{path}/rows")
    return rows.select("*", F.lit(0).cast("bigint").alias("seq"), F.lit("PUT").alias("op"), F.lit(None).cast("bigint").alias("ts"))


def ingest(log: DataFrame, rows: DataFrame, keep_seq: bool = False) -> DataFrame:
    """External rows become newer than the log: all get one number above its newest, unless they have their own."""
    if not keep_seq:
        top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top__"))
        rows = rows.drop("seq").crossJoin(F.broadcast(top)).withColumn("seq", F.col("top__") + 1).drop("top__")  # one row
    return log.unionByName(rows, allowMissingColumns=True)


def ingest_behind(log: DataFrame, rows: DataFrame) -> DataFrame:
    """External rows get number 0; keys that the log has already are left out."""
    return log.unionByName(rows.join(log.select("cf", "key").distinct(), ["cf", "key"], "left_anti").withColumn("seq", F.lit(0).cast("bigint")), allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of the data files of a table."""
    fs, at = _fs(spark, path)
    found = fs.listFiles(at, True)
    out = []
    while found.hasNext():
        s = found.next()
        name = s.getPath().getName()
        if name[0] not in "_.":
            out.append((name, s.getLen(), s.getModificationTime()))
    return sorted(out)


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))


def checkpoint(state: DataFrame, path: str) -> int:
    """Writes state, and the newest sequence number in it to a manifest; gives the number."""
    spark = state.sparkSession
    write_sorted(state, f"{path}/data")
    seq = spark.read.parquet(f"{path}/data").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    _put(spark, f"{path}/MANIFEST.json", json.dumps({"seq": seq, "files": [x[:2] for x in listing(spark, f"{path}/data")]}))
    return seq


def open_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/data"), _get(spark, f"{path}/MANIFEST.json")["seq"]


class Backups:
    """Incremental backups of a table folder: files are copied once and shared by the backups that name them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifests(self) -> dict[int, list[list]]:
        fs, at = _fs(self.spark, f"{self.path}/meta")
        if not fs.exists(at):
            return {}
        return {int(s.getPath().getName().removesuffix(".json")): _get(self.spark, s.getPath().toString())["files"] for s in fs.listStatus(at)}

    def create(self, table: str) -> tuple[int, int]:
        """(id, files copied): those that no earlier backup holds."""
        done = self._manifests()
        have = {tuple(f) for files in done.values() for f in files}
        files = [x[:2] for x in listing(self.spark, table)]
        new = [f for f in files if f not in have]
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name, _ in new:
            (a, x), (b, y) = _fs(self.spark, f"{table}/{name}"), _fs(self.spark, f"{self.path}/shared/{name}")
            util.copy(a, x, b, y, False, True, conf)
        number = max(done, default=0) + 1
        _put(self.spark, f"{self.path}/meta/{number}.json", json.dumps({"files": files}))
        return number, len(new)

    def list(self) -> list[int]:
        return sorted(self._manifests())

    def restore(self, number: int) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/shared/{name}" for name, _ in self._manifests()[number]))

    def verify(self, number: int) -> bool:
        have = {x[:2] for x in listing(self.spark, f"{self.path}/shared")}
        return all(tuple(f) in have for f in self._manifests()[number])

    def purge(self, keep: int) -> int:
        """Drops all but the newest backups, then files that none names; gives how many files went."""
        done = self._manifests()
        fs, _ = _fs(self.spark, self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for number in sorted(done)[:-keep] if keep else sorted(done):
            fs.delete(path(f"{self.path}/meta/{number}.json"), False)
            del done[number]
        named = {f[0] for files in done.values() for f in files}
        gone = [x[0] for x in listing(self.spark, f"{self.path}/shared") if x[0] not in named]
        for name in gone:
            fs.delete(path(f"{self.path}/shared/{name}"), False)
        return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def read_chosen(spark: SparkSession, path: str, wanted: Callable[[str], bool]) -> DataFrame:
    """A table without the data files that a callback, which is given each one's path, rejects: they aren't opened."""
    fs, at = _fs(spark, path)
    found, chosen = fs.listFiles(at, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.rsplit("/", 1)[1][0] not in "_." and wanted(name):
            chosen.append(name)
    return spark.read.option("basePath", path).parquet(*chosen) if chosen else spark.read.parquet(path).limit(0)


def file_catalog(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """(file, folder, n, smallest_key, largest_key): live-file metadata from the rows' own file names."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("at"), key)
    each = rows.groupBy("at").agg(F.count("*").alias("n"), F.min(key).alias("smallest_key"), F.max(key).alias("largest_key"))
    return each.select(F.substring_index("at", "/", -1).alias("file"), F.substring_index("at", "/", -2).alias("folder"), "n", "smallest_key", "largest_key")


def checksums(rows: DataFrame, by: str, record: Column | None = None) -> DataFrame:
    """(by, n, checksum): a checksum of each group's rows that doesn't depend on their order, of ``record`` if given, else of all columns.

    60 bits of an MD5 digest of each record, combined by exclusive or.
    """
    if record is None:
        record = F.concat_ws("\x00", *(F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(rows.columns) if c != by))
    digest = F.conv(F.substring(F.md5(record.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.bit_xor(digest).alias("checksum"))
