"""Connected components of a table of links, in rounds of large and small stars.

Every round is an aggregation by node and a join on it, which Spark can split where a node is
hot; no group of links is gathered. Rounds end when a round changes nothing, and grow
with the logarithm of a component's size. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_path, join_apart, stage_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to the smallest of its neighbourhood."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = join_apart(both, least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the component is its smallest node."""
    spark = links.sparkSession
    edges = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    before, old = None, None
    while True:
        path = stage_path(spark, "stars")
        _star(_star(edges, True), False).write.parquet(path)
        edges = spark.read.schema("a bigint, b bigint").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            drop_path(spark, old)
        old = path
        if tuple(now) == before:
            break
        before = tuple(now)
    # every link now goes from a node to its component's smallest node
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
