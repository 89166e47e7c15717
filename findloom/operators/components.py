"""Connected components with checkpoints, by alternating stars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A node with more neighbours than this, and than a 100,000th of all edges, is a hub: there are at most 100,000, so their smallest neighbours are broadcast.
HUB = 1000
#: Of up to this many edges all smallest neighbours are broadcast, a row of two names for each node.
SMALL = 50_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in spark.checkpoint.dir; a temporary folder only where that's unset and Spark is local."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="findloom-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in spark.checkpoint.dir. For loops: unlike a checkpoint's, its size is known, where estimates of joins of joins would grow without end."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        checkpointed(spark.range(0))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_least(edges: DataFrame, least: Column, hub: int) -> DataFrame:
    """edges (u, v) with m, an aggregate of u's rows; a hub's rows stay where they are."""
    least = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    if not hub:
        return edges.join(F.broadcast(least.drop("n")), "u")
    hubs, others = F.broadcast(least.where(F.col("n") > hub).drop("n")), least.where(F.col("n") <= hub).drop("n")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(others, "u"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component), the component being the smallest node, for every node of edges (a, b); a loop names a node without links.

    Each round links larger neighbours, then smaller ones, to a node's smallest neighbour, until nothing changes; long chains take a logarithmic number.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen, size = None, e.count()
    while True:
        hub = max(HUB, 2 * size // 100_000) if size > SMALL else 0
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.first("u")), hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small = _with_least(large, F.min("v"), hub).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        e = written(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, size = now, now[0]
    roots = e.select("v").union(loops.select("node")).distinct().select(F.col("v").alias("node"))
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots.join(stars, "node", "left_anti").select("node", F.col("node").alias("component")))
