"""Connected components of an edge table, by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import saved


#: A node with more neighbours than this, and than a 100,000th of all edges, is a hub: there are at most 100,000, so their smallest neighbours are broadcast.
HUB = 1000
#: Of up to this many edges all smallest neighbours are broadcast, a row of two numbers for each node.
SMALL = 200_000


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """One step over edges (u > v): large links a node's larger neighbours to its smallest one, small its smaller neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = F.least(F.min("v"), F.first("u")) if large else F.min("v")
    least = both.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    if hub:
        hubs, others = F.broadcast(least.where(F.col("n") > hub).drop("n")), least.where(F.col("n") <= hub).drop("n")
        near = both.join(hubs, "u").unionByName(both.join(hubs, "u", "left_anti").join(others, "u"))
    else:
        near = both.join(F.broadcast(least.drop("n")), "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") > F.col("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, the component being its smallest node.

    Loops, repeated edges and either direction are fine, as are nulls, which are dropped; no edges give no rows. Every round is written to the
    shared folder; a node with many neighbours is never a list: its edges stay where they are and its smallest neighbour comes to them.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, state = saved(e, "edges"), None
    size = e.count()
    while True:
        hub = max(HUB, 2 * size // 100_000) if size > SMALL else 0
        e = saved(_star(_star(e, True, hub), False, hub).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, size = now, now[0]
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
