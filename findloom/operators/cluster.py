"""Constrained clustering: merges by confidence, refused between groups with two existing clusters or a separate pair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.operators.components import connected, written

LINEAGE = "by-level@1+by-kind@3+constrained-union@1"


def _greedy(rows: list[tuple]) -> tuple[dict, list[tuple]]:
    """(group root by node, refused merges) of one component's edges (a, b, node_a, node_b, points, verdict)."""
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    apart: dict = {}
    for a, b, na, nb, _, verdict in rows:
        for n in (na, nb):
            find(n)
        if verdict == "separate" and na != nb:
            apart.setdefault(na, set()).add(nb)
            apart.setdefault(nb, set()).add(na)
    held = {n: {n} for n in root}
    anchored = {n: n.startswith("c:") for n in root}
    refused = []
    for a, b, na, nb, _, _ in sorted((r for r in rows if r[5] == "merge"), key=lambda r: (-r[4], r[0], r[1])):
        x, y = find(na), find(nb)
        if x == y:
            continue
        if len(held[x]) < len(held[y]):
            x, y = y, x
        if anchored[x] and anchored[y] or any(z in held[x] for n in held[y] for z in apart.get(n, ())):
            refused.append((a, b))
            continue
        root[y] = x
        held[x] |= held.pop(y)
        anchored[x] |= anchored[y]
    return {n: find(n) for n in root}, refused


#: Conflicted components of up to this many merge and separate edges go to the helper, whole; larger ones are merged in rounds.
WHOLE = 50_000


def _named(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges with the groups of their ends."""
    for end in ("a", "b"):
        edges = edges.join(groups.select(F.col("node").alias(f"node_{end}"), F.col("root").alias(f"root_{end}")), f"node_{end}")
    return edges.where("root_a <> root_b")


def _rounds(edges: DataFrame) -> DataFrame:
    """(node, root) of merge and separate edges between nodes, equal to one merge after another by points, then a and b, as joins.

    Points go level by level. At a level, components of its edges without a separate pair or a second anchor merge at once, as no order can matter in them. In the others an
    edge that is the next one of both its groups is decided, all such edges together: nothing before it can still change either group. A refused pair stays
    refused, since groups only grow.
    """
    merges = written(edges.where("verdict = 'merge'").select("points", "a", "b", "node_a", "node_b"))
    apart = written(edges.where("verdict = 'separate' and node_a <> node_b").select("node_a", "node_b"))
    nodes = edges.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    groups = written(nodes.withColumn("root", F.col("node")))
    for (points,) in merges.select("points").distinct().orderBy(F.desc("points")).collect():  # thousandths: a thousand at most
        left, whole = merges.where(F.col("points") == points), True
        while not (e := written(_named(left, groups))).isEmpty():
            pair = lambda d: d.select(F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y")).distinct()
            blocked = pair(_named(apart, groups)).withColumn("no", F.lit(True))
            held = groups.where("node like 'c:%'").select("root").distinct()
            if whole:
                whole, parts = False, written(connected(e.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
                of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
                inside = blocked.join(of("x"), "x").join(of("y"), "y").where("x_part = y_part").select(F.col("x_part").alias("component"))
                many = parts.join(held, F.col("node") == F.col("root")).groupBy("component").count().where("count > 1").select("component")
                to = parts.join(inside.union(many).distinct(), "component", "left_anti").select(F.col("node").alias("root"), F.col("component").alias("to"))
                left = e.select(*merges.columns)
            else:
                order = F.struct((-F.col("points")).alias("p"), "a", "b")
                best = e.select(F.explode(F.array("root_a", "root_b")).alias("root"), order.alias("key")).groupBy("root").agg(F.min("key").alias("key"))
                first = lambda c: best.select(F.col("root").alias(c), F.col("key").alias(f"{c}_key"))
                next_ = e.join(first("root_a"), "root_a").join(first("root_b"), "root_b").where((order == F.col("root_a_key")) & (order == F.col("root_b_key")))
                next_ = next_.select(F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y"))
                anchor = lambda c: held.select(F.col("root").alias(c), F.lit(True).alias(f"{c}_held"))
                next_ = written(next_.join(blocked, ["x", "y"], "left").join(anchor("x"), "x", "left").join(anchor("y"), "y", "left").withColumn("no", F.coalesce("no", F.col("x_held") & F.col("y_held"), F.lit(False))))
                to = next_.where("not no").select(F.col("y").alias("root"), F.col("x").alias("to"))
                dead = next_.where("no").select("x", "y")
                left = e.withColumns({"x": F.least("root_a", "root_b"), "y": F.greatest("root_a", "root_b")}).join(dead, ["x", "y"], "left_anti").select(*merges.columns)
            groups = written(groups.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return groups


def cluster(findings: DataFrame, edges: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, review) for new findings (finding_id, tenant_id, scope_key), scored edges (a, b, points, verdict, reasons) and members (finding_id, cluster_id).

    Members of one existing cluster act as one node. assignments: finding_id, cluster_id, is_new, seed, points, reasons and other end (partner) of the strongest merge edge whose ends
    finished together (ties by a, then b; none: 1000 and no reasons). review: review pairs and merges whose ends finished apart.
    Components of merge edges without a separate pair or two anchors, however large, are joins. Of the others those of up to WHOLE edges go to the greedy helper, one
    Arrow group each, and larger ones are merged in rounds of joins with the same result. Nothing depends on the order of rows.
    """
    member = existing.select(F.col("finding_id").alias("m"), F.concat(F.lit("c:"), "cluster_id").alias("anchor"))
    def contracted(e: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            e = e.join(member.withColumnRenamed("m", end).withColumnRenamed("anchor", f"anchor_{end}"), end, "left")
            e = e.withColumn(f"node_{end}", F.coalesce(f"anchor_{end}", F.concat(F.lit("f:"), end)))
        return e.drop("anchor_a", "anchor_b")

    e = written(contracted(edges.select("a", "b", "points", "verdict", "reasons")))
    fresh = findings.select("finding_id", "tenant_id", "scope_key").join(existing.select("finding_id"), "finding_id", "left_anti")
    merges = e.where("verdict = 'merge'")
    part = written(connected(merges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))  # a finding without merges is its own group
    with_part = e.join(part.select(F.col("node").alias("node_a"), F.col("component").alias("part_a")), "node_a").join(part.select(F.col("node").alias("node_b"), F.col("component").alias("part_b")), "node_b")
    anchors = part.where("node like 'c:%'").groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    apart = with_part.where("verdict = 'separate' and part_a = part_b and node_a <> node_b").select(F.col("part_a").alias("component"))
    hard = written(anchors.union(apart).distinct())

    def helper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            groups, _ = _greedy(rows)
            return pa.RecordBatch.from_pydict({"node": list(groups), "root": list(groups.values())}, pa.schema([("node", pa.string()), ("root", pa.string())]))

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != at:
                    if rows:
                        yield done()
                    at, rows = c, []
                rows.append(tuple(row))
        if rows:
            yield done()

    inside = with_part.where("part_a = part_b and verdict in ('merge', 'separate')").join(hard, F.col("part_a") == F.col("component"), "left_semi")
    inside = written(inside.select("part_a", "a", "b", "node_a", "node_b", "points", "verdict"))
    large = inside.groupBy("part_a").count().where(F.col("count") > WHOLE).select("part_a")
    rounds = _rounds(written(inside.join(large, "part_a", "left_semi"))) if not large.isEmpty() else None
    solved = inside.join(large, "part_a", "left_anti").repartition("part_a").sortWithinPartitions("part_a").mapInArrow(helper, "node string, root string")
    easy = part.join(hard, "component", "left_anti").select("node", F.col("component").alias("root"))
    groups = easy.unionByName(solved)
    groups = written(groups if rounds is None else groups.unionByName(rounds))

    ref = groups.groupBy("root").agg(F.max(F.when(F.col("node").startswith("c:"), F.substring("node", 3, 1 << 20))).alias("anchor"), F.min(F.when(F.col("node").startswith("f:"), F.substring("node", 3, 1 << 20))).alias("seed"))
    placed = groups.join(ref, "root")
    ends = e.join(groups.select(F.col("node").alias("node_a"), F.col("root").alias("root_a")), "node_a", "left").join(groups.select(F.col("node").alias("node_b"), F.col("root").alias("root_b")), "node_b", "left")
    ends = ends.withColumns({"root_a": F.coalesce("root_a", "node_a"), "root_b": F.coalesce("root_b", "node_b")})
    together = ends.where("verdict = 'merge' and root_a = root_b")
    strongest = F.min(F.struct((-F.col("points")).alias("order"), "a", "b", "points", "reasons")).alias("s")
    best = together.select(F.explode(F.array("a", "b")).alias("finding_id"), "a", "b", "points", "reasons").groupBy("finding_id").agg(strongest)
    new_id = F.sha2(F.concat_ws("/", "tenant_id", "scope_key", "seed"), 256)
    out = fresh.join(placed.where("node like 'f:%'").select(F.substring("node", 3, 1 << 20).alias("finding_id"), "anchor", "seed"), "finding_id", "left").join(best, "finding_id", "left")
    out = out.withColumn("seed", F.coalesce("seed", F.when(F.col("anchor").isNull(), F.col("finding_id"))))
    assignments = out.select(
        "finding_id", "tenant_id", "scope_key", F.coalesce("anchor", new_id).alias("cluster_id"), F.col("anchor").isNull().alias("is_new"), F.when(F.col("anchor").isNull(), F.col("seed")).alias("seed"),
        F.coalesce("s.points", F.lit(1000)).alias("points"), F.coalesce("s.reasons", F.array().cast("array<struct<feature:string,signal:string,points:int>>")).alias("reasons"),
        F.when(F.col("s.a") == F.col("finding_id"), F.col("s.b")).otherwise(F.col("s.a")).alias("partner"),
    )
    review = ends.where("verdict in ('merge', 'review') and root_a <> root_b").select("a", "b", "points", "verdict")
    return assignments, review


def new_tables(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append: clusters (new ones only) and members, with the confidence as decimal(4,3) and reasons as JSON."""
    clusters = assignments.where("is_new").select("cluster_id", "tenant_id", "scope_key", "seed").distinct().withColumn("algo_version", F.lit(LINEAGE))
    members = assignments.select("cluster_id", "finding_id", "tenant_id", (F.col("points") / F.lit(1000)).cast("decimal(4,3)").alias("confidence"), F.to_json("reasons").alias("reasons"), F.lit("algo").alias("decided_by"))
    return clusters, members


def stats(assignments: DataFrame, review: DataFrame) -> DataFrame:
    """One row: clusters created, findings that joined existing ones, review pairs (the sum of `pairs` where rows stand for several)."""
    n = F.coalesce(F.sum("pairs"), F.lit(0)) if "pairs" in review.columns else F.count("*")
    a = assignments.agg(F.count_distinct(F.when(F.col("is_new"), F.col("cluster_id"))).alias("created"), F.count_if(~F.col("is_new")).alias("joined"))
    return a.withColumn("k", F.lit(1)).join(review.agg(n.alias("review")).withColumn("k", F.lit(1)), "k").drop("k")
