"""Hard-negative mining: stored angles to reference directions bound every score; only rows whose bounds overlap an anchor's window get integer scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findloom.llm.common import saved, table
from findloom.llm.vectors import _groups

#: Reference directions for each length of vectors: a documented sample, by hash, of so many rows. They only decide how tight the bounds are.
REFERENCES = 12
#: Rows of a block, which a task holds while anchors stream past it, and anchors that are bounded at once.
BLOCK, BATCH = 8192, 64
#: Tables with more different lengths of vectors than this are refused, as each length has references of its own.
MOST_DIMS = 1000
#: What angles and scores are widened by: cosines of doubles are good to 1e-13 here, so angles are to 5e-7.
ANGLE, SCORE = 2e-6, 1e-9
#: No bound of a window.
FREE = (1 << 63) - 1

VISIT = "anchor long, key int, score long, row long, id long"


def _angles(x: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to unit references; a right angle for rows of norm 0, whose scores are 0 anyway."""
    cos = (x @ refs.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def bounds(angles_a: np.ndarray, norms_a: np.ndarray, angles_b: np.ndarray, norms_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) integer score of each pair. Two vectors at angles s and t to one direction are between |s - t| and min(s + t, 2 pi - s - t) apart;
    the tightest of all references gives the cosines, the norms make them scores, and all are rounded outwards."""
    near, far = np.zeros((len(angles_a), len(angles_b))), np.full((len(angles_a), len(angles_b)), np.pi)
    for k in range(angles_a.shape[1]):
        s, t = angles_a[:, k][:, None], angles_b[:, k][None, :]
        np.maximum(near, np.abs(s - t), out=near)
        np.minimum(far, np.minimum(s + t, 2 * np.pi - s - t), out=far)
    size = norms_a[:, None] * norms_b[None, :]
    slack = 1 + size * SCORE
    most = np.floor(size * np.cos(np.maximum(near - ANGLE, 0)) + slack)
    least = np.ceil(size * np.cos(np.minimum(far + ANGLE, np.pi)) - slack)
    return least, most


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where these hold every sum, else in integers."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, relabel: Column | None = None) -> DataFrame:
    """(row, vec_id, label, dim, ints, norm, angles, home, block) of the rows that take part, written to the shared folder.

    ints are floor(scale * x) with x as a double. A row's home is the reference at the least angle; a home's rows are dealt to blocks of about BLOCK rows by hash, so that a vector
    that a third of all rows share fills many blocks. `label` is the given column or relabel's value.
    """
    spark, x = vectors.sparkSession, F.col("vector")
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), (F.col(f"`{label}`") if relabel is None else relabel).alias("own"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("own").isNotNull() & F.coalesce(fine, F.lit(False)))
    reach = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.pow(F.abs(e) * scale + 1, F.lit(2.0)))
    most = v.agg(F.max(reach)).first()[0]
    if most is not None and most >= 2.0**63:
        raise ValueError("scores of these vectors don't fit 64 bits")
    v = v.withColumn("ints", F.transform(x, lambda e: F.floor(e * scale))).withColumn("dim", F.size("ints")).drop("vector")
    v = v.withColumn("norm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))
    rows = saved(v.withColumn("row", F.monotonically_increasing_id()), "ints")

    dims = [r[0] for r in rows.select("dim").distinct().limit(MOST_DIMS + 1).collect()]
    if len(dims) > MOST_DIMS:
        raise ValueError(f"vectors have more than {MOST_DIMS} different lengths")
    spot = F.struct(F.xxhash64("ints").alias("spot"), "ints")
    few = rows.where("norm > 0").select("dim", spot.alias("s")).distinct()
    few = few.withColumn("k", F.row_number().over(W.partitionBy("dim").orderBy("s"))).where(F.col("k") <= REFERENCES).select("dim", "s.ints").collect()
    refs = {d: np.array([r["ints"] for r in few if r["dim"] == d], np.float64).reshape(-1, d) if d else np.zeros((0, 0)) for d in dims}
    refs = {d: u / np.linalg.norm(u, axis=1, keepdims=True) for d, u in refs.items()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            angles, home = [None] * len(dim), np.zeros(len(dim), np.int32)
            norms = batch.column("norm").to_numpy()
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = _matrix(batch.column("ints").take(pa.array(at)), d).astype(np.float64)
                own = _angles(x, norms[at], refs[d])
                home[at] = own.argmin(1) if own.shape[1] else 0
                for i, a in zip(at.tolist(), own, strict=True):
                    angles[i] = a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.list_(pa.float64())), pa.array(home)], names=[*batch.schema.names, "angles", "home"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", angles array<double>, home int"
    rows = rows.mapInArrow(measured, shape)
    rows = saved(rows, "angles")
    sizes = F.broadcast(rows.groupBy("dim", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # REFERENCES rows for each length at most
    return rows.join(sizes, ["dim", "home"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _cells(rows: DataFrame) -> DataFrame:
    """For each length its cells: home, blocks, least and most angle to each reference, and the norms' range. A length has REFERENCES cells at most."""
    ends = rows.select("dim", "home", "blocks", "norm", F.posexplode_outer("angles").alias("k", "a"))
    ends = ends.groupBy("dim", "home", "k").agg(F.max("blocks").alias("blocks"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("norm").alias("most"))
    cells = ends.groupBy("dim", "home").agg(F.max("blocks").alias("blocks"), F.max("most").alias("most"), F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("ends"))
    return cells.groupBy("dim").agg(F.collect_list(F.struct("home", "blocks", "most", "ends")).alias("cells"))


def _visits(anchors: DataFrame, cells: DataFrame) -> DataFrame:
    """anchors(..., windows) once for each block of each cell whose scores can reach the least lower end of its windows."""
    a = anchors.join(F.broadcast(cells), "dim").withColumn("cell", F.explode("cells")).drop("cells")
    gap = lambda e: F.greatest(F.get("angles", e["k"]) - e["hi"], e["lo"] - F.get("angles", e["k"]), F.lit(0.0))
    apart = F.coalesce(F.array_max(F.transform(F.filter("cell.ends", lambda e: e["k"].isNotNull()), gap)), F.lit(0.0))
    size = F.col("norm") * F.col("cell.most")
    most = F.greatest(size * F.cos(F.greatest(apart - ANGLE, F.lit(0.0))), F.lit(0.0)) + 1 + size * SCORE
    least = F.array_min(F.transform("windows", lambda w: w["lo"])).cast("double")
    a = a.where(most >= least)
    return a.select("row", "label", "dim", "ints", "norm", "angles", "windows", F.col("cell.home").alias("home"), F.explode(F.sequence(F.lit(0), F.col("cell.blocks") - 1)).alias("block"))


def best_in_windows(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, key, score, row, id): for each anchor and each of its windows, of the rows in the blocks that it visits with its label (or another one)
    and a score in the window the first k of each block, by score and vec_id.

    A task takes one block at a time; anchors stream past it in batches. A row is scored only where its bounds overlap one of the anchor's windows.
    """
    key = ["dim", "home", "block"]
    shape = "struct<key:int,lo:bigint,hi:bigint>"
    none = F.array().cast(f"array<{shape}>")
    both = rows.select(*key, F.lit(0).alias("turn"), "row", "vec_id", "label", "ints", "norm", "angles", none.alias("windows")).unionByName(anchors.select(*key, F.lit(1).alias("turn"), "row", F.lit(None).cast("long").alias("vec_id"), "label", "ints", "norm", "angles", F.col("windows").cast(f"array<{shape}>")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for (dim, home, block, turn), t in _runs(batches, [*key, "turn"]):
            if (dim, home, block) != at:
                at, parts = (dim, home, block), []
            x, angles = _matrix(t.column("ints").combine_chunks(), dim), t.column("angles").combine_chunks()
            own = (x, t.column("norm").to_numpy(), _matrix(angles, len(angles[0])), t.column("label").to_numpy(), t.column("row").to_numpy())
            if not turn:
                parts.append((*own, t.column("vec_id").to_numpy()))
            elif parts:  # all of a block's rows have come before
                parts = [tuple(np.concatenate(p) for p in zip(*parts, strict=True))]
                yield from _scored(*own, t.column("windows").to_pylist(), parts[0], k, same_label)

    return both.repartition(*key).sortWithinPartitions(*key, "turn").mapInArrow(search, VISIT)


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Parts of batches with one key; a key's rows may come in several parts."""
    for batch in batches:
        if batch.num_rows:
            yield from _groups(iter([batch]), key)


def _scored(x, norms, angles, label, anchor, windows, held, k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    rows, row_norms, row_angles, row_label, row, vec_id = held
    out: list[tuple] = []
    for at in range(0, len(x), BATCH):
        part = slice(at, at + BATCH)
        least, most = bounds(angles[part], norms[part], row_angles, row_norms)
        right = (label[part][:, None] == row_label[None, :]) == same_label
        right &= anchor[part][:, None] != row[None, :]
        lo, hi = np.array([[min(w["lo"] for w in ws), max(w["hi"] for w in ws)] for ws in windows[part]], np.float64).T
        reach = right & (most >= lo[:, None]) & (least <= hi[:, None])
        cand = np.flatnonzero(reach.any(0))
        got = scores(x[part], rows[cand])
        for i, spans in enumerate(windows[part]):
            near = np.flatnonzero(reach[i][cand])
            own = got[i][near]
            for w in spans:
                inside = np.flatnonzero((own >= w["lo"]) & (own <= w["hi"]))
                if len(inside) > k:  # whoever ties with the k-th stays until vec_ids decide
                    inside = inside[own[inside] >= np.partition(own[inside], -k)[-k]]
                to = cand[near[inside]]
                first = np.lexsort((row[to], vec_id[to], -own[inside]))[:k]
                out += [(int(anchor[at + i]), w["key"], int(own[inside[j]]), int(row[to[j]]), int(vec_id[to[j]])) for j in first]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "key" else pa.int64()) for n, c in zip(("anchor", "key", "score", "row", "id"), zip(*out, strict=True), strict=True)], names=["anchor", "key", "score", "row", "id"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and key over all blocks, with their rank."""
    w = W.partitionBy("anchor", "key").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _raised(anchors: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """anchors whose windows begin no lower than the k-th best score that a first look has found in them."""
    best = seen.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("best"))
    a = anchors.join(best, anchors["row"] == best["anchor"], "left").drop("anchor")
    at = lambda w: F.greatest(w["lo"], F.coalesce(F.try_element_at("best", w["key"]), w["lo"]))
    return a.withColumn("windows", F.transform("windows", lambda w: F.struct(w["key"].alias("key"), at(w).alias("lo"), w["hi"].alias("hi")))).drop("best")


def _search(anchors: DataFrame, rows: DataFrame, cells: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The first k rows of each window: a first look at the anchor's own block raises the windows' lower ends, then every block that can reach them is visited."""
    own = anchors.select("row", "label", "dim", "ints", "norm", "angles", "windows", "home", "block")
    seen = _first(best_in_windows(own, rows, k, same_label), k)
    return _first(best_in_windows(_visits(_raised(anchors, seen, k), cells), rows, k, same_label), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where is_anchor (of vec_id) holds.

    A score is the inner product of floor(scale * x). An anchor's positives are its best other rows of its label; for each of them the negatives are the best rows of
    other labels with low per cent <= score / positive's score <= high per cent; ties go to the smaller vec_id. A positive score below 0 has no negatives, one of 0 those
    with score 0. Rows with a null id, label, vector or component, or one that isn't finite, take no part; vectors of different lengths
    aren't compared; an empty vector and one of zeros score 0. Repeated rows are rows of their own, so one may be the other's positive. Labels may be numbers or
    text. Other columns are ignored; an empty table gives an empty result. Vectors whose scores may not fit 64 bits are refused.
    """
    rows = saved(prepared(vectors, vec_id, vector, label, scale, relabel).withColumnRenamed("own", "label"), "rows")
    cells = saved(_cells(rows), "cells")
    window = lambda key, lo, hi: F.struct(key.cast("int").alias("key"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    anchors = rows.where(is_anchor)
    free = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(-FREE), F.lit(FREE))))
    pos = saved(_search(free, rows, cells, positives, True).select("anchor", F.col("rank").alias("key"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    p = F.col("positive_score").cast("decimal(38,0)")
    ends = pos.where("positive_score >= 0").select("anchor", window(F.col("key"), F.ceil(p * low / 100), F.floor(p * high / 100)).alias("w"))
    wanted = ends.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    wanted = saved(anchors.join(wanted, anchors["row"] == wanted["anchor"]).drop("anchor"), "windows")
    neg = _search(wanted, rows, cells, negatives, False)
    out = neg.join(pos, ["anchor", "key"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=label)


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id other, a.label = b.label same, list_inner_product(a.x, b.x)::bigint score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other) k from s where same) where k <= 5),
n as (select p.anchor_id, p.other positive_id, p.score positive_score, s.other negative_id, s.score negative_score, row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) k
  from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, k::int rank, negative_id, positive_score, negative_score from n where k <= 10
"""
