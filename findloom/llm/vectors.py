"""Near-duplicate vectors: a robust-pruned flat graph from overlapping shards, searched greedily from medoids and onwards within range, and an audit of its recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm.common import saved, table
from findloom.llm.graph import components

#: A flat graph holds about CELL vectors of a label; larger labels are split by FAN pivots again and again, a vector going to its two nearest cells.
CELL, FAN, NEAREST = 8192, 64, 2
#: A cell's graph is built in shards of about SHARD vectors; a vector is in its OVERLAP nearest ones.
SHARD, OVERLAP = 512, 3
#: Candidates and random others that a vector's neighbours are pruned from, how many neighbours stay, and how much nearer one has to be to shadow another.
CANDIDATES, OTHERS, DEGREE, ALPHA = 32, 4, 12, 1.2
#: Searches go on from the best BEAM vectors and from all within range less SLACK; so many queries at once, so many steps of each.
BEAM, SLACK, QUERIES, STEPS = 16, 0.02, 256, 4
#: The recall audit compares ANY nodes taken by hash, and LINKED of those with links, with all nodes; those with more than HOT true links are judged apart, as are copies. Below LEAST_RECALL
#: shards overlap twice as much, at most WIDER times. Bytes of an audit's queries.
ANY, LINKED, HOT, LEAST_RECALL, WIDER, AUDIT_BYTES = 1024, 256, 16, 0.98, 2, 16 << 20
#: Blocks of the exact comparison, and levels of cells. A cell that keeps more than STUCK of its parent's vectors isn't split again.
EXACT, LEVELS, STUCK = 2048, 12, 0.9


def close(x: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
    """Which of all unit vectors have a cosine of `least` or more with those rows, themselves left out. Cosines so near `least` that the order
    of a sum decides are summed in one order, so a pair is judged alike in every shard."""
    sims = x[rows] @ x.T
    near = sims >= least
    i, j = np.nonzero(np.abs(sims - least) < 1e-12)
    near[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[j]) >= least
    near[np.arange(len(rows)), rows] = False
    return near


def roots(hits: np.ndarray) -> np.ndarray:
    """For each node the first one that the symmetric matrix of links connects it with."""
    root = np.where(hits.any(1), -1, np.arange(len(hits)))
    for start in range(len(hits)):
        front = np.array([start] if root[start] < 0 else [], np.int64)
        while len(front):
            root[front] = start
            front = np.flatnonzero(hits[front].any(0) & (root < 0))
    return root


def _valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.array(lists.to_pylist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pruned(sims: np.ndarray, degree: int, rng: np.random.Generator) -> np.ndarray:
    """The neighbours of each vector of a shard, -1 where there are fewer than `degree`: from its nearest ones and some others the nearest is taken again and again, and
    candidates that are ALPHA times nearer to it than to the vector are passed over."""
    n = len(sims)
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(-own, k - 1, 1)[:, :k] if k < n - 1 else np.argsort(-own, 1)[:, :k]
    cand = np.concatenate([near, rng.integers(0, n, (n, OTHERS))], 1)
    row = np.arange(n)[:, None]
    alive = np.where(cand == row, -np.inf, own[row, cand])
    far = 1 - alive
    out = np.full((n, degree), -1)
    for step in range(degree):
        at = alive.argmax(1)
        good = np.isfinite(alive[row[:, 0], at])
        if not good.any():
            break
        best = cand[row[:, 0], at]
        out[good, step] = best[good]
        shadowed = ALPHA * (1 - sims[best[:, None], cand]) <= far
        alive[shadowed | (cand == best[:, None])] = -np.inf
    return out


def flat_graph(x: np.ndarray, overlap: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each node's neighbours begin, neighbours, medoids): the lists of all shards, and their reverses, united."""
    n = len(x)
    if n <= SHARD:
        shards = [np.arange(n)]
    else:
        pivots = rng.choice(n, -(-n * overlap // SHARD), replace=False)
        mine = np.argsort(-(x @ x[pivots].T), 1, kind="stable")[:, :overlap]
        shards = [np.flatnonzero((mine == k).any(1)) for k in range(len(pivots))]
    ends, medoids = [], []
    for rows in shards:
        for part in np.array_split(rows, max(1, -(-len(rows) // (4 * SHARD)))):  # a shard that is much too large is cut
            if len(part) > 1:
                sims = x[part] @ x[part].T
                medoids.append(part[sims.sum(1).argmax()])
                near = pruned(sims, DEGREE, rng)
                a, b = np.repeat(part, DEGREE)[near.reshape(-1) >= 0], part[near.reshape(-1)[near.reshape(-1) >= 0]]
                ends += [a * n + b, b * n + a]
            else:
                medoids += part.tolist()
    edges = np.unique(np.concatenate(ends)) if ends else np.empty(0, np.int64)
    return np.searchsorted(edges, np.arange(n + 1) * n), edges % n, np.unique(medoids)


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray, np.ndarray], least: float, beam: int) -> np.ndarray:
    """Pairs of vectors with a cosine of `least` or more that searches find, as a symmetric matrix.

    Each vector is a query. It begins at the medoids and goes on from the best `beam` vectors seen and from every one within range less SLACK, until all of
    these have been expanded; so the search widens with what it finds. Pairs that either end finds count.
    """
    n = len(x)
    begin, near, medoids = graph
    hits = np.zeros((n, n), bool)
    for base in range(0, n, QUERIES):
        q = x[base : base + QUERIES]
        own = np.arange(base, base + len(q))
        seen = np.zeros((len(q), n), bool)
        seen[:, medoids] = True
        # each query's pool, best first: vectors, cosines, and whether they have been expanded; -1 where there's none
        pool, sims, done = np.full((len(q), 0), -1), np.zeros((len(q), 0)), np.zeros((len(q), 0), bool)
        new, new_sims, size = np.tile(medoids, (len(q), 1)), q @ x[medoids].T, 2 * beam
        while True:
            pool, sims, done = np.concatenate([pool, new], 1), np.concatenate([sims, new_sims], 1), np.concatenate([done, new < 0], 1)
            while (sims >= least - SLACK).sum(1).max() > size // 2:
                size *= 2  # nothing within range ever leaves a pool
            row = np.arange(len(q))[:, None]
            if sims.shape[1] > size:
                order = np.argpartition(sims, -size, 1)[:, -size:]
                pool, sims, done = pool[row, order], sims[row, order], done[row, order]
            order = np.argsort(-sims, 1, kind="stable")
            pool, sims, done = pool[row, order], sims[row, order], done[row, order]
            ready = ~done & ((np.arange(pool.shape[1]) < beam) | (sims >= least - SLACK))
            ready &= np.cumsum(ready, 1) <= max(STEPS, size // 16)
            more = ready.any(1)
            if not more.all():  # some searches have ended
                i, j = np.nonzero((sims >= least) & ~more[:, None])
                hits[own[i], pool[i, j]] = True
                q, own, seen, pool, sims, done, ready = (v[more] for v in (q, own, seen, pool, sims, done, ready))
            if not len(q):
                break
            rows, cols = np.nonzero(ready)
            done[rows, cols] = True
            node = pool[rows, cols]
            count = begin[node + 1] - begin[node]
            who = np.repeat(rows, count)
            to = near[np.arange(count.sum()) + np.repeat(begin[node] - (np.cumsum(count) - count), count)]
            fresh = ~seen[who, to]
            pairs = np.unique(who[fresh] * n + to[fresh])
            who, to = pairs // n, pairs % n
            seen[who, to] = True
            many = np.bincount(who, minlength=len(q))
            place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            new, new_sims = np.full((len(q), many.max(initial=0)), -1), np.full((len(q), many.max(initial=0)), -2.0)
            new[who, place] = to
            for at in range(0, len(who), 1 << 16):
                i, j = who[at : at + (1 << 16)], to[at : at + (1 << 16)]
                new_sims[i, place[at : at + (1 << 16)]] = np.einsum("ij,ij->i", q[i], x[j])
    hits |= hits.T
    np.fill_diagonal(hits, False)
    return hits


def _weighed(hits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of each row's links, a few rows at a time."""
    parts = [hits[at : at + 256].astype(np.float64) @ weight.astype(np.float64) for at in range(0, len(hits), 256)]
    return np.concatenate(parts).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with one key of a sorted stream."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("others", pa.int64()), ("root", pa.int64())])


def _told(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links by weight, links to distinct nodes) and (a, b) edges that connect what the links connect."""
    got = saved(got, "links")
    return got.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others")), got.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _graph_search(nodes: DataFrame, least: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Links found by searches of each cell's flat graph. Pairs that share a cell are counted in the first one they share; those that share several are
    compared exactly, so all their cells agree."""
    rows = _cells(nodes)
    cells = rows.groupBy("node").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    key = ["label", "dim", "cell"]
    rows = rows.join(cells, "node").select(*key, "node", "weight", "cells", "vector", "stuck")
    stuck, rows = rows.where("stuck").drop("stuck"), rows.where("not stuck").drop("stuck")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, cell), t in _groups(batches, key):
            node, weight = (t.column(c).to_numpy() for c in ("node", "weight"))
            x = _unit(t.column("vector").combine_chunks())
            rng = np.random.default_rng(len(x))
            hits = range_search(x, flat_graph(x, overlap, rng), least, BEAM * overlap // OVERLAP) if len(x) > 1 else np.zeros((1, 1), bool)
            counted = hits.copy()
            both: dict[str, list[int]] = {}
            for i, own in enumerate(t.column("cells").to_pylist()):
                for other in own if len(own) > 1 else ():
                    if other != cell:
                        both.setdefault(other, []).append(i)
            for other, own in both.items():
                for at in range(0, len(own), 128):
                    part = np.array(own[at : at + 128])
                    hits[np.ix_(part, own)] = counted[np.ix_(part, own)] = close(x[own], np.arange(at, at + len(part)), least)
            for other, own in both.items():
                if other < cell:
                    counted[np.ix_(own, own)] = False
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_weighed(counted, weight)), pa.array(counted.sum(1)), pa.array(node[roots(hits)])], schema=_FOUND)

    found = rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(search, "node long, links long, others long, root long")
    return _told(found if stuck.isEmpty() else found.unionByName(_block_search(stuck, least)))


def _cells(nodes: DataFrame) -> DataFrame:
    """nodes with `cell`, once for each of theirs, and `stuck`: a label of up to CELL vectors is one cell. A larger cell gets FAN pivots, a hash sample of its vectors, and
    each vector goes to the NEAREST of them, level by level. Where pivots tell a cell's vectors apart no longer it's stuck: its vectors are compared in exact blocks."""
    shape = "node long, label long, dim int, vector array<double>, weight long, cell string, parent long, stuck boolean"
    rows, key = nodes.select("node", "label", "dim", "vector", "weight").withColumns({"cell": F.lit(""), "parent": F.lit(None).cast("long"), "stuck": F.lit(False)}), ["label", "dim", "cell"]
    names = [c.split(" ")[0] for c in shape.split(", ")]
    for level in range(LEVELS):
        sizes = rows.where("not stuck").groupBy(*key).agg(F.count("*").alias("n"), F.max("parent").alias("above")).where(F.col("n") > CELL)
        sizes = saved(sizes.withColumn("ends", F.coalesce(F.col("n") > STUCK * F.col("above"), F.lit(False)) | F.lit(level == LEVELS - 1)), "sizes")
        if sizes.isEmpty():
            break
        ended = sizes.where("ends").select(*key, F.lit(True).alias("ended"))
        rows = rows.join(F.broadcast(ended) if ended.count() <= 10_000 else ended, key, "left").withColumn("stuck", F.col("stuck") | F.coalesce("ended", F.lit(False))).drop("ended")
        sizes = sizes.where("not ends").select(*key, "n")
        large = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, key)
        spot = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30))
        few = large.where(spot < F.lit(4.0 * FAN * (1 << 30)) / F.col("n")).withColumn("spot", spot)
        pivots = few.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct("spot", "node", "vector"))), 1, FAN).alias("pivots"))
        pivots = saved(pivots.select(*key, F.transform("pivots", lambda p: p["vector"]).alias("pivots")), "pivots")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in _groups(batches, key):
                p = _unit(t.column("pivots")[0].values)
                x = _unit(t.column("vector").combine_chunks())
                near = np.sort(np.argsort(-(x @ p.T), 1, kind="stable")[:, :NEAREST], 1)
                cells, own = [f"{c}/{k:02d}" for c, ks in zip(t.column("cell").to_pylist(), near.tolist()) for k in ks], np.repeat(np.arange(len(x)), near.shape[1])
                yield from t.drop_columns(["pivots", "cell"]).take(pa.array(own)).append_column("cell", pa.array(cells)).select(names).combine_chunks().to_batches()

        split = large.withColumn("parent", F.col("n")).join(pivots, key).sortWithinPartitions(*key).select(*names, "pivots").mapInArrow(assign, shape)
        rest = rows.join(sizes.drop("n"), key, "left_anti").select(*names)
        rows = saved(split.unionByName(rest).dropDuplicates(["node", "label", "dim", "cell"]), "cells")
    return rows


def _exact_search(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All links there are, by pairs of blocks of each label."""
    return _told(_block_search(nodes.select("node", "label", "dim", "vector", "weight", F.lit("").alias("cell"), F.array(F.lit("")).alias("cells")), least))


def _block_search(rows: DataFrame, least: float) -> DataFrame:
    """The links inside each cell, by pairs of blocks; a pair counts in the first cell that it shares."""
    cell = ["label", "dim", "cell"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select(*cell, F.when(F.col("n") <= 2 * EXACT, 1).otherwise(F.ceil(F.col("n") / EXACT)).cast("int").alias("blocks"))
    rows = rows.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*cell, "i", "j"]
    rows = rows.select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "cells", "vector")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, own, i, j), t in _groups(batches, key):
            node, weight, block = (t.column(c).to_numpy() for c in ("node", "weight", "block"))
            x = _unit(t.column("vector").combine_chunks())
            hits = np.zeros((len(x), len(x)), bool)
            for at in range(0, len(x), 128):
                part = np.arange(at, min(len(x), at + 128))
                hits[part] = close(x, part, least)
                if i != j:
                    hits[part] &= block[part][:, None] != block[None, :]
            counted, both = hits, {}
            for k, names in enumerate(t.column("cells").to_pylist()):
                for name in names:
                    if name < own:
                        both.setdefault(name, []).append(k)
            if both:
                counted = hits.copy()
                for shared in both.values():
                    counted[np.ix_(shared, shared)] = False
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_weighed(counted, weight)), pa.array(counted.sum(1)), pa.array(node[roots(hits)])], schema=_FOUND)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "node long, links long, others long, root long")


def _truth(nodes: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(node, weight, true links to distinct nodes) of those queries that have any, compared with all nodes by brute force."""
    sample = queries.select("node", "label", "dim", "weight", "vector").toArrow()
    by: dict = {}
    for at, key in enumerate(zip(*(sample.column(c).to_pylist() for c in ("label", "dim")), strict=True)):
        by.setdefault(key, []).append(at)
    queries = {key: (*(np.array(sample.column(c).take(at).to_pylist()) for c in ("node", "weight")), _unit(sample.column("vector").take(at))) for key, at in by.items()}
    out = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("truth", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, node = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim")), strict=True)), batch.column("node").to_numpy()
            for key in set(keys) & queries.keys():
                rows, (ids, weight, q) = np.array([i for i, x in enumerate(keys) if x == key]), queries[key]
                x, n = _unit(batch.column("vector").take(pa.array(rows))), np.zeros(len(ids), np.int64)
                for at in range(0, len(rows), 128):
                    part = np.concatenate([x[at : at + 128], q])
                    k = len(part) - len(q)
                    n += (close(part, np.arange(k), least)[:, k:] & (node[rows[at : at + 128]][:, None] != ids[None, :])).sum(0)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(weight[some]), pa.array(n[some])], schema=out)

    found = nodes.select("node", "label", "dim", "vector").mapInArrow(compare, "node long, weight long, truth long")
    return saved(found.groupBy("node").agg(F.first("weight").alias("weight"), F.sum("truth").alias("truth")), "truth")


def _sample(nodes: DataFrame, most: int, dim: int) -> DataFrame:
    """Up to `most` nodes by hash, fewer where their vectors would take more than AUDIT_BYTES."""
    return nodes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(max(1, min(most, AUDIT_BYTES // (8 * max(1, dim)))))


def audit(truth: DataFrame, links: DataFrame) -> float:
    """The least recall among groups of audited nodes: single vectors with few links, with many, and copies; each node counts once. 1 where none has a link."""
    share = F.least(F.lit(1.0), F.coalesce("others", F.lit(0)) / F.col("truth"))
    kinds = truth.join(links, "node", "left").groupBy(F.col("truth") > HOT, F.col("weight") > 1).agg(F.avg(share).alias("recall"))
    return kinds.agg(F.min("recall")).first()[0] or (0.0 if not truth.isEmpty() else 1.0)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept, and the audited recall in every row.

    Vectors of a label with one direction are one node with a weight, so a common vector costs one row. Each cell of a label gets a graph: overlapping shards, robust pruning in each,
    the lists united. Every vector searches it from the medoids and onwards within range; pairs found are links by their cosine in doubles. No task
    holds more than about CELL vectors. Recall is then audited: a fixed number of nodes, and of nodes with links, are compared with all others, whatever the
    table's size. Where nodes with few links, with many or copies fall below LEAST_RECALL, shards overlap and beams widen twice as much, and in the end blocks of each
    label are compared exactly (recall 1).
    Null labels, and vectors that are null, empty, zero or hold null, NaN or infinite components, have no links; vectors of different lengths aren't
    compared. component_id is the smallest vec_id connected; repeated rows count as other vectors, and rows that share the smallest
    vec_id are all kept. Other columns are ignored; an empty table gives an empty result.
    """
    v = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    fine = F.col("label").isNotNull() & _valid(F.col("vector"))
    flat = lambda w: _let(F.array_max(F.transform(w, lambda y: F.abs(y))), lambda m: F.transform(w, lambda x: x / m))
    one = lambda w: _let(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, y: s + y * y)), lambda n: F.transform(w, lambda x: x / n + F.lit(0.0)))
    v = v.withColumn("vector", F.when(fine, _let(_let(F.col("vector"), flat), one)))
    v = v.withColumn("same", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256)))
    # numbers that the written table keeps: unlike hashes no two nodes, and no two labels, can share one
    nodes = v.where("same is not null").groupBy("same").agg(F.first("label").alias("own"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    labels = saved(nodes.select("own").distinct().withColumn("label", F.monotonically_increasing_id()), "labels")
    nodes = saved(nodes.join(labels, "own").drop("own"), "nodes")
    dim = nodes.agg(F.max("dim")).first()[0] or 1
    truth, overlap = _truth(nodes, _sample(nodes, ANY, dim), least), OVERLAP
    for attempt in range(WIDER + 1):
        links, edges = _graph_search(nodes, least, overlap << attempt)
        if not attempt:
            linked = _sample(nodes.join(links.where("others > 0").select("node"), "node", "left_semi"), LINKED, dim)
            truth = saved(truth.unionByName(_truth(nodes, linked, least)).dropDuplicates(["node"]), "truth")
        recall = audit(truth, links)
        if recall >= LEAST_RECALL:
            break
    else:
        (links, edges), recall = _exact_search(nodes, least), 1.0
    named = nodes.select("node", "same", "weight", "least").join(components(edges), "node", "left").join(links, "node", "left")
    named = named.select("same", "least", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("same", "n", "component_id")
    own = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = v.select("vec_id", "same").join(named, "same", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"), F.lit(float(recall)).alias("audited_recall"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
