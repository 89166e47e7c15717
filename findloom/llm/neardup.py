"""Near duplicates: HyperMinHash registers (leading zeros and mantissa bits by bucket), banded; a collision-corrected estimate, then full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm.common import fresh, saved, table, without
from findloom.llm.graph import components

#: Buckets (a power of two), mantissa bits, and the bands cut from the registers. A pair at 0.8 shares no band with a chance of (1 - 0.8**6)**42, 3 in a million.
BUCKETS, MANTISSA, BANDS, ROWS = 256, 10, 42, 6
#: Two different minima have one register with about this chance: a third for the zeros, 2**-10 for the mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: A band key's sets are first compared with two of them, REACH to a task. What that leaves apart is compared in groups: up to GROUP sets in one task, more by
#: pairs of blocks of about BLOCK sets.
REACH, GROUP, BLOCK = 512, 256, 128
#: Estimates this far below the threshold are still verified: six standard errors of 252 registers.
MARGIN = 0.15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_rng = np.random.default_rng(20_140_610)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each empty bucket the order in which it looks at others.
_RANK = _rng.permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    power = np.full(int(lengths.max()), _BASE, np.uint64).cumprod(dtype=np.uint64)
    letters = b[inside]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return _mix(np.add.reduceat(_BYTE[letters] * power[place], first) + lengths.astype(np.uint64))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of so many words; with fewer words the whole sequence is one."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(_BASE) + _mix(w[i : len(w) - n + 1 + i] * _WORD[i % 64])
    return np.unique(_mix(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set: by bucket the leading zeros (6 bits) and the MANTISSA bits after the first one of its
    smallest hash; an empty bucket takes the register of the first bucket with one in its own fixed random order."""
    bits = BUCKETS.bit_length() - 1
    bucket, at = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    rest = hashes[at] << np.uint64(bits)
    zeros = 63 - np.floor(np.log2(np.maximum(rest >> np.uint64(11), 1).astype(np.float64))).astype(np.int64) - 11
    zeros = np.minimum(zeros, 52)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    own = ((zeros + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    if len(bucket) == BUCKETS:
        return own
    out = own[_RANK[:, bucket].argmin(1)]
    out[bucket] = own
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    r = regs[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)
    return _mix((_mix(r * _BAND) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def estimate(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard of one set with many, from their registers: the share that agree, less what collisions add."""
    m = (many == a).mean(1)
    return (m - COLLISION) / (1 - COLLISION)


def _near(a: np.ndarray, many: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, whether they call for full sets); with few hashes the estimate is coarse."""
    e = estimate(a, many)
    return e, (e >= percent / 100 - MARGIN) | (size < BUCKETS)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], side: list[int], percent: int, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j), confirmed on full sets, that connect what all links between the sides connect (within the one side if there's only one).

    Sets with one number in `joined` are connected from the start. Pairs are tried from the highest estimate down; one whose ends are connected already needs no proof.
    """
    n = len(sets)
    known: dict[int, int] = {}
    root = [known.setdefault(k, i) for i, k in enumerate(joined if joined is not None else range(n))]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    sizes, sides, first = np.array([len(s) for s in sets]), np.array(side), np.array(root)
    regs = np.stack([registers(s) for s in sets])
    one = (sides == sides[0]).all()
    tried = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        j = j[(100 * low >= percent * high) & (one | (sides[j] != sides[i])) & (first[j] != first[i])]
        if len(j):
            e, near = _near(regs[i], regs[j], sizes[i], percent)
            tried += zip(e[near], [i] * int(near.sum()), j[near].tolist())
    out = []
    for _, i, j in sorted(tried, key=lambda x: (-x[0], x[1], x[2])):
        if (a := find(i)) != (b := find(j)) and _linked(sets[i], sets[j], percent):
            root[a] = b
            out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts with equal shingle sets are one class. Classes that share a band key are compared with two of the key's classes, so groups of near copies are connected by
    a row or two each. Only keys whose classes are still apart form groups (components over a star for each key, so no pairs are written); a group's sets are compared in one
    task, or, beyond GROUP, by blocks in many: those outside the largest connected part with all others. Every possible link between classes that aren't
    connected is tried on full sets. What is returned is connected by links of at least `percent`; a link escapes only if its sets share none of the BANDS keys, or if
    its estimate is more than MARGIN too low, both with a chance of a few in a million at the threshold.
    Null and empty texts, and texts without words, have no shingles and are linked with nothing. component_id is the smallest doc_id of the
    rows connected, null only where all their doc_ids are. Repeated rows are copies of each other: those with the smallest doc_id are all
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    return verdicts(docs, doc_id, text, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates with `content`, the MD5 of a text, and `component`, a number for the rows connected (null for texts without words).
    Rows that agree in doc_id and content agree in everything; neither a null nor a shared doc_id names a row."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).withColumn("content", F.md5("text"))
    id_type = dict(d.dtypes)["doc_id"]
    id_arrow = d.limit(0).select("doc_id").toArrow().schema.field(0).type

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(id_arrow), batch.column(2).cast(pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([bands(registers(s)).tolist() if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["doc_id", "content", "n_shingles", "digest", "bands"])

    scanned = saved(d.mapInArrow(signed, f"doc_id {id_type}, content string, n_shingles long, digest binary, bands array<long>"), "signed")
    # classes are numbered in a written table: unlike hashes no two share a number, and null doc_ids do no harm
    classes = scanned.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "content")).alias("row"), F.first("bands").alias("bands"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("first"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("second"), F.count("*").alias("n")).where("n > 1")
    shared = saved(keyed.join(several, "key"), "shared")
    # one text stands for its class: the first by doc_id of those with the digest; rows that repeat it bring it once
    wanted = classes.join(shared.select("node").distinct(), "node").select("node", "row.*")
    texts = d.join(wanted, (d["content"] == wanted["content"]) & d["doc_id"].eqNullSafe(wanted["doc_id"]))
    texts = saved(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    pairs = shared.select(F.explode(F.array("first", "second")).alias("star"), "node").where("star <> node").distinct()
    blocks = pairs.groupBy("star").agg(F.ceil(F.count("*") / REACH).cast("int").alias("blocks"))
    placed = pairs.join(blocks, "star").select("star", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    centres = blocks.select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("star").alias("node"))
    rows = placed.unionByName(centres).join(texts, "node").select("star", "block", (F.col("star") != F.col("node")).alias("other"), "node", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = regs = None
        for batch in batches:
            a, b = [], []
            for s, _, other, n, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                mine = shingles(t, words)
                if not other:
                    own, regs = mine, registers(mine)
                elif 100 * min(len(own), len(mine)) >= percent * max(len(own), len(mine)):
                    _, near = _near(regs, registers(mine)[None], min(len(own), len(mine)), percent)
                    if near[0] and _linked(own, mine, percent):
                        a.append(s)
                        b.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    order = ["star", "block", "other"]
    stars = saved(rows.repartition("star", "block").sortWithinPartitions(*order).mapInArrow(star, "a long, b long"), "stars")
    joined = components(stars).withColumnRenamed("component", "part")
    left = shared.where("n > 2").select("key", "node").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))
    apart = left.groupBy("key").agg(F.min("node").alias("first"), (F.min("part") < F.max("part")).alias("apart")).where("apart")
    left = saved(left.join(apart.drop("apart"), "key").select("first", "node", "part"), "left")
    coarse = components(left.select(F.col("first").alias("a"), F.col("node").alias("b"))).join(left.select("node", "part").distinct(), "node")

    parts = coarse.groupBy("component", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("component").agg(F.sum("n").alias("size"), F.max(F.struct("n", "part")).alias("main"))
    sizes = sizes.select("component", "size", F.col("main.part").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("rest"))
    spot, small = F.xxhash64("node"), F.col("size") <= GROUP
    dealt = coarse.join(sizes, "component").withColumn("block", F.when(small, 0).when(F.col("part") == F.col("main"), F.col("rest") + F.pmod(spot, "mains")).otherwise(F.pmod(spot, "rest")).cast("int"))
    meets = F.when(small, F.array(F.lit(0))).when(F.col("block") < F.col("rest"), F.sequence(F.lit(0), F.col("rest") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") - 1))
    dealt = dealt.join(texts, "node").withColumn("with", F.explode(meets))
    dealt = dealt.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "part", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, side, parts, sets = None, [], [], [], []

        def done() -> pa.RecordBatch:
            mixed = key[1] != key[2]
            found = links(sets, side if mixed else [0] * len(sets), percent, parts) if len(set(parts)) > 1 and (not mixed or len(set(side)) > 1) else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], schema=schema)

        for batch in batches:
            for c, i, j, b, n, p, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, i, j) != key:
                    if key:
                        yield done()
                    key, nodes, side, parts, sets = (c, i, j), [], [], [], []
                nodes.append(n)
                side.append(b)
                parts.append(p)
                sets.append(shingles(t, words))
        if key:
            yield done()

    edges = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(compare, "a long, b long")
    linked = components(stars.unionByName(edges))
    names = classes.select("node", "digest", "least").join(linked, "node", "left")
    names = names.select("digest", "least", F.coalesce("component", "node").alias("component"))
    named = names.join(names.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "component", "component_id")
    out = scanned.select("doc_id", "content", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "content", "n_shingles", "component", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
