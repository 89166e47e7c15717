"""Merkle manifest of a dataset: ranks in base 16 are grouped away digit by digit inside bounded blocks, children nested in their parents; one explode gives every proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findloom.llm.common import ascii_lower, saved, table

#: Children of a node, and levels that are nested in one block: a block holds up to FAN ** LEVELS nodes.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
STEP = "array<struct<place:int,siblings:array<string>>>"


def hashed(parts: Column) -> Column:
    """H of an array of digests: they are concatenated as hex text."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_hash(*values: Column) -> Column:
    """H of a row's values: `-` for null, else the length in bytes, a colon and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(grp, ...) with `rank`, from 0 in each group by `order`, and the group's size `n`.

    Rows are written in ranges of group and order; each range numbers its own, and what is added to these numbers are sums over one row for each range
    and group. So a group of any size spreads over tasks, and no group is a single window.
    """
    part = saved(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("grp", "part").agg(F.count("*").alias("own"))
    by = W.partitionBy("grp")
    sizes = sizes.select("grp", "part", (F.sum("own").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("before"), F.sum("own").over(by).alias("n"))
    local = part.withColumn("rank", F.row_number().over(W.partitionBy("grp", "part").orderBy(*order)).cast("long") - 1)
    return local.join(sizes, ["grp", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def _nested(nodes: DataFrame) -> DataFrame:
    """(grp, block, n, digest, kids) of nodes(grp, rank, n, digest, load): three digits of the rank are grouped away, one after another. All three groupings are within
    one block, so rows are shuffled once. Where a group has one node left, it isn't hashed again."""
    digit = lambda k: F.pmod(F.floor(F.col("rank") / FAN**k), F.lit(FAN)).cast("int").alias(f"d{k}")
    rows = nodes.select("grp", F.floor(F.col("rank") / BLOCK).alias("block"), "n", *[digit(k) for k in reversed(range(LEVELS))], F.struct("digest", "load").alias("node"))
    rows = rows.repartition("grp", "block")
    for k in range(LEVELS):
        key = ["grp", "block", "n", *[f"d{j}" for j in reversed(range(k + 1, LEVELS))]]
        kids = F.transform(F.sort_array(F.collect_list(F.struct(f"d{k}", "node"))), lambda x: x["node"])
        rows = rows.groupBy(*key).agg(kids.alias("kids"))
        digest = F.when(F.col("n") > FAN**k, hashed(F.transform("kids", lambda x: x["digest"]))).otherwise(F.col("kids")[0]["digest"])
        rows = rows.select(*key, F.struct(digest.alias("digest"), "kids").alias("node"))
    return rows.select("grp", "block", "n", "node.digest", "node.kids")


def _step(place: Column, digests: Column) -> Column:
    return F.struct(place.alias("place"), F.filter(digests, lambda _, i: i != place).alias("siblings"))


def rollup(nodes: DataFrame, most: int, above=None) -> DataFrame:
    """(grp, rank, load, path, top) for each of nodes(grp, rank, n, digest, load): its siblings level by level and its group's last node, joined to what `above`
    adds. most is the largest n. above takes (grp, digest), a row for each group, and gives (grp, path, top).

    Blocks of nodes are nested and their digests rolled up in the same way until a group is one block. A block and its own path, one row for 4096 nodes, meet
    in a grouping; from there each explode hands the path down to the kids, and no node is joined with anything.
    """
    blocks = saved(_nested(nodes), "blocks")
    if most > BLOCK:
        upper = blocks.select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest", F.lit(None).cast("int").alias("load"))
        paths = rollup(upper, -(-most // BLOCK), above).select("grp", F.col("rank").alias("block"), "path", "top")
    elif above:
        paths = above(blocks.select("grp", "digest")).select("grp", F.lit(0).cast("long").alias("block"), "path", "top")
    else:
        paths = blocks.select("grp", "block", F.array().cast(STEP).alias("path"), F.col("digest").alias("top"))
    both = blocks.select("grp", "block", "n", "kids").unionByName(paths, allowMissingColumns=True)
    rows = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])
    for k in reversed(range(LEVELS)):
        rows = rows.withColumn("digests", F.transform("kids", lambda x: x["digest"]))
        rows = rows.select("grp", "block", "n", "path", "top", "digests", *([] if k == LEVELS - 1 else ["at"]), F.posexplode("kids").alias("place", "node"))
        path = F.when(F.col("n") > FAN**k, F.concat(F.array(_step(F.col("place"), F.col("digests"))), "path")).otherwise(F.col("path"))
        at = F.col("place").cast("long") + (0 if k == LEVELS - 1 else F.col("at") * FAN)
        rows = rows.select("grp", "block", "n", path.cast(STEP).alias("path"), "top", at.alias("at"), *([F.col("node.kids").alias("kids")] if k else [F.col("node.load").alias("load")]))
    return rows.select("grp", (F.col("block") * BLOCK + F.col("at")).alias("rank"), "load", "path", "top")


def _most(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: hashed(F.concat(F.slice(s["siblings"], 1, s["place"]), F.array(node), F.slice(s["siblings"], s["place"] + 1, FAN))))


def proof(path: Column) -> Column:
    """A path's siblings from leaf to root, left to right."""
    return F.flatten(F.transform(path, lambda s: s["siblings"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", source: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, source, leaf, path (a place among siblings and those, for each level), subroot, root, and the `carry` columns.

    A leaf hashes the named columns. Each source is a tree of its leaves by doc_id, nulls first (ties by leaf), and one more tree over all subroots, sources in byte order
    and null first, has the root; runs of FAN nodes become one until one is left. Only ids and digests are shuffled, never texts. carry names values
    computed from docs that come out beside their leaf (no maps). Nulls anywhere are values of their own, repeated rows are leaves of their
    own, an empty table gives an empty result, and columns of docs that aren't named don't matter.
    """
    names = list(carry or {})
    order = F.coalesce(F.concat(F.lit("+"), F.col(f"`{source}`").cast("string")), F.lit(""))  # null before all others, even before an empty name
    kept = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), *[v.alias(f"carry_{k}") for k, v in (carry or {}).items()])
    leaves = saved(docs.select(order.alias("grp"), F.col(f"`{doc_id}`").alias("doc"), leaf_hash(*[F.col(f"`{c}`") for c in columns]).alias("digest"), kept.alias("load")), "leaves")
    leaves = ranked(leaves, ["doc", "digest"]).withColumn("load", F.struct("digest", "load")).drop("doc")

    def above(subroots: DataFrame) -> DataFrame:
        own = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
        out = rollup(own.select("grp", "rank", "n", "digest", F.struct("name", "digest").alias("load")), _most(own))
        return out.select(F.col("load.name").alias("grp"), "path", F.struct(F.col("load.digest").alias("subroot"), F.col("top").alias("root")).alias("top"))

    out = rollup(leaves, _most(leaves), above) if not leaves.isEmpty() else rollup(leaves, 0, lambda s: s.select("grp", F.array().cast(STEP).alias("path"), F.struct(F.col("digest").alias("subroot"), F.col("digest").alias("root")).alias("top")))
    return out.select("load.load.doc_id", "load.load.source", F.col("load.digest").alias("leaf"), "path", "top.subroot", "top.root", *[F.col(f"load.load.carry_{k}").alias(k) for k in names])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = leaf_hash(*[ascii_lower(F.col("text")) if c == "text" else F.col(c) for c in columns])
    claim = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, tampered)
    out = manifest(docs, columns, carry={"tampered": claim}).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", hashed(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A field of a leaf in DuckDB.
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("d.doc_id", "source", "lang", "n_chars"))
ORACLE = f"""
with recursive crc as (select doc_id, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: list_concat([ascii(substr(doc_id::varchar, i::int, 1))::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
  lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from documents),
l as (select d.doc_id, source, sha256({_LEAF} || {_FIELD.format('text')}) leaf, case when xor(c, 4294967295) % 5 = 0 then sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end tampered
  from documents d join crc on d.doc_id = crc.doc_id),
r as (select *, row_number() over (partition by source order by doc_id) - 1 i, count(*) over (partition by source) n from l),
t as (select 0 k, source, i, n, leaf d from r union all
  select k + 1, source, i // 16, max((n + 15) // 16), sha256(string_agg(d, '' order by i)) from t where n > 1 group by k, source, i // 16),
s as (select source, d subroot, row_number() over (order by source nulls first) - 1 j, count(*) over () m from t where n = 1),
u as (select 0 k, j, m, subroot d from s union all
  select k + 1, j // 16, max((m + 15) // 16), sha256(string_agg(d, '' order by j)) from u where m > 1 group by k, j // 16),
tr as (select k, source, i // 16 run, list(d order by i) ds from t where n > 1 group by 1, 2, 3),
ur as (select k, j // 16 run, list(d order by j) ds from u where m > 1 group by 1, 2),
f as (select 0 k, doc_id, source, i, n, coalesce(tampered, leaf) h, '' p from r union all
  select f.k + 1, doc_id, f.source, i // 16, (n + 15) // 16, sha256(array_to_string(list_concat(ds[:i % 16], [h], ds[i % 16 + 2:]), '')), p || array_to_string(list_concat(ds[:i % 16], ds[i % 16 + 2:]), '')
  from f join tr on f.k = tr.k and f.source is not distinct from tr.source and i // 16 = run where n > 1),
g as (select 0 k, doc_id, j, m, h, p from f join s on f.source is not distinct from s.source where n = 1 union all
  select g.k + 1, doc_id, j // 16, (m + 15) // 16, sha256(array_to_string(list_concat(ds[:j % 16], [h], ds[j % 16 + 2:]), '')), p || array_to_string(list_concat(ds[:j % 16], ds[j % 16 + 2:]), '')
  from g join ur on g.k = ur.k and j // 16 = run where m > 1),
root as (select d root from u where m = 1)
select r.doc_id, leaf, subroot, root, sha256(p) proof_sha256, h folded_root, h = root verified
from r join s on r.source is not distinct from s.source join (select * from g where m = 1) g on r.doc_id = g.doc_id cross join root
"""
