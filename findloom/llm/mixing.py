"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findloom.llm.common import fresh, saved, table, without

#: Distributions up to this many bytes are broadcast; more are joined by a salted shuffle.
BROADCAST_BYTES = 32 << 20
SALTS = 32


def uniform(*parts) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def _first(rate: Column) -> Column:
    """Counts below this one have no weight in doubles."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 30), F.lit(0)).cast("long")


def _last(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """rates (source, rate above 0) with `first`, the least count that matters, and `cdf`: P(X <= first), P(X <= first + 1), ... up to where 1 is reached in doubles.

    A row for each count, about 24 square roots of the rate, and two running sums: of the logarithms' steps, then of the weights. What the first
    logarithm lacks in exactness (Stirling's series) falls out when sums are divided by the last one.
    """
    k, x = F.col("k").cast("double"), F.col("first") + F.lit(1.0)
    log_factorial = F.when(F.col("first") == 0, F.lit(0.0)).otherwise((x - 0.5) * F.ln(x) - x + 0.918938533204672742 + 1 / (12 * x) - 1 / (360 * x * x * x))
    rows = rates.withColumn("first", _first(F.col("rate"))).withColumn("k", F.explode(F.sequence("first", _last(F.col("rate")))))
    step = F.when(F.col("k") == F.col("first"), F.col("first") * F.ln("rate") - F.col("rate") - log_factorial).otherwise(F.ln(F.col("rate") / k))
    w = W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("weight", F.exp(F.sum(step).over(w))).withColumn("c", F.sum("weight").over(w))
    sums = rows.groupBy("source").agg(F.first("first").alias("first"), F.sort_array(F.collect_list("c")).alias("cdf"))
    return sums.withColumn("cdf", F.transform("cdf", lambda c: c / F.element_at("cdf", -1)))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """A row for each source (null is one): size in characters, target weight and mean repetitions.

    weights has columns source and weight (negative or null: 0; a source that it lacks: 0); without it a source weighs its size to the power
    `temperature`. The mean is weight share x epochs x total size / size; a source without characters has mean 0.
    """
    size = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.length(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("size"))
    if weights is None:
        sized = size.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").alias("weight"))
        sized = size.join(w, size["source"].eqNullSafe(w["w_source"]), "left").select("source", "size", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = saved(sized, "sources")
    sums = total.agg(F.sum("size"), F.sum("weight"), F.count("*")).first()
    all_size, all_weight = float(sums[0] or 0), float(sums[1] or 0)
    mean = F.when((F.col("size") > 0) & F.lit(all_weight > 0), F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_size * epochs) / F.col("size")).otherwise(F.lit(0.0))
    return total.withColumn("rate", mean)


def mix(docs: DataFrame, rates: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """Each row of docs as often as a Poisson variable of its source's rate says, with copy (1, 2, ...) and shuffle_key; in the order of shuffle_key.

    The count inverts the distribution at a number hashed from seed and doc_id, so reruns agree and rows with one doc_id get one count;
    a null doc_id hashes as `null`. Sources without a rate, and rate 0, give no rows. Input columns named copy or shuffle_key are replaced.
    Distributions are one row a source: up to BROADCAST_BYTES are broadcast, more are joined by (source, salt), so that a hot source spreads over tasks.
    A row looks at about 24 square roots of its rate, which is less than its copies where rates are large.
    Copies go to partitions by a hash of the key, which is even whatever the sources are, and each partition is sorted: a global shuffle.
    """
    key, u, cdf, first, salt = (fresh(docs, x) for x in ("source", "u", "cdf", "first", "salt"))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    d = without(docs, "copy", "shuffle_key").withColumn(u, uniform(F.lit(seed), ident))
    own = rates.where("rate > 0").select("source", F.col("rate").cast("double").alias("rate"))
    size = own.agg(F.sum(8.0 * (_last(F.col("rate")) - _first(F.col("rate"))) + 64)).first()[0] or 0
    r = poisson_cdf(own).select(F.col("source").alias(key), F.col("first").alias(first), F.col("cdf").alias(cdf))
    on = d[f"`{source}`"].eqNullSafe(r[key])
    if size <= BROADCAST_BYTES:
        r = F.broadcast(r)
    else:
        d = d.withColumn(salt, F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
        r = r.withColumn(f"{salt}r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (d[salt] == r[f"{salt}r"])
    n = F.col(first) + F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    out = d.join(r, on).withColumn(salt, n).where(F.col(salt) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(salt).cast("int")))).drop(salt, f"{salt}r", key, u, cdf, first)
    out = out.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, "copy")), 1, 15), 16, 10).cast("long"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, source_rates(docs)).select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLE = """
with s as (select source, sum(length(coalesce(text, ''))) size from documents group by 1),
w as (select source, size, pow(size::double, 0.5) weight from s),
r as (select source, weight / (select sum(weight) from w) * (select sum(size) from w)::double / size rate from w where size > 0),
k as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) k from r),
p as (select source, k, sum(exp(case when k = 0 then 0 else k * ln(rate) - lgamma(k + 1.0) end - rate)) over (partition by source order by k) c from k),
u as (select doc_id, source, text, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint / pow(2, 52) u from documents),
n as (select doc_id, u.source, text, (select count(*) from p where p.source = u.source and c <= u) n from u)
select doc_id, source, copy::int copy, ('0x' || substr(md5('mix:order:' || doc_id || ':' || copy), 1, 15))::bigint shuffle_key, text
from (select doc_id, source, text, unnest(range(1, n + 1)) copy from n)
"""
