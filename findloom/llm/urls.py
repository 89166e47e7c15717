"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm.common import ascii_lower, fresh, saved, table, without

#: Rules up to this many are broadcast; more are joined by a salted shuffle.
BROADCAST_RULES = 200_000
SALTS = 16
#: The rules of op3: host and path as one string, and the verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules given as (host/path, verdict) pairs, as a table of host, path, verdict."""
    rows = [F.struct(F.lit(r).cast("string").alias("rule"), F.lit(v).cast("string").alias("verdict")) for r, v in rules]
    df = spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast("array<struct<rule:string,verdict:string>>")))
    cut = F.regexp_extract("rule", "(?s)^([^/]*)(.*)$", 1)
    return df.select(ascii_lower(cut).alias("host"), F.regexp_extract("rule", "(?s)^([^/]*)(.*)$", 2).alias("path"), "verdict")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _depths(host: Column, path: Column) -> tuple[Column, Column]:
    """Labels of a rule's host (0: any host) and slashes of its path."""
    return F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))), F.length(path) - F.length(F.translate(path, "/", ""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, the winning rule (null if none fits) and the verdict (the rule's, else default).

    A rule fits its host and all subdomains when the URL's path starts with the rule's path. The longest rule wins; of rules as long,
    the one with the longer host, then block before allow. Each distinct (host, path) is expanded only to the (labels, slashes) depths
    that rules have, so no URL is cut short; paths are keyed up to their last slash and confirmed in full after the digests agree.
    Null and malformed URLs have empty host and path, and only a rule for any host fits them; they're joined with that one row where they are. Repeated rows all get their verdict; empty tables
    are allowed on either side; rules with a null host or path count as empty there, and a null verdict is dropped; input columns named
    host, path, rule or verdict are replaced. Up to BROADCAST_RULES rules are broadcast; beyond, both sides are salted.
    """
    spark = pages.sparkSession
    rules = rules.where("verdict is not null").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")], "verdict")
    n, m = _depths(F.col("host"), F.col("path"))
    rules = rules.select("host", "path", "verdict", n.alias("n"), m.alias("m"))
    count, depths = rules.agg(F.count("*"), F.collect_set(F.struct("n", "m"))).first()
    src = fresh(pages, "url")
    base = without(pages.withColumn(src, F.col(f"`{url}`")), "host", "path", "rule", "verdict", "url" if url in ("host", "path") else "rule")
    base = base.withColumns({"host": url_host(F.col(src)), "path": url_path(F.col(src))}).drop(src)

    keys = base.where("host <> '' or path <> ''").select("host", "path").distinct()
    blank = spark.range(1).select(F.lit("").alias("host"), F.lit("").alias("path"))
    keys = keys.unionByName(blank)  # URLs without a host are one key, and aren't shuffled
    hosts, slashes = _depths(F.col("host"), F.col("path"))
    key_of = lambda h, p, m: F.when(F.lit(m) == 0, F.lit("")).otherwise(F.concat(F.substring_index(p, "/", m), F.lit("/")))
    def expression(n: int, m: int) -> Column:
        host = F.lit("") if n == 0 else F.array_join(F.slice(F.split("host", r"\."), -n, n), ".")
        return F.when((hosts >= n) & (slashes >= m), _digest(host, key_of("host", F.col("path"), m)))

    exprs = keys.select("host", "path", F.explode(F.array_compact(F.array(*[expression(d["n"], d["m"]) for d in depths], F.lit(None).cast("string")))).alias("digest"))
    exprs = exprs.withColumn("short", _short(F.col("digest")))
    path_key = F.when(F.col("m") == 0, F.lit("")).otherwise(F.expr("concat(substring_index(path, '/', m), '/')"))
    right = rules.select(_digest(F.col("host"), path_key).alias("rule_digest"), F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), F.length("host").alias("rule_host"), "verdict")
    right = right.withColumn("rule_short", _short(F.col("rule_digest")))
    on = exprs["short"] == right["rule_short"]
    if count <= BROADCAST_RULES:
        right = F.broadcast(right)
    else:
        exprs = exprs.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
        right = right.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = (exprs["short"] == right["rule_short"]) & (exprs["salt"] == right["rule_salt"])
    found = exprs.join(right, on).where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule"), "rule_host", (F.col("verdict") == "block").alias("b"), "verdict", "rule")
    best = saved(found.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict"), "urls")
    named = lambda d, b: d.join(b, ["host", "path"], "left").select(*[d[f"`{c}`"] for c in d.columns], b["rule"], F.coalesce(b["verdict"], F.lit(default)).alias("verdict"))
    full, empty = base.where("host <> '' or path <> ''"), base.where("host = '' and path = ''")
    return named(full, best).unionByName(named(empty, F.broadcast(best.where("host = '' and path = ''"))))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with p as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f as (select page_id, rh || rp rule, v, row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc, v desc) k from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select h.page_id, host, path, rule, coalesce(v, 'allow') verdict from h left join f on h.page_id = f.page_id and k = 1
"""
