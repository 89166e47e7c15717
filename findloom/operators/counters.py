"""Counters of processed runs, from what a batch has computed anyway: a row for each run, counter and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.config import ToolSpec
from findloom.operators import fingerprint
from findloom.operators.reports import CANDIDATE_BOUNDS, CONFIDENCE_BOUNDS

ENTRIES = "array<struct<counter:string,label:string,n:bigint>>"


def _entry(counter: str, n: Column | int = 1, label: Column | str = "") -> Column:
    n, label = (F.lit(x) if isinstance(x, (int, str)) else x for x in (n, label))
    return F.struct(F.lit(counter).alias("counter"), label.cast("string").alias("label"), n.cast("long").alias("n"))


def _buckets(counter: str, value: Column, bounds, scale: int = 1) -> list[Column]:
    """Entries of a cumulative histogram, `+Inf` last, with the sum of values times scale."""
    own = [F.when(value <= b, _entry(f"{counter}_le", 1, str(b))) for b in bounds]
    return [*own, _entry(f"{counter}_le", 1, "+Inf"), _entry(f"{counter}_sum", (value * scale).cast("long"))]


def run_counters(now: DataFrame, pairs: DataFrame, edges: DataFrame, assigned: DataFrame, review: DataFrame, counts: DataFrame, tools: dict[str, ToolSpec] | None = None) -> DataFrame:
    """(tenant_id, scope_key, import_run_id, run_tool, counter, label, n) of a batch.

    findings, unfingerprinted, skipped (by level), verdict (pairs, by verdict), created and joined clusters, review pairs, unclustered candidates, and the histograms candidates_le
    (candidates of a finding) and confidence_le (thousandths in confidence_sum). now are the placed findings, pairs, edges and review those of classes, counts is
    candidate_counts. A pair counts for the run of its first end that is of the batch.
    """
    of = now.select("finding_id", "tenant_id", "scope_key", "import_run_id", "run_tool")
    levels = fingerprint.levels(now, tools).groupBy("finding_id").agg(F.collect_list(F.when(F.col("value").isNull(), _entry("skipped", 1, F.col("level")))).alias("gaps"), F.count("value").alias("values"))
    first = levels.select("finding_id", F.concat("gaps", F.array_compact(F.array(_entry("findings"), F.when(F.col("values") == 0, _entry("unfingerprinted"))))).alias("e"))
    end = lambda d: d.join(of.select(F.col("finding_id").alias("a"), F.lit(True).alias("is_a")), "a", "left").withColumn("finding_id", F.when(F.col("is_a"), F.col("a")).otherwise(F.col("b")))
    several = lambda d, e: end(d).groupBy("finding_id", *(["verdict"] if "verdict" in d.columns else [])).agg(F.sum("pairs").alias("pairs")).select("finding_id", F.array(e).alias("e"))
    created = F.when(F.col("is_new") & (F.col("finding_id") == F.col("seed")), _entry("created"))
    parts = [
        first,
        several(pairs.where("place = 'unclustered'").select("a", "b", "pairs"), _entry("unclustered", F.col("pairs"))),
        several(edges.select("a", "b", "verdict", "pairs"), _entry("verdict", F.col("pairs"), F.col("verdict"))),
        several(review.select("a", "b", "pairs"), _entry("review", F.col("pairs"))),
        assigned.select("finding_id", F.array_compact(F.array(created, F.when(~F.col("is_new"), _entry("joined")), *_buckets("confidence", F.col("points") / 1000, CONFIDENCE_BOUNDS, 1000))).alias("e")),
        counts.select("finding_id", F.array_compact(F.array(*_buckets("candidates", F.col("n_candidates"), CANDIDATE_BOUNDS))).alias("e")),
    ]
    rows = None
    for p in parts:
        p = p.select("finding_id", F.col("e").cast(ENTRIES).alias("e"))
        rows = p if rows is None else rows.unionByName(p)
    key = ["tenant_id", "scope_key", "import_run_id", "run_tool"]
    return rows.join(of, "finding_id").select(*key, F.inline("e")).groupBy(*key, "counter", "label").agg(F.sum("n").alias("n"))


def counters_by_tool(counters: DataFrame, known=("trivy", "semgrep")) -> DataFrame:
    """(tool, counter, label, n) over runs; tools that aren't registered are `other`."""
    tool = F.when(F.col("run_tool").isin(*known), F.col("run_tool")).otherwise("other")
    return counters.groupBy(tool.alias("tool"), "counter", "label").agg(F.sum("n").alias("n"))
