"""Pair scores: nine features agree, disagree or are unknown; weighted points give a confidence, a verdict and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.config import FEATURES, ScoringConfig
from findloom.functions.text import or_empty

REASON = "struct<feature:string,signal:string,points:int>"


RECORD = ("finding_id", "kind", "severity", "rule", "vuln", "component", "cwe", "path", "code", "line", "tool_uid")


def records(placed: DataFrame, *also: str) -> DataFrame:
    """What the scorer sees of a finding; code is hashed, as only its equality counts. `also` names columns that come with it."""
    return placed.select(
        *also, "finding_id", "kind", "severity", or_empty("rule_id").alias("rule"), F.when(or_empty("vuln_id") != "", F.concat_ws(":", or_empty("vuln_source"), "vuln_id")).otherwise("").alias("vuln"),
        or_empty("component.purl").alias("component"), F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"), "path", F.when(F.col("code") != "", F.md5("code")).otherwise("").alias("code"),
        F.col("line").cast("int").alias("line"), F.when((or_empty("tool") != "") & (or_empty("tool_finding_id") != ""), F.concat_ws("|", "tool", "tool_finding_id")).otherwise("").alias("tool_uid"),
    )


def _signals() -> dict[str, Column]:
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    plain = lambda c, none="": F.when((a(c) == F.lit(none)) | (b(c) == F.lit(none)), "unknown").when(a(c) == b(c), "agree").otherwise("disagree")
    return {
        "vuln": plain("vuln"), "component": plain("component"), "path": plain("path"), "code": plain("code"),
        "line": F.when((a("line") <= 0) | (b("line") <= 0), "unknown").when(a("line") == b("line"), "agree").otherwise("disagree"),
        "rule": plain("rule"),
        "cwe": F.when((F.size(a("cwe")) == 0) | (F.size(b("cwe")) == 0), "unknown").when(F.arrays_overlap(a("cwe"), b("cwe")), "agree").otherwise("disagree"),
        "severity": plain("severity", "unknown"), "tool-uid": plain("tool_uid"),
    }


def _points(feature: str, config: ScoringConfig) -> Column:
    def of(row: dict) -> Column:
        agree, disagree = row.get(feature, (0, 0))
        return F.when(F.col(f"s_{feature}") == "agree", agree).when(F.col(f"s_{feature}") == "disagree", disagree).otherwise(0)

    out = of(config.weights["default"])
    for kind, row in config.weights.items():
        if kind != "default":
            out = F.when(F.col("x.kind") == kind, of(row)).otherwise(out)
    return out


def score_pairs(pairs: DataFrame, recs: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """(a, b, points, confidence, verdict, reasons) for pairs (a, b); points are thousandths, reasons name every known feature, zero points too.

    Different kinds are separate with one reason. Symmetric: the order of a and b doesn't matter.
    """
    config = config or ScoringConfig()
    x, y = recs.alias("x"), recs.alias("y")
    both = pairs.select("a", "b").join(x, F.col("a") == F.col("x.finding_id")).join(y, F.col("b") == F.col("y.finding_id"))
    both = both.withColumns({f"s_{f}": s for f, s in _signals().items()})
    both = both.withColumns({f"p_{f}": _points(f, config) for f in FEATURES}).withColumn("same", F.col("x.kind") == F.col("y.kind"))
    total = sum((F.col(f"p_{f}") for f in FEATURES[1:]), F.col(f"p_{FEATURES[0]}"))
    points = F.when(F.col("same"), F.least(F.greatest(total, F.lit(0)), F.lit(1000))).otherwise(0).cast("int")
    known = F.array_compact(F.array(*[F.when(F.col(f"s_{f}") != "unknown", F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("signal"), F.col(f"p_{f}").cast("int").alias("points"))) for f in FEATURES]))
    one = F.array(F.struct(F.lit("kind").alias("feature"), F.lit("disagree").alias("signal"), F.lit(0).alias("points")))
    verdict = F.when(F.col("points") >= config.merge, "merge").when(F.col("points") >= config.review, "review").otherwise("separate")
    out = both.select("a", "b", points.alias("points"), F.when(F.col("same"), known).otherwise(one).alias("reasons"))
    return out.select("a", "b", "points", (F.col("points") / F.lit(1000)).cast("decimal(4,3)").alias("confidence"), verdict.alias("verdict"), "reasons")
