"""Components, ratings and CWEs of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_id(tenant: str = "tenant_id", purl: str = "component.purl"):
    """Hash of tenant and purl, so that reruns agree; null without a purl."""
    return F.when(F.coalesce(F.col(purl), F.lit("")) != "", F.sha2(F.concat_ws("|", tenant, purl), 256))


def new_components(findings: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Components to add: one for each tenant and purl that isn't there."""
    out = findings.select("tenant_id", component_id().alias("component_id"), "component.*").where("component_id is not null").dropDuplicates(["component_id"])
    return out if components is None else out.join(components.select("component_id"), "component_id", "left_anti")


def ratings(findings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each CVSS score, and for the scanner's own score with the tool as its source; distinct by its key. Negative scores aren't ratings. `also` names
    columns of the finding that come with its rows."""
    key = [*also, "tenant_id", "finding_id", "source", "scheme", "version", "vector"]
    cvss = F.transform("cvss", lambda c: F.struct(c["source"].alias("source"), F.lit("cvss").alias("scheme"), c["version"].alias("version"), c["vector"].alias("vector"), c["base_score"].alias("score")))
    own = F.struct(F.col("tool").alias("source"), F.lit("scanner").alias("scheme"), F.lit("").alias("version"), F.lit("").alias("vector"), F.col("scanner_score").alias("score"))
    rows = F.concat(F.coalesce(cvss, F.array()), F.when(F.col("scanner_score").isNotNull(), F.array(own)).otherwise(F.array()))
    return findings.select(*also, "tenant_id", "finding_id", F.inline(rows)).where("score >= 0").groupBy(*key).agg(F.min("score").alias("score"))


def finding_cwes(findings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return findings.select(*also, "tenant_id", "finding_id", F.explode("cwe").alias("cwe")).distinct()
