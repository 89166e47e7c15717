"""The normalising chain of each tool, over raw findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.config import FALLBACK, ToolSpec, standard_tools
from findloom.functions import normal
from findloom.functions.cvss4 import configured, score_v4
from findloom.functions.scores import score_vector
from findloom.functions.text import or_empty, trimmed

CVSS = "array<struct<source:string,version:string,vector:string,base_score:double>>"
COMPONENT = "struct<purl:string,type:string,namespace:string,name:string,version:string>"


EMPTY = "array<struct<source:string,s:struct<version:string,vector:string,base_score:double>,vector:string>>"
#: The warnings of each step, in its own order, with the columns that say where they hold.
WARNINGS = {
    "cvss": (("__bad_cvss", "invalid_cvss", "a CVSS vector is invalid"), ("__unscored", "unscored_cvss", "CVSS 4 scores aren't loaded")),
    "severity": (("__bad_score", "invalid_score", "scanner score is outside 0..10"), ("__unknown", "unknown_severity", "no source gives a severity")),
    "vulnid": (("__bad_id", "unknown_vuln_id_format", "id format isn't known"),),
    "component": (("__bad_purl", "invalid_purl", "package URL is invalid"),),
    "cwe": (("__bad_cwe", "invalid_cwe", "an entry has no CWE number"),),
}


def score_cvss(findings: DataFrame, macro_scores: dict[str, float] | None = None, on: Column | None = None) -> DataFrame:
    """findings with cvss, in the order of cvss_raw, __bad_cvss: whether a vector is invalid (those are left out), and __unscored: whether one is of version 4 and
    macro_scores (see cvss4) aren't given; only where `on` holds.

    Versions 2 and 3 are expressions on the row. Version 4 is scored once for each distinct vector.
    """
    rows = F.transform("cvss_raw", lambda c: F.struct(c["source"].alias("source"), score_vector(c["vector"]).alias("s"), c["vector"].alias("vector")))
    f = findings.withColumn("__scored", F.coalesce(rows if on is None else F.when(on, rows), F.array().cast(EMPTY)))
    if macro_scores:
        v4 = f.select(F.explode("__scored").alias("x")).where("upper(x.vector) like '%CVSS:4.0/%'").select(F.col("x.vector").alias("vector")).distinct()
        v4 = score_v4(v4, macro_scores).where("s4 is not null").select("vector", "s4")
        used = f.select("finding_id", F.posexplode("__scored").alias("no", "x")).join(v4, F.col("x.vector") == F.col("vector"))
        found = used.groupBy("finding_id").agg(F.map_from_entries(F.collect_set(F.struct("no", "s4"))).alias("__v4"))
        f = f.join(found, "finding_id", "left")
        f = f.withColumn("__scored", F.transform("__scored", lambda x, i: x.withField("s", F.coalesce(x["s"], F.element_at("__v4", i))))).drop("__v4")
    four = lambda x: F.lit(False) if macro_scores else F.upper(F.coalesce(x["vector"], F.lit(""))).contains("CVSS:4.0/")
    good = F.filter("__scored", lambda x: x["s"].isNotNull())
    flat = F.transform(good, lambda x: F.struct(x["source"].alias("source"), x["s"]["version"].alias("version"), x["s"]["vector"].alias("vector"), x["s"]["base_score"].alias("base_score"))).cast(CVSS)
    return f.withColumns({"cvss": flat, "__bad_cvss": F.exists("__scored", lambda x: x["s"].isNull() & ~four(x)), "__unscored": F.exists("__scored", lambda x: x["s"].isNull() & four(x))}).drop("__scored")


def severity_of(tool: ToolSpec) -> tuple[Column, Column]:
    """(severity or null, whether the score is out of range and was asked for it) by a tool's policy: a SeverityPolicy, or a function without arguments that
    gives a column."""
    policy = tool.severity
    if callable(policy):
        return policy(), F.lit(False)
    early = "cvss" not in tool.steps or tool.steps.index("cvss") > tool.steps.index("severity")  # its scores aren't there yet
    of = lambda p: normal.policy_severity(p, F.col("severity_raw"), F.col("scanner_score"), F.array().cast(CVSS) if early else F.col("cvss"))
    before = policy.sources[: policy.sources.index("score")] if "score" in policy.sources else ()
    tried = of(type(policy)(before, policy.scales, policy.cvss_order)).isNull() if before else F.lit("score" in policy.sources)
    return of(policy), F.coalesce(tried & normal.score_is_bad(F.col("scanner_score")), F.lit(False))


def normalize(findings: DataFrame, tools: dict[str, ToolSpec] | None = None, macro_scores: dict[str, float] | None = None) -> DataFrame:
    """Every finding through the steps of its adapter, all in one pass; fields of steps that a tool lacks stay empty. Warnings stand in the order of the tool's
    steps, none twice; a second run changes nothing more. CVSS 4 scores come from macro_scores or from the file that the session names (cvss4.SETTING)."""
    tools, macro_scores = tools or standard_tools(), macro_scores or configured(findings.sparkSession)
    adapter = F.when(F.col("adapter").isin(*[n for n in tools if n != FALLBACK]), F.col("adapter")).otherwise(FALLBACK)
    f = findings.withColumn("__tool", adapter)

    def own(step: str) -> Column:
        return F.col("__tool").isin(*[n for n, t in tools.items() if step in t.steps])

    def by_tool(step: str, of) -> Column:
        cases = [(n, of(t)) for n, t in tools.items() if step in t.steps]
        return F.coalesce(*[F.when(F.col("__tool") == n, c) for n, c in cases]) if cases else F.lit(None)

    f = score_cvss(f, macro_scores, own("cvss"))
    severities = {n: severity_of(t) for n, t in tools.items() if "severity" in t.steps}
    f = f.withColumns({
        "severity": by_tool("severity", lambda t: severities[t.name][0]).cast("string"), "__bad_score": by_tool("severity", lambda t: severities[t.name][1]),
        "__v": F.when(own("vulnid"), normal.vuln_id(F.col("vuln_id_raw"))), "component": F.when(own("component"), normal.purl(F.col("purl_raw"))).cast(COMPONENT),
        "cwe": F.coalesce(F.when(own("cwe"), normal.cwe_names(F.col("cwe_raw"))), F.array().cast("array<string>")), "__bad_cwe": own("cwe") & normal.cwe_is_bad(F.col("cwe_raw")),
    })
    f = f.withColumns({
        "__unknown": F.col("severity").isNull(), "severity": F.coalesce("severity", F.lit("unknown")), "vuln_source": or_empty("__v.source"), "vuln_id": or_empty("__v.value"), "__bad_id": F.col("__v.source") == "unknown",
        "__bad_purl": F.col("component").isNull() & (trimmed(or_empty("purl_raw")) != ""),
    })
    loc = F.col("location")
    for name in sorted({x for t in tools.values() for x in t.path_fields}):
        cleaned = F.col("__tool").isin(*[n for n, t in tools.items() if name in t.path_fields])
        loc = loc.withField(name, F.when(cleaned, normal.clean_path(F.col(f"location.{name}"))).otherwise(F.col(f"location.{name}")))
    told = lambda x: F.when(F.col(x[0]), F.struct(F.lit("warn").alias("level"), F.lit(x[1]).alias("code"), F.lit(x[2]).alias("message")))
    warnings = F.coalesce(*[F.when(F.col("__tool") == n, F.array_compact(F.array(*[told(x) for s in t.steps for x in WARNINGS.get(s, ())]))) for n, t in tools.items() if set(t.steps) & WARNINGS.keys()], F.array())
    new = F.filter(warnings, lambda w: ~F.exists("diagnostics", lambda d: d["code"] == w["code"]))
    f = f.withColumns({"location": F.when(F.col("location").isNotNull(), loc), "diagnostics": F.concat("diagnostics", new), "severity_rank": normal.severity_rank(F.col("severity"))})
    return f.drop("__tool", "__v", *[x[0] for w in WARNINGS.values() for x in w])
