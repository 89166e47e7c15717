"""Read queries, backlogs and counters over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATE_BOUNDS = (0, 1, 2, 3, 5, 10, 25, 50, 100, 500, 1000)
CONFIDENCE_BOUNDS = tuple(i / 10 for i in range(1, 11))


def with_dimensions(findings: DataFrame, components: DataFrame, cwes: DataFrame) -> DataFrame:
    """findings with component columns (left) and cwes, a sorted array (text order)."""
    listed = cwes.groupBy("tenant_id", "finding_id").agg(F.sort_array(F.collect_list("cwe")).alias("cwes"))
    out = findings.join(components.withColumnRenamed("tenant_id", "c_tenant"), (F.col("tenant_id") == F.col("c_tenant")) & (findings["component_id"] == components["component_id"]), "left").drop("c_tenant", components["component_id"])
    return out.join(listed, ["tenant_id", "finding_id"], "left").withColumn("cwes", F.coalesce("cwes", F.array().cast("array<string>")))


def run_findings(findings: DataFrame, components: DataFrame, cwes: DataFrame, run_id: str) -> DataFrame:
    own = findings.where(F.col("import_run_id") == run_id)
    return with_dimensions(own, components, cwes.join(own.select("finding_id"), "finding_id", "left_semi")).orderBy("finding_id")


def findings_by_id(findings: DataFrame, components: DataFrame, cwes: DataFrame, ids: DataFrame) -> DataFrame:
    return with_dimensions(findings.join(ids.select("finding_id"), "finding_id", "left_semi"), components, cwes.join(ids.select("finding_id"), "finding_id", "left_semi"))


def clusters_of(members: DataFrame, ids: DataFrame) -> DataFrame:
    return members.join(ids.select("finding_id").distinct(), "finding_id").select("finding_id", "cluster_id")


def unprocessed_backlog(runs: DataFrame, processed: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: completed runs of the last days that aren't processed, and the oldest one's age in seconds (0 without one)."""
    recent = runs.where((F.col("status") == "completed") & (F.col("finished_at") >= now - F.expr(f"interval {days} days")))
    left = recent.join(processed.select("tenant_id", "import_run_id"), ["tenant_id", "import_run_id"], "left_anti")
    return left.agg(F.count("*").alias("n"), F.coalesce((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min("finished_at"))), F.lit(0)).alias("age_seconds"))


def unpublished_backlog(runs: DataFrame, now: Column) -> DataFrame:
    left = runs.where("status = 'completed' and event_published_at is null")
    return left.agg(F.count("*").alias("n"), F.coalesce((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min("finished_at"))), F.lit(0)).alias("age_seconds"))


def worst_findings(findings: DataFrame, k: int) -> DataFrame:
    """The k worst findings of each scope, by rank, then id."""
    w = W.partitionBy("tenant_id", "scope_key").orderBy(F.desc("severity_rank"), "finding_id")
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def top_ratings(ratings: DataFrame, k: int) -> DataFrame:
    """The k highest ratings of each scheme and source."""
    w = W.partitionBy("tenant_id", "scheme", "source").orderBy(F.desc("score"), "finding_id", "vector")
    return ratings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def by_cwe(cwes: DataFrame) -> DataFrame:
    return cwes.groupBy("tenant_id", "cwe").agg(F.count("*").alias("findings"))


def by_component(findings: DataFrame) -> DataFrame:
    return findings.where("component_id is not null").groupBy("tenant_id", "component_id").agg(F.count("*").alias("findings"))


def run_summary(findings: DataFrame, ratings: DataFrame, cwes: DataFrame) -> DataFrame:
    """By run: findings, component uses and components, rating rows and rated findings, CWE rows and findings with one, tool versions, rows with a rule and with a snippet."""
    run = findings.select("finding_id", "import_run_id")
    in_run = lambda d: d if "import_run_id" in d.columns else d.join(run, "finding_id")
    f = findings.groupBy("import_run_id").agg(
        F.count("*").alias("findings"), F.count("component_id").alias("component_uses"), F.count_distinct("component_id").alias("components"), F.array_join(F.sort_array(F.collect_set("tool_version")), ",").alias("tool_versions"),
        F.count_if(F.coalesce(F.col("rule_id"), F.lit("")) != "").alias("with_rule"), F.count_if(F.coalesce(F.col("location.snippet"), F.lit("")) != "").alias("with_snippet"),
    )
    r = in_run(ratings).groupBy("import_run_id").agg(F.count_if(F.col("scheme") == "cvss").alias("cvss_rows"), F.count_distinct(F.when(F.col("scheme") == "cvss", F.col("finding_id"))).alias("cvss_findings"))
    c = in_run(cwes).groupBy("import_run_id").agg(F.count("*").alias("cwe_rows"), F.count_distinct("finding_id").alias("cwe_findings"))
    return f.join(r, "import_run_id", "left").join(c, "import_run_id", "left").na.fill(0)


def prints_by_level(prints: DataFrame) -> DataFrame:
    return prints.groupBy("import_run_id", "level").agg(F.count("*").alias("n"))


def print_formats(prints: DataFrame) -> DataFrame:
    """Distinct (level, strategy, version) and whether all values have the form that they say."""
    fits = F.col("value").rlike(r"^v[0-9]+:l[0-9]:sha256:[0-9a-f]{64}\z") & F.col("value").startswith(F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(":"), "level", F.lit(":")))
    return prints.groupBy("level", "strategy", "version").agg(F.bool_and(fits).alias("well_formed"))


def shared_members(members: DataFrame, findings: DataFrame, run_id: str) -> DataFrame:
    """One row: members of a run, and those whose cluster has a member of another run."""
    m = members.select("cluster_id", "finding_id").join(findings.select("finding_id", "import_run_id"), "finding_id")
    own, other = m.where(F.col("import_run_id") == run_id), m.where(F.col("import_run_id") != run_id)
    shared = own.join(other.select("cluster_id").distinct().withColumn("seen", F.lit(True)), "cluster_id", "left")
    return shared.agg(F.count("*").alias("members"), F.count("seen").alias("shared"))


def shared_by_run(members: DataFrame, findings: DataFrame) -> DataFrame:
    """shared_members of every run at once."""
    m = members.select("finding_id", "cluster_id").join(findings.select("finding_id", "import_run_id"), "finding_id")
    several = m.groupBy("cluster_id").agg((F.min("import_run_id") < F.max("import_run_id")).alias("several"))
    return m.join(several, "cluster_id").groupBy("import_run_id").agg(F.count("*").alias("members"), F.count_if("several").alias("shared"))


def by_tool(counters: DataFrame, known=("trivy", "semgrep")) -> DataFrame:
    """Sums of all number columns by tool; tools that aren't registered are `other`."""
    tool = _tool(known)
    numbers = [c for c, t in counters.dtypes if t in ("int", "bigint") and c != "run_tool"]
    return counters.groupBy(tool.alias("tool")).agg(*[F.sum(c).cast("long").alias(c) for c in numbers])


def verdicts_by_tool(edges: DataFrame, findings: DataFrame | None = None, known=("trivy", "semgrep")) -> DataFrame:
    """Pairs of each verdict by the tool of their first finding: of findings by `a`, or edges' own run_tool; `pairs` says how many a row stands for, else it's one."""
    verdicts, n = ("merge", "review", "separate"), F.col("pairs") if "pairs" in edges.columns else F.lit(1)
    rows = edges if findings is None else edges.join(findings.select(F.col("finding_id").alias("a"), "run_tool"), "a")
    return rows.groupBy(_tool(known).alias("tool")).agg(*[F.sum(F.when(F.col("verdict") == v, n).otherwise(0)).cast("long").alias(v) for v in verdicts])


def clusters_by_tool(assignments: DataFrame, review: DataFrame, findings: DataFrame, unclustered: DataFrame | None = None, known=("trivy", "semgrep")) -> DataFrame:
    """Findings, clusters created (by the tool of the seed), findings that joined clusters, review pairs (by the first finding) and candidates without a cluster, by tool. review has (a, b),
    or run_tool and pairs."""
    of = findings.select("finding_id", "run_tool")
    n = F.col("pairs") if "pairs" in review.columns else F.lit(1)
    counted = lambda d, **own: d.select("run_tool", *[own.get(c, F.lit(0)).cast("long").alias(c) for c in ("findings", "created", "joined", "review", "unclustered")])
    rows = counted(assignments.join(of, "finding_id"), findings=F.lit(1), created=F.col("is_new") & (F.col("finding_id") == F.col("seed")), joined=~F.col("is_new"))
    rows = rows.unionByName(counted(review if "run_tool" in review.columns else review.join(of.withColumnRenamed("finding_id", "a"), "a"), review=n))
    if unclustered is not None:
        rows = rows.unionByName(counted(unclustered.join(of, "finding_id"), unclustered=F.lit(1)))
    return by_tool(rows, known)


def _tool(known) -> Column:
    return F.when(F.col("run_tool").isin(*known), F.col("run_tool")).otherwise("other")


def histogram(values: DataFrame, column: str, bounds=CANDIDATE_BOUNDS) -> DataFrame:
    """Rows (le, n): values up to each bound, cumulative, `+Inf` last, with sum and count on every row."""
    marks = [*[(F.lit(str(b)), F.count_if(F.col(column) <= b)) for b in bounds], (F.lit("+Inf"), F.count(column))]
    one = values.agg(F.array(*[F.struct(le.alias("le"), n.alias("n")) for le, n in marks]).alias("rows"), F.sum(column).alias("sum"), F.count(column).alias("count"))
    return one.select(F.inline("rows"), "sum", "count")


def by_state(rows: DataFrame, state: str) -> DataFrame:
    """Counts by a state column: runs by result, jobs by state."""
    return rows.groupBy(state).agg(F.count("*").alias("n"))
