"""Import runs: started once, completed with a count, failed with a reason, processed once, published once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["tenant_id", "scope_key", "tool", "sha256"]


def start(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs to work on: new keys get a hashed id, failed or running ones start again under theirs, completed ones are left out."""
    old = runs.select(*KEY, F.col("import_run_id").alias("old_id"), "status")
    joined = reports.dropDuplicates(KEY).join(old, KEY, "left").where("status is null or status <> 'completed'")
    return joined.withColumn("import_run_id", F.coalesce("old_id", F.sha2(F.concat_ws("/", *KEY), 256))).drop("old_id", "status").withColumn("status", F.lit("running"))


def complete(runs: DataFrame, findings: DataFrame, finished_at) -> DataFrame:
    """runs as completed, with their finding counts; a report without findings counts 0."""
    counts = findings.groupBy("import_run_id").agg(F.count("*").alias("__n"))
    out = runs.join(counts, "import_run_id", "left")
    return out.withColumns({"status": F.lit("completed"), "finished_at": F.lit(finished_at), "finding_count": F.coalesce("__n", F.lit(0))}).drop("__n")


def fail(runs: DataFrame, reasons: DataFrame) -> DataFrame:
    """runs, those in reasons(import_run_id, reason) failed unless they're completed."""
    out = runs.join(reasons.select("import_run_id", F.col("reason").alias("why")), "import_run_id", "left")
    failed = F.col("why").isNotNull() & (F.col("status") != "completed")
    return out.withColumns({"status": F.when(failed, "failed").otherwise(F.col("status")), "reason": F.when(failed, F.col("why"))}).drop("why")


def unprocessed(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Events of runs that haven't been processed, each once."""
    return events.dropDuplicates(["tenant_id", "import_run_id"]).join(processed, ["tenant_id", "import_run_id"], "left_anti")


def split_events(events: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters with a reason): an event can be decoded, and needs a tenant, a run id, and a completed run of that tenant."""
    if "undecodable" not in events.columns:
        events = events.withColumn("undecodable", F.lit(None).cast("string"))
    r = runs.select(F.col("tenant_id").alias("r_tenant"), F.col("import_run_id").alias("r_id"), "status")
    j = events.join(r, (F.col("tenant_id") == F.col("r_tenant")) & (F.col("import_run_id") == F.col("r_id")), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(F.col("undecodable").isNotNull(), "undecodable").when(blank("tenant_id"), "no tenant").when(blank("import_run_id"), "no run id").when(F.col("r_id").isNull(), "unknown run").when(F.col("status") != "completed", "run is not completed")
    j = j.withColumn("reason", reason).drop("r_tenant", "r_id", "status")
    return j.where("reason is null").drop("reason", "undecodable"), j.where("reason is not null")


def to_publish(runs: DataFrame) -> DataFrame:
    """Completed runs whose event hasn't gone out."""
    return runs.where("status = 'completed' and event_published_at is null").select("import_run_id", "tenant_id", "product_id", "context_id", "tool", "scan_id")


def published(runs: DataFrame, events: DataFrame, at) -> DataFrame:
    """runs with event_published_at set for those in events; one that's set stays."""
    e = events.select("import_run_id", F.lit(True).alias("out")).distinct()
    return runs.join(e, "import_run_id", "left").withColumn("event_published_at", F.coalesce("event_published_at", F.when(F.col("out"), F.lit(at)))).drop("out")
