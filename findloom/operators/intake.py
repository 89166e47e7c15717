"""Intake: requests are checked, keyed and accepted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from findloom.functions.text import or_empty, or_null
from findloom.operators.fingerprint import scope_key

TOOL = r"^[a-z0-9][a-z0-9._-]{0,63}\z"
KEY = ["tenant_id", "scope_key", "tool", "sha256"]


def product_of(scope: Column) -> Column:
    """Before the first slash."""
    return F.substring_index(or_empty(scope), "/", 1)


def context_of(scope: Column) -> Column:
    """After the first slash, further slashes included; empty without one."""
    return F.regexp_extract(or_empty(scope), "(?s)^[^/]*/(.*)$", 1)


def checked(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests(arrival, tenant_id, tool, scope, scan_id, body) with product_id, context_id, scope_key, sha256, raw_key, size_bytes and reject_code (null: fine).

    tenants(id, max_report_bytes) is a dimension of one row a customer; Spark broadcasts it when its size allows.
    """
    t = tenants.select(F.col("id").alias("t_id"), "max_report_bytes")
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    r = requests.join(t, F.col("tenant_id") == F.col("t_id"), "left").withColumns({"product_id": product_of(F.col("scope")), "context_id": context_of(F.col("scope")), "size_bytes": size})
    code = (
        F.when(F.col("t_id").isNull(), "unauthorized").when((F.col("product_id") == "") | ~or_empty("tool").rlike(TOOL) | (F.col("size_bytes") == 0), "bad_request").when(F.col("size_bytes") > F.col("max_report_bytes"), "report_too_large")
    )
    r = r.withColumns({"reject_code": code, "scope_key": scope_key(), "sha256": F.sha2(F.col("body").cast("binary"), 256)})
    scan = F.coalesce(or_null("scan_id"), F.concat(F.lit("scan-"), F.substring(F.sha2(F.concat_ws("/", "tenant_id", "scope_key", "tool", "sha256", F.col("arrival").cast("string")), 256), 1, 32)))
    return r.withColumn("scan_id", scan).withColumn("raw_key", F.concat_ws("/", "tenant_id", "scan_id", "sha256")).drop("t_id", "max_report_bytes")


def accept(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new jobs, answers, events) for checked requests without a reject code and jobs(tenant_id, scope_key, tool, sha256, scan_id, raw_key, state).

    The first arrival of a key wins and later copies are answered with its scan_id; bodies don't move, only keys. Events go out for new jobs and for copies whose job is still pending.
    """
    keys = requests.where("reject_code is null").select("arrival", *KEY, "product_id", "context_id", "scan_id", "raw_key")
    first = keys.groupBy(*KEY).agg(F.min(F.struct("arrival", "scan_id", "raw_key", "product_id", "context_id")).alias("f"))
    old = jobs.select(*KEY, F.col("scan_id").alias("old_scan"), F.col("raw_key").alias("old_key"), "state")
    known = first.join(old, KEY, "left")
    new = known.where("old_scan is null").select(*KEY, "f.scan_id", "f.raw_key", "f.product_id", "f.context_id", F.lit("pending").alias("state"))
    decided = known.select(*KEY, F.coalesce("old_scan", "f.scan_id").alias("job_scan_id"), F.coalesce("old_key", "f.raw_key").alias("job_raw_key"), F.col("f.arrival").alias("first_arrival"), F.coalesce("state", F.lit("pending")).alias("state"), F.col("old_scan").isNull().alias("created"))
    answers = keys.drop("scan_id", "raw_key").join(decided, KEY).select("arrival", *KEY, F.col("job_scan_id").alias("scan_id"), (F.col("created") & (F.col("arrival") == F.col("first_arrival"))).alias("is_new"))
    events = decided.where("state = 'pending'").join(first.select(*KEY, "f.product_id", "f.context_id"), KEY)
    return new, answers, events.select(F.col("job_raw_key").alias("raw_key"), "tenant_id", "product_id", "context_id", "tool", F.col("job_scan_id").alias("scan_id"))


def first_wins(requests: DataFrame) -> DataFrame:
    """Checked requests without a reject code with `rank` of their arrival within the key; 1 is the job."""
    return requests.where("reject_code is null").withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy("arrival", "scan_id")))
