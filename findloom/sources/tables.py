"""Raw reports, normalised tables and event streams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

RAW_KEY = ["tenant_id", "scan_id", "sha256"]
#: Tables and their keys.
KEYS = {
    "findings": ["tenant_id", "finding_id"], "components": ["tenant_id", "component_id"], "ratings": ["tenant_id", "finding_id", "source", "scheme", "version", "vector"],
    "cwes": ["tenant_id", "finding_id", "cwe"], "fingerprints": ["tenant_id", "finding_id", "level"], "clusters": ["tenant_id", "cluster_id"], "members": ["tenant_id", "finding_id"],
    "processing_runs": ["tenant_id", "import_run_id"], "dead_letters": [], "run_counters": ["tenant_id", "import_run_id", "counter", "label"], "finding_diagnostics": ["tenant_id", "finding_id", "code", "level"],
}


@dataclass(frozen=True)
class Log:
    """A table of states: every change is a row that is added, and a reader takes one row for each key.

    The row of the highest rank is the state, of those the one written last; of the columns in `first` the earliest written value counts, and of those in
    `once` the first value that isn't null.
    """

    key: tuple[str, ...]
    rank: str
    first: tuple[str, ...] = ()
    once: tuple[str, ...] = ()


#: Whoever accepted a report first named its scan, and a job that is done stays so; a completed run is never anything else again, and its event has gone out for good.
LOGS = {
    "jobs": Log(("tenant_id", "scope_key", "tool", "sha256"), "case state when 'done' then 3 when 'dead' then 2 when 'running' then 1 else 0 end", ("scan_id", "raw_key", "product_id", "context_id")),
    "runs": Log(("tenant_id", "import_run_id"), "case when status = 'completed' then 1 else 0 end", (), ("event_published_at",)),
}
#: Tables with a scope_key are also split by a bucket of it; a batch that touches up to PLACES tenants and buckets names them in its reads.
BUCKETS, PLACES = 32, 1000
WRITTEN = ("written_at", "written_by")
UNDECODABLE = "undecodable"
EVENT = "raw_key string, import_run_id string, tenant_id string, product_id string, context_id string, tool string, scan_id string, job_id string"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Files at <path>/tenant/scan/sha256, one row each: the key's parts, content and size."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return f.select(part(-3).alias("tenant_id"), part(-2).alias("scan_id"), part(-1).alias("sha256"), "content", F.col("length").alias("size_bytes"))


def write_raw(reports: DataFrame, path: str) -> None:
    """Appends reports whose (tenant, scan, sha256) isn't there; the same key again changes nothing. Only their tenants' keys are read."""
    spark, new = reports.sparkSession, reports.dropDuplicates(RAW_KEY)
    if _there(spark, path):
        new = new.join(within(read_parts(spark, path), new.select("tenant_id")).select(*RAW_KEY), RAW_KEY, "left_anti")
    new.write.mode("append").partitionBy("tenant_id").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A table by tenant and bucket; a tenant 007 isn't taken for a number."""
    kinds = {"tenant_id": StringType(), "scope_bucket": IntegerType()}
    fields = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in fields])).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether there is data; a partitioned table without rows has no files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/[!_.]*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def scope_bucket() -> Column:
    return F.pmod(F.xxhash64("scope_key"), F.lit(BUCKETS)).cast("int")


class Tables:
    """The normalised tables under one folder, as Parquet by tenant and bucket of the scope. Nothing that has been written is ever changed or replaced, so jobs that run at
    the same time can't lose each other's rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return _there(self.spark, self.path(name))

    def _stored(self, name: str, of: DataFrame | None) -> DataFrame:
        """All rows written, or those in the partitions that rows like `of` (with tenant_id, and scope_key or not) are in."""
        df = read_parts(self.spark, self.path(name))
        return df if of is None else within(df, of)

    def read(self, name: str, schema: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """The table without its bucket column, a row for each key if it's a log; an empty one of the schema if it isn't there. `of` has tenants, or tenants
        and scopes: only their partitions are read."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema or "tenant_id string")
        df = self._stored(name, of)
        if name in LOGS:
            df = latest(df, LOGS[name])
        return df.drop("scope_bucket", *WRITTEN)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows whose key isn't there, each key once; only the partitions that rows touch are looked at. A batch that runs again adds nothing."""
        key = KEYS[name]
        if key:
            rows = rows.dropDuplicates(key)
            if self.exists(name):
                rows = rows.join(self._stored(name, rows).select(*key), key, "left_anti")
        self._write(name, rows)

    def log(self, name: str, rows: DataFrame) -> None:
        """Adds states: a row for each key that changes. Two jobs that add at once both count, in the order of LOGS."""
        self._write(name, rows.withColumns({WRITTEN[0]: F.unix_micros(F.current_timestamp()), WRITTEN[1]: F.lit(uuid.uuid4().hex)}))

    def _write(self, name: str, rows: DataFrame) -> None:
        by = [c for c in ("tenant_id",) if c in rows.columns]
        if "scope_key" in rows.columns:
            rows, by = rows.withColumn("scope_bucket", scope_bucket()), [*by, "scope_bucket"]
        rows.write.mode("append").partitionBy(*by).parquet(self.path(name))


def latest(rows: DataFrame, log: Log) -> DataFrame:
    """A row for each key of a log; see Log."""
    others = [c for c in rows.columns if c not in log.key and c not in WRITTEN]
    order = F.struct(F.expr(log.rank).alias("rank"), *WRITTEN)
    out = rows.groupBy(*log.key).agg(F.max_by(F.struct(*others), order).alias("last"), *[F.min_by(F.struct(*log.first), F.struct(*WRITTEN)).alias("first")] * bool(log.first), *[F.min(c).alias(f"once_{c}") for c in log.once])
    pick = lambda c: F.col("first")[c] if c in log.first else F.col(f"once_{c}") if c in log.once else F.col("last")[c]
    return out.select(*log.key, *[pick(c).alias(c) for c in others])


def within(stored: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of `stored` that are in the partitions of `of`. Up to PLACES partitions are named in the filter, so that others aren't listed or read; more are joined."""
    by = [c for c in ("tenant_id", "scope_bucket") if c in stored.columns and (c == "tenant_id" or "scope_key" in of.columns)]
    if "scope_key" in of.columns:
        of = of.withColumn("scope_bucket", scope_bucket())
    for keys in (by, by[:1]):
        few = of.select(*keys).distinct().limit(PLACES + 1).collect()
        if len(few) <= PLACES:
            tenants: dict = {}
            for r in few:
                tenants.setdefault(r["tenant_id"], []).append(r[-1])
            one = lambda t: F.col("tenant_id").isNull() if t is None else F.col("tenant_id") == t
            parts = [one(t) & F.col("scope_bucket").isin(b) if len(keys) > 1 else one(t) for t, b in tenants.items()]
            return stored.where(reduce(lambda x, y: x | y, parts, F.lit(False)))
    return stored.join(of.select(*by).distinct(), by, "left_semi")


def read_events(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "json") -> DataFrame:
    """A stream of events from files of JSON or Parquet. A JSON line that can't be read has its text in `undecodable`."""
    s = spark.readStream.format(fmt)
    if fmt == "json":
        s, schema = s.option("columnNameOfCorruptRecord", UNDECODABLE), f"{schema}, {UNDECODABLE} string"
    return s.schema(schema).load(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores by its keys where its scan has few splits, such as one file with one row group: the chain behind it would run in one task. Large
    tables have several splits for each core and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 4 * cores else df
