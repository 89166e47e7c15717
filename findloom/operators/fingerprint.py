"""Fingerprints: places of findings, digests by level, skipped levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.config import FALLBACK, Strategy, ToolSpec, standard_tools
from findloom.functions.text import first_filled, or_empty


def scope_key(tenant: str = "tenant_id", product: str = "product_id", context: str = "context_id") -> Column:
    """Hex SHA-256 of tenant/product/context; the last slash stays when there's no context."""
    return F.sha2(F.concat_ws("/", *[or_empty(c) for c in (tenant, product, context)]), 256)


def with_place(findings: DataFrame) -> DataFrame:
    """findings with path (uri, else target), code (the snippet without white space), line (never negative) and component_key."""
    c = lambda name: F.col(f"component.{name}")
    return findings.withColumns({
        "path": F.coalesce(first_filled(F.col("location.uri"), F.col("location.target")), F.lit("")),
        "code": F.regexp_replace(or_empty("location.snippet"), r"(?U)\s+", ""),
        "line": F.greatest(F.coalesce("location.start_line", F.lit(0)), F.lit(0)),
        "component_key": F.coalesce(first_filled(c("purl")), F.concat_ws("/", *[or_empty(c(x)) for x in ("type", "namespace", "name", "version")])),
    })


def digest(level: str, version: int, fields: list[Column]) -> Column:
    """v<version>:<level>:sha256:<hex> of every field behind its length in bytes."""
    text = F.concat(*[F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields])
    return F.concat(F.lit(f"v{version}:{level}:sha256:"), F.sha2(text, 256))


def _value(s: Strategy) -> Column:
    ready = F.lit(True)
    for r in s.requires:
        ready = ready & (or_empty(r) != "")
    return F.when(ready, digest(s.level, s.version, [or_empty(f) for f in s.fields]))


def fingerprints(placed: DataFrame, tools: dict[str, ToolSpec] | None = None, tool: str = "run_tool") -> DataFrame:
    """A row for each finding and level that has a value; the tool of the run names the levels. placed comes from with_place."""
    return levels(placed, tools, tool).where("value is not null").select("tenant_id", "scope_key", "finding_id", "import_run_id", "level", "strategy", "version", "value")


def levels(placed: DataFrame, tools: dict[str, ToolSpec] | None = None, tool: str = "run_tool") -> DataFrame:
    """A row for each finding and level of its run's tool, with a null value where a required field is missing."""
    return placed.select("tenant_id", "scope_key", "finding_id", "import_run_id", F.col(tool).alias("run_tool"), F.inline(_own(tools, tool)))


def _own(tools: dict[str, ToolSpec] | None, tool: str) -> Column:
    """(level, strategy, version, value) of every level of the run's tool."""
    tools = tools or standard_tools()
    of = lambda t: F.array(*[F.struct(F.lit(s.level).alias("level"), F.lit(s.name).alias("strategy"), F.lit(s.version).alias("version"), _value(s).alias("value")) for s in t.strategies])
    own = of(tools[FALLBACK])
    for name, t in tools.items():
        if name != FALLBACK:
            own = F.when(F.col(tool) == name, of(t)).otherwise(own)
    return own


def keys(tools: dict[str, ToolSpec] | None = None, tool: str = "run_tool") -> Column:
    """The sorted (level, value) of a finding's fingerprints, on its row; a value is 128 bits, for comparing and not for tables."""
    short = F.transform(_own(tools, tool), lambda s: F.struct(s["level"].alias("level"), F.unhex(F.md5(s["value"])).alias("value")))
    return F.array_sort(F.array_distinct(F.filter(short, lambda s: s["value"].isNotNull())))


def skipped_levels(placed: DataFrame, tools: dict[str, ToolSpec] | None = None, tool: str = "run_tool") -> DataFrame:
    """By run and tool: findings, skipped values by level, and findings without any fingerprint."""
    return (
        levels(placed, tools, tool).groupBy("import_run_id", "run_tool", "finding_id")
        .agg(*[F.max(F.when((F.col("level") == x) & F.col("value").isNull(), 1).otherwise(0)).alias(f"skipped_{x}") for x in ("l0", "l1", "l2")], F.count("value").alias("values"))
        .groupBy("import_run_id", "run_tool")
        .agg(F.count("*").alias("findings"), *[F.sum(f"skipped_{x}").alias(f"skipped_{x}") for x in ("l0", "l1", "l2")], F.count_if(F.col("values") == 0).alias("unfingerprinted"))
    )


def diagnostics(placed: DataFrame, tools: dict[str, ToolSpec] | None = None, tool: str = "run_tool") -> DataFrame:
    """(tenant_id, scope_key, finding_id, level, code), each once: info fingerprint_level_skipped for each level without a value, warn no_fingerprint for findings without any."""
    rows = levels(placed, tools, tool)
    skipped = rows.where("value is null").select("tenant_id", "scope_key", "finding_id", F.lit("info").alias("level"), F.lit("fingerprint_level_skipped").alias("code"))
    none = rows.groupBy("tenant_id", "scope_key", "finding_id").agg(F.count("value").alias("n")).where("n = 0").select("tenant_id", "scope_key", "finding_id", F.lit("warn").alias("level"), F.lit("no_fingerprint").alias("code"))
    return skipped.distinct().unionByName(none)
