"""Scanner findings, reports and requests derived from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.operators.fingerprint import scope_key
from findloom.operators.flatten import DIAGNOSTICS, LOCATION
from findloom.sources.tables import spread

#: One raw finding for each lineitem; see FIXTURES.md section 2. The price makes finding_id unique at every scale. The custom scanner's findings share ids, with
#: lines and code that agree, differ or are missing, so that merges, reviews and pairs that keep groups apart all occur; some have no id.
FINDINGS = """
select
 concat_ws('-', lpad(cast(l_orderkey as string),8,'0'), lpad(cast(l_linenumber as string),2,'0'), lpad(cast(l_partkey as string),6,'0'), lpad(cast(l_suppkey as string),5,'0'), cast(cast(round(l_extendedprice*100) as bigint) as string)) as finding_id,
 concat('t', cast(c_nationkey % 2 as string)) as tenant_id,
 lower(c_mktsegment) as product_id,
 case when c_nationkey % 3 = 0 then '' else 'main' end as context_id,
 case l_suppkey % 3 when 0 then 'trivy' when 1 then 'semgrep' else 'custom-scanner' end as tool,
 concat('run-', cast(l_orderkey as string), '-', cast(l_suppkey % 3 as string)) as import_run_id,
 case l_suppkey % 3 when 0 then 'sca' when 1 then 'sast' else 'unknown' end as kind,
 case when l_suppkey % 3 <> 0 then '' else case l_partkey % 5
   when 0 then concat(' cve-2021-', lpad(cast(l_partkey as string),4,'0'), ' ')
   when 1 then concat('CVE-2022-', lpad(cast(l_partkey as string),5,'0'))
   when 2 then concat('ghsa-', upper(translate(lpad(cast(l_partkey as string),4,'0'),'0123456789','23456789cf')), '-PWQ2-XJ7Q')
   when 3 then concat('nswg-eco-', cast(l_partkey as string))
   else concat('SNYK-JS-', cast(l_partkey as string)) end end as vuln_id_raw,
 case when l_suppkey % 3 <> 0 then '' else concat(case p_size % 5
   when 0 then 'pkg:npm/%40Scope/' when 1 then 'pkg:pypi/' when 2 then 'pkg:golang/GitHub.com/Foo/' when 3 then 'pkg:maven/org.Apache/' else 'PKG:DEB/Debian/' end,
   replace(p_name,' ','_'), '@1.', cast(p_size as string), case when p_size % 5 = 4 then '?distro=debian-12&arch=amd64' else '' end) end as purl_raw,
 case l_suppkey % 3 when 0 then case substr(o_orderpriority,1,1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then ' Moderate ' when '4' then 'weird' else 'LOW' end
   when 1 then case l_linenumber % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'note' else 'none' end else '' end as severity_raw,
 case when l_suppkey % 3 = 1 and l_linenumber % 3 <> 0 then cast(l_partkey % 12 as double) end as scanner_score,
 case when l_suppkey % 3 = 1 then concat('rules.js-', cast(l_partkey % 50 as string)) else '' end as rule_id,
 case when l_suppkey % 3 = 1 then concat(case l_partkey % 4 when 0 then '/home/runner/work/repo/repo/src/f' when 1 then 'src/f' when 2 then './src/../lib//f' else '/opt/x/f' end, cast(l_partkey as string), '.js') when l_suppkey % 3 = 2 then concat('svc/m', cast(cast(floor(l_partkey / 4.0) as bigint) as string), '.go') else '' end as uri,
 case when l_suppkey % 3 = 0 then case l_partkey % 2 when 0 then '/app/package-lock.json' else 'package-lock.json' end else '' end as target,
 case when l_suppkey % 3 = 1 then 10 + 5 * (l_linenumber % 2) when l_suppkey % 3 = 2 then case l_linenumber % 4 when 0 then 0 when 1 then 10 else 15 end else 0 end as start_line,
 case when l_suppkey % 3 = 1 then concat(case when l_linenumber % 2 = 0 then '  eval( ' else 'eval(' end, 'input', cast(l_partkey as string), ')') when l_suppkey % 3 = 2 then case l_linenumber % 4 when 1 then 'open(x)' when 2 then 'close(y)' else '' end else '' end as snippet,
 case when l_partkey % 8 = 0 then '' else concat('c-', cast(cast(floor(l_partkey / 4.0) as bigint) as string)) end as custom_id,
 case l_suppkey % 3 when 0 then concat('CWE-', cast(l_partkey % 40 as string)) when 1 then concat('external/cwe/cwe-0', cast(l_partkey % 40 as string), ', CWE-79') else 'cwe-top25' end as cwe_raw,
 cast((l_partkey * 7919) % 2592 as int) as cvss3_code, p_name, p_size, l_partkey, l_orderkey, l_linenumber, o_orderdate
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
"""
#: Letters of the derived vectors, by mixed-radix digits of cvss3_code.
V3_DIGITS = (("AV", "NALP", 1), ("AC", "LH", 4), ("PR", "NLH", 8), ("UI", "NR", 24), ("S", "UC", 48), ("C", "HLN", 96), ("I", "HLN", 288), ("A", "HLN", 864))
V2_DIGITS = (("AV", "LAN", 1), ("AC", "HML", 3), ("AU", "MSN", 9), ("C", "NPC", 27), ("I", "NPC", 81), ("A", "NPC", 243))


def digit(letters: str, place: int, code: str = "cvss3_code") -> str:
    """SQL for a metric's letter."""
    return f"substr('{letters}', cast(floor({code} / {place}.0) as int) % {len(letters)} + 1, 1)"


def vector(digits, head: str = "", code: str = "cvss3_code") -> str:
    """SQL for a vector."""
    parts = [f"'{'/' if i else head}{'Au' if k == 'AU' else k}:', {digit(letters, place, code)}" for i, (k, letters, place) in enumerate(digits)]
    return f"concat({', '.join(parts)})"


V3_VECTOR, V2_VECTOR = vector(V3_DIGITS, "CVSS:3.1/"), vector(V2_DIGITS, code="(cvss3_code % 729)")


#: Keys of the tables that findings and requests come from; the others are looked up in.
FACTS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table(), its rows over all cores."""
    return spread(table(spark, sf_dir, name), *FACTS[name])


def derived(spark: SparkSession, sf_dir: str, sql: str = FINDINGS) -> DataFrame:
    names = [n for n in ("lineitem", "orders", "customer", "part") if f" {n} " in sql or f" {n}\n" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n")
    return spark.sql(sql, **{n: (facts if n == names[0] else table)(spark, sf_dir, n) for n in names})


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat findings as the parsers would give them."""
    f = derived(spark, sf_dir)
    lit = lambda c: F.col(c)
    names = {"uri": lit("uri"), "target": lit("target"), "start_line": lit("start_line"), "snippet": lit("snippet")}
    fields = [x.split(":")[0] for x in LOCATION[7:-1].split(",")]
    location = F.struct(*[names.get(n, F.lit(None)).alias(n) for n in fields]).cast(LOCATION)
    cvss = F.when(F.col("tool") == "trivy", F.expr(f"array(named_struct('source', 'nvd', 'vector', {V3_VECTOR}), named_struct('source', 'redhat', 'vector', {V2_VECTOR}))"))
    own_id = F.when(F.col("tool") == "trivy", F.concat_ws("|", "vuln_id_raw", "p_name", F.concat(F.lit("1."), F.col("p_size").cast("string")), "target")).when(F.col("tool") == "semgrep", F.concat_ws("|", "rule_id", "uri", F.col("start_line").cast("string"), F.lit("0"))).otherwise(F.col("custom_id"))
    adapter = F.when(F.col("tool").isin("trivy", "semgrep"), F.col("tool")).otherwise("generic")
    return f.withColumns({
        "location": location, "cvss_raw": F.coalesce(cvss, F.array().cast("array<struct<source:string,vector:string>>")), "tool_finding_id": own_id, "cwe_raw": F.array("cwe_raw"), "adapter": adapter, "run_tool": F.col("tool"),
        "diagnostics": F.array().cast(DIAGNOSTICS), "scope_key": scope_key(), "tool_version": F.lit("1.0"),
    })


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake requests from orders: bodies repeat, and some tools, scopes and tenants are bad."""
    return derived(spark, sf_dir, REQUESTS)


REQUESTS = """
select o_orderkey as arrival,
 case when o_orderkey % 101 = 0 then 'nobody' else concat('t', cast(o_custkey % 3 as string)) end as tenant_id,
 case when o_orderkey % 37 = 0 then 'BAD!' when o_orderkey % 2 = 0 then 'trivy' else 'semgrep' end as tool,
 case when o_orderkey % 41 = 0 then '/context-only' when o_custkey % 2 = 0 then 'payments/prod' else 'billing' end as scope,
 case when o_orderkey % 5 = 0 then '' else concat('scan-', cast(o_orderkey as string)) end as scan_id,
 case when o_orderkey % 53 = 0 then '' when o_orderkey % 59 = 0 then repeat('x', 101) else concat('{"order": ', cast(o_orderkey % 997 as string), '}') end as body
from orders where o_orderkey is not null
"""
TENANTS = [("t0", 100), ("t1", 100), ("t2", 101)]


def tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANTS, "id string, max_report_bytes long")


def joined(a: Column) -> Column:
    """An array as text, for flat results."""
    return F.array_join(a, ",")


#: Reports by tool as (JSON, whether its run fails and why), and elements of reports as (JSON, title of the finding); `#` stands for the order's key. Keys are sorted, as in
#: the JSON that comes out.
NOT_JSON, WRONG = "report is not valid JSON", "report has a value of a wrong type"
REPORTS = {
    "trivy": (
        ('{"half":', NOT_JSON), ('{"Results":{"a":1},"SchemaVersion":2}', WRONG), ('{"SchemaVersion":"2"}', WRONG), ('{"Results":[{"Target":7}],"SchemaVersion":2}', WRONG), ('{"SchemaVersion":2,"Trivy":{"Version":5}}', WRONG), ('{"SchemaVersion":2.0}', WRONG),
        ('{"Other":[1],"Results":[null,{"Target":null,"Vulnerabilities":null}],"SchemaVersion":2}', None), ('{"Results":[{"Vulnerabilities":{"a":1}}],"SchemaVersion":2}', WRONG), ("null", None), ("[]", WRONG), ('{"whole":1}', None), ('{"Results":[{"Secrets":"x"}],"SchemaVersion":2}', WRONG),
    ),
    "semgrep": (
        ("plain", NOT_JSON), ('{"version":2.1}', WRONG), ('{"runs":[{"tool":{"driver":{"rules":[{"id":5}]}}}],"version":"2.1.0"}', WRONG), ('{"runs":[{"results":[5,null]}],"version":"2.1.0"}', None), ('{"runs":[{"tool":{"driver":{"rules":[{"properties":{"security-severity":7,"tags":null}},null]}}}],"version":"2.1.0"}', None),
        ('{"runs":[{"tool":{"driver":{"rules":[{"properties":{"tags":[7]}}]}}}],"version":"2.1.0"}', WRONG), ('{"runs":{},"version":"2.1.0"}', WRONG), ('"text"', WRONG),
    ),
    "homegrown": (("plain text", None), ('{"half":', None), ('{"whole":1}', None)),
}
ELEMENTS = {
    "trivy": (
        ('{"CweIDs":["CWE-7"],"VulnerabilityID":"V#"}', "V#"), ('{"CweIDs":[79]}', None), ('{"PkgIdentifier":{"PURL":5}}', None), ('{"CVSS":{"nvd":{"V3Vector":5}}}', None), ('{"CVSS":{"nvd":"x"}}', None), ('{"CVSS":{"nvd":null},"CweIDs":[null,"x"],"Severity":null}', "unnamed vulnerability"),
        ("null", "unnamed vulnerability"), ('"no"', None), ("[]", None), ("7", None), ('{"Severity":true,"Title":"T"}', None), ('{"Extra":{"a":[1]},"Title":"T#"}', "T#"),
    ),
    "semgrep": (
        ('{"ruleId":"r#"}', "r#"), ('{"locations":[5]}', None), ('{"locations":[{"physicalLocation":{"region":{"startLine":"12"}}}]}', None), ('{"locations":[{"physicalLocation":{"region":{"startLine":1.5}}}]}', None), ('{"locations":[{"physicalLocation":{"region":{"snippet":"x"}}}]}', None), ('{"ruleIndex":true}', None),
        ('{"message":"m"}', None), ("null", "unnamed finding"), ('{"locations":null,"message":null}', "unnamed finding"), ('{"locations":[null,{"physicalLocation":{"region":{"startLine":12}}}]}', "unnamed finding"), ("true", None),
    ),
}


def choice(values, key: str = "n") -> str:
    """SQL for one of the texts (or nulls) by a key."""
    text = lambda v: "null" if v is None else "replace('" + v.replace("'", "''") + f"', '#', cast({key} as string))"
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {text(v)}" for i, v in enumerate(values)) + " end"


def by_tool(choices: dict, part: int, key: str = "n") -> str:
    """SQL for a report or element (part 0), or what becomes of it (part 1), by the column tool."""
    return "case tool " + " ".join(f"when '{t}' then {choice([c[part] for c in cs], key)}" for t, cs in choices.items()) + " end"
