"""Reports to raw findings: SARIF and Trivy JSON by explicit schemas, anything else as one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.config import FALLBACK, ToolSpec, standard_tools
from findloom.functions.shapes import ANY, INTEGER, TEXT, MapOf, fits
from findloom.functions.text import first_filled, or_empty, trimmed

LOCATION = "struct<uri:string,target:string,start_line:int,start_column:int,end_line:int,end_column:int,snippet:string,package_type:string,package:string,installed_version:string,fixed_version:string,purl:string>"
DIAGNOSTICS = "array<struct<level:string,code:string,message:string>>"
RAW = f"tool_finding_id string, kind string, title string, description string, severity_raw string, vuln_id_raw string, purl_raw string, cvss_raw array<struct<source:string,vector:string>>, scanner_score double, tool_version string, rule_id string, cwe_raw array<string>, location {LOCATION}, raw string, diagnostics {DIAGNOSTICS}"
RULE = "struct<id:string,name:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:variant,tags:array<string>>>"
SARIF_RUNS = f"array<struct<tool:struct<driver:struct<version:string,semanticVersion:string,rules:array<{RULE}>>>,results:array<variant>>>"
TRIVY_RESULTS = "array<struct<Target:string,Type:string,Vulnerabilities:array<variant>,Misconfigurations:array<variant>,Secrets:array<variant>>>"
#: What a whole report has to look like, elements that are judged one by one being ANY; and those elements.
SARIF_SHAPE = {"version": TEXT, "runs": [{
    "tool": {"driver": {"version": TEXT, "semanticVersion": TEXT, "rules": [{"id": TEXT, "name": TEXT, "shortDescription": {"text": TEXT}, "defaultConfiguration": {"level": TEXT}, "properties": {"security-severity": ANY, "tags": [TEXT]}}]}},
    "results": [ANY],
}]}
RESULT_SHAPE = {
    "ruleId": TEXT, "ruleIndex": INTEGER, "level": TEXT, "message": {"text": TEXT},
    "locations": [{"physicalLocation": {"artifactLocation": {"uri": TEXT}, "region": {"startLine": INTEGER, "startColumn": INTEGER, "endLine": INTEGER, "endColumn": INTEGER, "snippet": {"text": TEXT}}}}],
}
TRIVY_SHAPE = {"SchemaVersion": INTEGER, "Trivy": {"Version": TEXT}, "Results": [{"Target": TEXT, "Type": TEXT, "Vulnerabilities": [ANY], "Misconfigurations": [ANY], "Secrets": [ANY]}]}
VULNERABILITY_SHAPE = {
    **dict.fromkeys(("VulnerabilityID", "PkgName", "InstalledVersion", "FixedVersion", "Severity", "Title", "Description"), TEXT),
    "CweIDs": [TEXT], "CVSS": MapOf(dict.fromkeys(("V2Vector", "V3Vector", "V40Vector"), TEXT)), "PkgIdentifier": {"PURL": TEXT},
}
NOT_JSON, WRONG_SHAPE = "report is not valid JSON", "report has a value of a wrong type"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _diagnostic(when: Column, code: str, message: str, level: str = "warn") -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(message).alias("message")))


def _diagnostics(*ds: Column) -> Column:
    return F.array_compact(F.array(*ds)).cast(DIAGNOSTICS)


def _place(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in LOCATION[7:-1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(LOCATION)


def _finding(**fields: Column) -> list[Column]:
    """All raw columns, those not given being null (diagnostics: none)."""
    out = []
    for part in RAW.replace(LOCATION, "L").replace(DIAGNOSTICS, "D").replace("array<struct<source:string,vector:string>>", "C").split(", "):
        name, kind = part.split(" ")
        kind = {"L": LOCATION, "D": DIAGNOSTICS, "C": "array<struct<source:string,vector:string>>"}.get(kind, kind)
        value = fields.get(name, F.array() if name == "diagnostics" else F.lit(None))
        out.append(value.cast(kind).alias(name))
    return out


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def reason(content: Column, shape) -> Column:
    """Why a report fails its run: it isn't JSON, or isn't of the shape; null if it's fine."""
    doc = F.try_parse_json(content.cast("string"))
    return F.when(doc.isNull(), NOT_JSON).when(~fits(doc, shape), WRONG_SHAPE)


def _parsed(reports: DataFrame, content: str, shape) -> DataFrame:
    """(kept, doc) of reports that have the shape: their other columns as a struct, so that no name clashes, and the report, parsed once."""
    kept = F.struct(*[F.col(f"`{c}`") for c in reports.columns if c != content]).alias("kept")
    doc = reports.select(kept, F.try_parse_json(F.col(content).cast("string")).alias("doc"))
    return doc.where(F.col("doc").isNotNull() & fits(F.col("doc"), shape))


def undecodable(reports: DataFrame, tools: dict[str, ToolSpec] | None = None, content: str = "content") -> DataFrame:
    """(import_run_id, reason) of reports(tool, ...) that their tool's format can't read; none of their findings are kept. A tool that isn't registered has no format, so
    its reports never fail, and neither do those of a format of the caller's own."""
    tools = tools or standard_tools()
    why = F.lit(None).cast("string")
    for name, tool in tools.items():
        if isinstance(tool.flatten, str) and tool.flatten in SHAPES:
            why = F.when(F.col("tool") == name, reason(F.col(content), SHAPES[tool.flatten])).otherwise(why)
    return reports.select("import_run_id", why.alias("reason")).where("reason is not null")


def _ordinal(outer: str, inner: Column) -> Column:
    """A finding's place in its report: 32 bits for its place in a run or target, where sections come after all findings."""
    return (F.shiftleft(F.col(outer).cast("long"), 32) + inner).alias("ordinal")


def _unknown_format() -> list[Column]:
    d = _diagnostics(_diagnostic(F.lit(True), "unknown_format", "report format isn't known"))
    return _finding(tool_finding_id=F.lit(""), kind=F.lit("unknown"), title=F.lit("unparsed report"), raw=F.lit("{}"), diagnostics=d)


def _by_case(*cases: tuple[Column, list[Column]]) -> list[Column]:
    """The columns of the first case that holds; the last one's otherwise. So a report is parsed and exploded once, whatever is in it."""
    names = [part.split(" ")[0] for part in RAW.replace(LOCATION, "L").replace(DIAGNOSTICS, "D").replace("array<struct<source:string,vector:string>>", "C").split(", ")]
    out = []
    for i, name in enumerate(names):
        value = cases[-1][1][i]
        for when, columns in reversed(cases[:-1]):
            value = F.when(when, columns[i]).otherwise(value)
        out.append(value.alias(name))
    return out


def sarif(reports: DataFrame, content: str = "content") -> DataFrame:
    """A row for each result of each run, with its report's other columns and `ordinal`; a report without a version gives one unparsed finding, one that isn't
    JSON or has a value of a wrong type none at all: `undecodable` names these.

    Rules are looked up before results are exploded, so a run's rules aren't copied to every result. A result that isn't an object or has a value of a wrong
    type at any depth becomes an `unparsed result`; null ones and null values are empty. Keys match in exact case; a report with trailing bytes isn't JSON.
    """
    r = _parsed(reports, content, SARIF_SHAPE)
    version = or_empty(_get(F.col("doc"), "version"))
    runs = r.select("kept", (version != "").alias("known"), version.alias("v"), F.when(version != "", F.try_variant_get("doc", "$.runs", SARIF_RUNS)).alias("runs"))
    nothing = F.array(F.get(F.col("runs"), F.lit(-1)))
    runs = runs.select("kept", "known", "v", F.posexplode(F.when(F.col("known"), F.col("runs")).otherwise(nothing)).alias("run_no", "run"))

    def with_rule(x: Column) -> Column:
        rules = F.col("run.tool.driver.rules")
        index = _get(x, "ruleIndex", "bigint")
        by_index = F.when((index >= 0) & (index < F.size(rules)), F.get(rules, index.cast("int")))
        by_id = F.get(F.filter(rules, lambda q: or_empty(q["id"]) == or_empty(_get(x, "ruleId"))), F.lit(0))
        return F.struct(x.alias("x"), F.coalesce(by_index, by_id).alias("rule"))

    results = F.transform(F.when(F.col("known"), F.col("run.results")).otherwise(F.array(F.lit(None).cast("variant"))), with_rule)
    results = runs.select("kept", "known", "v", "run_no", F.col("run.tool.driver").getField("version").alias("dv"), F.col("run.tool.driver.semanticVersion").alias("sv"), F.posexplode(results).alias("no", "r"))
    x, rule = F.col("r.x"), F.col("r.rule")
    fine = fits(x, RESULT_SHAPE)
    place = "locations[0].physicalLocation"
    uri = F.regexp_replace(or_empty(_get(x, f"{place}.artifactLocation.uri")), "^file://", "")
    part = lambda n: F.coalesce(_get(x, f"{place}.region.{n}", "int"), F.lit(0))
    snippet = or_empty(_get(x, f"{place}.region.snippet.text"))
    empty = (uri == "") & (part("startLine") == 0) & (part("startColumn") == 0) & (part("endLine") == 0) & (part("endColumn") == 0) & (snippet == "")
    score = trimmed(or_empty(_get(rule["properties"]["security-severity"], "")))
    text = lambda *cs: F.coalesce(first_filled(*cs), F.lit(""))
    version = _diagnostic(F.col("v") != "2.1.0", "sarif_version", "SARIF version isn't 2.1.0")
    good = _finding(
        tool_finding_id=F.concat_ws("|", or_empty(_get(x, "ruleId")), uri, part("startLine").cast("string"), part("startColumn").cast("string")), kind=F.lit("sast"),
        title=text(rule["shortDescription"]["text"], rule["name"], _get(x, "ruleId"), F.lit("unnamed finding")), description=or_empty(_get(x, "message.text")),
        severity_raw=text(_get(x, "level"), rule["defaultConfiguration"]["level"], F.lit("warning")), scanner_score=F.when(score.rlike(NUMBER), score.try_cast("double")), tool_version=text(F.col("dv"), F.col("sv")),
        rule_id=text(_get(x, "ruleId"), rule["id"]), cwe_raw=F.filter(rule["properties"]["tags"], lambda t: F.lower(or_empty(t)).contains("cwe")),
        location=F.when(~empty, _place(uri=uri, start_line=part("startLine"), start_column=part("startColumn"), end_line=part("endLine"), end_column=part("endColumn"), snippet=snippet)),
        raw=F.to_json(x), diagnostics=_diagnostics(_diagnostic(uri.startswith("/"), "absolute_path", "path is absolute"), version),
    )
    unparsed = _finding(tool_finding_id=F.lit(""), kind=F.lit("sast"), title=F.lit("unparsed result"), tool_version=text(F.col("dv"), F.col("sv")), raw=F.to_json(x), diagnostics=_diagnostics(_diagnostic(F.lit(True), "invalid_result", "result can't be read"), version))
    ordinal = _ordinal("run_no", F.col("no"))
    ok = results.withColumn("fine", F.coalesce(fine, F.lit(False)))
    return ok.select("kept.*", ordinal, *_by_case((~F.col("known"), _unknown_format()), (F.col("fine"), good), (F.lit(True), unparsed)))


def trivy(reports: DataFrame, content: str = "content") -> DataFrame:
    """A row for each vulnerability of each target, and one with only a count for a target's misconfigurations or secrets; values of secrets aren't copied. A report without a
    schema version gives one unparsed finding; see sarif() for what can't be read. A vulnerability with a value of a wrong type is an `unparsed vulnerability`."""
    r = _parsed(reports, content, TRIVY_SHAPE)
    v = F.coalesce(_get(F.col("doc"), "SchemaVersion", "bigint"), F.lit(0))
    r = r.select("kept", (v != 0).alias("known"), v.alias("v"), or_empty(_get(F.col("doc"), "Trivy.Version")).alias("tv"), F.when(v != 0, F.try_variant_get("doc", "$.Results", TRIVY_RESULTS)).alias("results"))
    nothing = F.array(F.get(F.col("results"), F.lit(-1)))
    targets = r.select("kept", "known", "v", "tv", F.posexplode(F.when(F.col("known"), F.col("results")).otherwise(nothing)).alias("t_no", "t"))
    targets = targets.withColumns({"target": or_empty("t.Target"), "type": or_empty("t.Type")})
    version = _diagnostic(F.col("v") != 2, "trivy_schema_version", "Trivy schema version isn't 2")
    absolute = _diagnostic(F.col("target").startswith("/"), "absolute_path", "target is absolute")
    x = F.col("x")
    none = F.lit(None).cast("variant")
    item = lambda no, x, name, n: F.struct(no.cast("long").alias("no"), x.alias("x"), name.cast("string").alias("name"), n.cast("int").alias("n"))
    items = F.transform(F.coalesce("t.Vulnerabilities", F.array().cast("array<variant>")), lambda x, i: item(i, x, F.lit(None), F.lit(None)))
    sections = [item(F.lit((1 << 31) + k), none, F.lit(n), F.coalesce(F.size(f"t.{s}"), F.lit(0))) for k, (n, s) in enumerate((("misconfigurations", "Misconfigurations"), ("secrets", "Secrets")))]
    items = F.concat(items, F.filter(F.array(*sections), lambda s: s["n"] > 0))
    items = F.when(F.col("known"), items).otherwise(F.array(item(F.lit(0), none, F.lit(None), F.lit(None))))
    vulns = targets.select("kept", "known", "v", "tv", "t_no", "target", "type", F.inline(items))
    fine = fits(x, VULNERABILITY_SHAPE)
    get = lambda n: or_empty(_get(x, n))
    sources = F.array_sort(F.map_entries(_get(x, "CVSS", "map<string,struct<V2Vector:string,V3Vector:string,V40Vector:string>>")))
    cvss = F.flatten(F.transform(sources, lambda s: F.transform(F.array(s["value"]["V3Vector"], s["value"]["V40Vector"], s["value"]["V2Vector"]), lambda w: F.struct(s["key"].alias("source"), w.alias("vector")))))
    cvss = F.filter(cvss, lambda c: or_empty(c["vector"]) != "")
    purl = get("PkgIdentifier.PURL")
    good = _finding(
        tool_finding_id=F.concat_ws("|", get("VulnerabilityID"), get("PkgName"), get("InstalledVersion"), F.col("target")), kind=F.lit("sca"),
        title=F.coalesce(first_filled(_get(x, "Title"), _get(x, "VulnerabilityID")), F.lit("unnamed vulnerability")), description=get("Description"), severity_raw=get("Severity"), vuln_id_raw=get("VulnerabilityID"),
        purl_raw=purl, cvss_raw=cvss, tool_version=F.col("tv"), cwe_raw=F.filter(_get(x, "CweIDs", "array<string>"), lambda t: F.lower(or_empty(t)).contains("cwe")),
        location=_place(target=F.col("target"), package_type=F.col("type"), package=get("PkgName"), installed_version=get("InstalledVersion"), fixed_version=get("FixedVersion"), purl=purl),
        raw=F.to_json(x), diagnostics=_diagnostics(absolute, version),
    )
    unparsed = _finding(tool_finding_id=F.lit(""), kind=F.lit("sca"), title=F.lit("unparsed vulnerability"), tool_version=F.col("tv"), raw=F.to_json(x), diagnostics=_diagnostics(_diagnostic(F.lit(True), "invalid_vulnerability", "vulnerability can't be read"), absolute, version))
    ordinal = _ordinal("t_no", F.col("no"))
    ok = vulns.withColumn("fine", F.coalesce(fine, F.lit(False)))
    summary = _finding(
        tool_finding_id=F.lit(""), kind=F.lit("unknown"), title=F.concat(F.lit("unsupported trivy section: "), "name"), tool_version=F.col("tv"),
        raw=F.to_json(F.struct(F.col("n").alias("count"), F.col("name").alias("section"), "target")),
        diagnostics=_diagnostics(_diagnostic(F.lit(True), "unsupported_section", "section isn't flattened"), version),
    )
    return ok.select("kept.*", ordinal, *_by_case((~F.col("known"), _unknown_format()), (F.col("name").isNotNull(), summary), (F.col("fine"), good), (F.lit(True), unparsed)))


def generic(reports: DataFrame, content: str = "content") -> DataFrame:
    """One `unparsed report` for each report, holding it if it's JSON and else its size in bytes, with the diagnostic `unknown_format`; it never fails."""
    keep = [c for c in reports.columns if c != content]
    text = F.col(content).cast("string")
    raw = F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit('{"bytes":'), F.coalesce(F.octet_length(content), F.lit(0)).cast("string"), F.lit("}")))
    return reports.select(*keep, F.lit(0).cast("long").alias("ordinal"), *_finding(tool_finding_id=F.lit(""), kind=F.lit("unknown"), title=F.lit("unparsed report"), raw=raw, diagnostics=_diagnostics(_diagnostic(F.lit(True), "unknown_format", "no format takes the report"))))


SHAPES = {"sarif": SARIF_SHAPE, "trivy": TRIVY_SHAPE}
FORMATS = {"sarif": sarif, "trivy": trivy, "generic": generic}


def route(reports: DataFrame, tools: dict[str, ToolSpec] | None = None) -> DataFrame:
    """Raw findings of reports(tool, content, ...), by each registered tool's format; others go to the fallback with an `unknown_tool` warning after the parser's."""
    tools = tools or standard_tools()
    named = [n for n in tools if n != FALLBACK]
    parts = [_format(tools[n])(reports.where(F.col("tool") == n)).withColumn("adapter", F.lit(n)) for n in named]
    other = _format(tools[FALLBACK])(reports.where(~F.coalesce(F.col("tool").isin(*named), F.lit(False)))).withColumn("adapter", F.lit(FALLBACK))
    unknown = _diagnostics(_diagnostic(or_empty("tool") != FALLBACK, "unknown_tool", "tool isn't registered"))
    out = other.withColumn("diagnostics", F.concat("diagnostics", unknown))
    for p in parts:
        out = p.unionByName(out)
    return out


def _format(tool: ToolSpec):
    return FORMATS[tool.flatten] if isinstance(tool.flatten, str) else tool.flatten


def stamped(raw: DataFrame, detected_at, tools: dict[str, ToolSpec] | None = None) -> DataFrame:
    """raw findings with finding_id (hash of run and ordinal), algo_version and one clock value."""
    tools = tools or standard_tools()
    lineage = F.coalesce(*[F.when(F.col("adapter") == n, F.lit(t.lineage)) for n, t in tools.items()])
    return raw.withColumns({"finding_id": F.sha2(F.concat_ws("/", "import_run_id", F.col("ordinal").cast("string")), 256), "algo_version": lineage, "detected_at": F.lit(detected_at)})
