"""Reports to findings: the cases that differ from plain ones."""

import json

from pyspark.sql import functions as F

from findloom.operators import flatten, normalize
from findloom.streaming import jobs  # noqa: F401


def reports(spark, *docs, tool="trivy"):
    return spark.createDataFrame([(f"r{i}", tool, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "import_run_id string, tool string, content string")


def codes(row):
    return [d["code"] for d in row["diagnostics"]]


def test_trivy(spark):
    doc = {"SchemaVersion": 2, "Trivy": {"Version": "1"}, "Results": [{"Target": "/app/x", "Type": "npm", "Vulnerabilities": [
        {"VulnerabilityID": "CVE-2024-0001", "PkgName": "a", "InstalledVersion": "1", "Severity": "HIGH", "CweIDs": ["CWE-79", "x"], "CVSS": {"redhat": {"V2Vector": "v2", "V3Vector": "v3"}, "nvd": {"V40Vector": "v4", "V3Vector": " "}}}, {"VulnerabilityID": 7}, "no"],
        "Secrets": [{"Match": "hunter2"}], "Misconfigurations": []}]}
    rows = flatten.trivy(reports(spark, doc, {"x": 1}, {"SchemaVersion": 3, "Results": [{"Vulnerabilities": [{}]}]})).orderBy("import_run_id", "ordinal").collect()
    first = rows[0]
    assert first["tool_finding_id"] == "CVE-2024-0001|a|1|/app/x" and first["title"] == "CVE-2024-0001" and codes(first) == ["absolute_path"] and first["cwe_raw"] == ["CWE-79"]
    assert [(c["source"], c["vector"]) for c in first["cvss_raw"]] == [("nvd", " "), ("nvd", "v4"), ("redhat", "v3"), ("redhat", "v2")]
    assert [r["title"] for r in rows[1:3]] == ["unparsed vulnerability"] * 2 and codes(rows[1]) == ["invalid_vulnerability", "absolute_path"]
    assert json.loads(rows[3]["raw"]) == {"section": "secrets", "count": 1, "target": "/app/x"} and rows[3]["title"] == "unsupported trivy section: secrets" and rows[3]["location"] is None and "hunter2" not in str(rows[3])
    assert codes(rows[4]) == ["unknown_format"] and rows[4]["raw"] == "{}"
    assert rows[5]["title"] == "unnamed vulnerability" and codes(rows[5]) == ["trivy_schema_version"]


def test_sarif(spark):
    rule = {"id": "r1", "name": "N", "defaultConfiguration": {"level": "error"}, "properties": {"security-severity": "8.5", "tags": ["x", "CWE-79: y"]}}
    place = {"physicalLocation": {"artifactLocation": {"uri": "file:///a/b.js"}, "region": {"startLine": 3, "snippet": {"text": "eval( x )"}}}}
    results = [{"ruleIndex": 0, "message": {"text": "m"}, "locations": [place]}, {"ruleId": "r1", "level": "note"}, {"ruleId": "zz"}, {"level": 3}, [1]]
    doc = {"version": "2.0.0", "runs": [{"tool": {"driver": {"semanticVersion": "9", "rules": [rule]}}, "results": results}]}
    rows = flatten.sarif(reports(spark, doc, {}, tool="semgrep")).orderBy("import_run_id", "ordinal").collect()
    assert rows[0]["tool_finding_id"] == "|/a/b.js|3|0" and rows[0]["rule_id"] == "r1" and rows[0]["severity_raw"] == "error" and rows[0]["scanner_score"] == 8.5 and rows[0]["title"] == "N"
    assert codes(rows[0]) == ["absolute_path", "sarif_version"] and rows[0]["cwe_raw"] == ["CWE-79: y"] and rows[0]["tool_version"] == "9"
    assert rows[1]["severity_raw"] == "note" and rows[1]["location"] is None
    assert rows[2]["title"] == "zz" and rows[2]["severity_raw"] == "warning"
    assert [r["title"] for r in rows[3:5]] == ["unparsed result"] * 2 and codes(rows[5]) == ["unknown_format"]


def test_generic_and_route(spark):
    rows = flatten.route(reports(spark, "{", '{"a": 1.10}', tool="own")).orderBy("import_run_id").collect()
    assert [r["raw"] for r in rows][0] == '{"bytes":1}' and [codes(r) for r in rows] == [["unknown_format", "unknown_tool"]] * 2 and rows[0]["adapter"] == "generic"


def test_chain_twice_is_the_same(spark):
    doc = {"SchemaVersion": 2, "Results": [{"Target": "/app/x", "Vulnerabilities": [{"VulnerabilityID": "bad id", "Severity": "?", "CweIDs": ["cwe-x"], "PkgIdentifier": {"PURL": "nope"}, "CVSS": {"n": {"V3Vector": "bad"}}}]}]}
    once = normalize.normalize(flatten.stamped(flatten.route(reports(spark, doc)), "2020-01-01"))
    twice = normalize.normalize(once.drop("cvss", "severity", "vuln_source", "vuln_id", "component", "cwe", "severity_rank"))
    a, b = once.first(), twice.select(*once.columns).first()
    assert a == b and sorted(codes(a)) == sorted(["absolute_path", "invalid_cvss", "unknown_severity", "unknown_vuln_id_format", "invalid_purl", "invalid_cwe"])
    assert a["location"]["target"] == "x" and a["severity"] == "unknown"


def test_streams(spark, tmp_path):
    """Requests through all three streams; everything again changes nothing."""
    from findloom.sources.tables import Tables, read_events

    t = Tables(spark, f"{tmp_path}/tables")
    doc = json.dumps({"SchemaVersion": 2, "Results": [{"Target": "x", "Vulnerabilities": [{"VulnerabilityID": "CVE-2024-0001", "PkgName": "a", "Severity": "HIGH", "PkgIdentifier": {"PURL": "pkg:npm/a@1"}}]}]})
    schema = "arrival long, tenant_id string, tool string, scope string, scan_id string, body string"
    tenants = spark.createDataFrame([("acme", 1000)], "id string, max_report_bytes long")
    rows = [(1, "acme", "trivy", "pay/prod", "s1", doc), (2, "acme", "trivy", "pay/prod", "s2", doc), (3, "acme", "trivy", "pay/prod", "s3", doc + " "), (4, "acme", "BAD!", "pay", "s", doc), (5, "acme", "trivy", "pay/prod", "s5", "{")]

    def feed(n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        jobs.intake_stream(read_events(spark, f"{tmp_path}/in", schema), t, tenants, f"{tmp_path}/e1", f"{tmp_path}/c1").awaitTermination()
        jobs.normalize_stream(read_events(spark, f"{tmp_path}/e1/*"), t, f"{tmp_path}/e2", f"{tmp_path}/c2").awaitTermination()
        jobs.cluster_stream(read_events(spark, f"{tmp_path}/e2/*"), t, f"{tmp_path}/c3").awaitTermination()
        return {name: t.read(name).count() for name in ("jobs", "runs", "findings", "components", "fingerprints", "clusters", "members", "processing_runs")}

    first = feed(1)
    assert first == {"jobs": 3, "runs": 3, "findings": 2, "components": 1, "fingerprints": 4, "clusters": 1, "members": 2, "processing_runs": 2}
    assert t.read("runs").where(F.col("status") == "failed").count() == 1
    assert feed(2) == first
