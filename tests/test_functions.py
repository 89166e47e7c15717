"""Normalising expressions against known cases."""

import pytest
from pyspark.sql import functions as F

from findloom.config import KINDS, ScoringConfig, SeverityPolicy, Strategy, ToolSpec, VulnFormat, path_rules, registry, standard_tools
from findloom.functions import cvss4, normal
from findloom.functions.scores import score_vector


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_vulnerability_ids(spark):
    got = values(spark, normal.vuln_id, [" cve-2021-44228 ", "GHSA-JFH8-c2jp-5V3Q", "bdu:2022-00001", "pysec-2021-5", "weird-1", "  ", None])
    assert [g and tuple(g) for g in got] == [("cve", "CVE-2021-44228"), ("ghsa", "GHSA-jfh8-c2jp-5v3q"), ("bdu", "BDU:2022-00001"), ("pysec", "PYSEC-2021-5"), ("unknown", "weird-1"), None, None]


def test_purls(spark):
    got = values(spark, normal.purl, ["pkg:npm/%40Scope/Pkg@1.0", "PKG:PyPI/My_Lib@2", "pkg:deb/Debian/x@1?distro=a&Arch=b+c&e=", "pkg:golang//x", "npm/x", "pkg:npm/a%zz", "pkg:maven/org.A/B@1#sub/x", ""])
    assert [g and g["purl"] for g in got] == ["pkg:npm/%40scope/pkg@1.0", "pkg:pypi/my-lib@2", "pkg:deb/debian/x@1?arch=b%2Bc&distro=a", None, None, None, "pkg:maven/org.A/B@1", None]


def test_cwes(spark):
    got = values(spark, normal.cwe_names, [["CWE-089: x", "external/cwe/cwe-22, CWE-79"], ["CWE-0"], ["none"], None], "array<string>")
    assert got == [["CWE-22", "CWE-79", "CWE-89"], [], [], []]
    assert values(spark, normal.cwe_is_bad, [["CWE-0"], ["none"], None], "array<string>") == [False, True, False]


def test_paths(spark):
    got = values(spark, normal.clean_path, ["/home/runner/work/a/b/src/x.js", "src\\a\\..\\b.js", "/opt/x", "/app/", "./", "", "/builds/g/p/q//r", "../x", "/../y"])
    assert got == ["src/x.js", "src/b.js", "/opt/x", "/app", ".", "", "q/r", "../x", "/y"]


def test_cvss(spark):
    got = values(spark, score_vector, ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "cvss:3.0/av:n/ac:l/pr:l/ui:r/s:c/c:l/i:l/a:n", "(AV:N/AC:L/Au:N/C:P/I:P/A:P)", "AV:N/AC:L", "CVSS:3.1/AV:N/AV:N", "CVSS:9.9/AV:N", None])
    assert [g and (g["version"], g["base_score"]) for g in got] == [("3.1", 9.8), ("3.0", 5.4), ("2.0", 7.5), None, None, None, None]
    assert got[2]["vector"] == "AV:N/AC:L/Au:N/C:P/I:P/A:P"


def test_severity(spark):
    assert values(spark, normal.label_severity, [" Moderate", "UNKNOWN", "x", None]) == ["medium", "unknown", None, None]
    assert values(spark, normal.score_severity, [9.0, 6.9, 0.0, 10.1, -1.0, float("nan"), None], "double") == ["critical", "medium", "info", None, None, "info", None]
    order = values(spark, lambda c: normal.severity_rank(c), ["info", "unknown", "low", "critical"])
    assert order == [1, 2, 3, 6]


def test_cvss4_parts():
    m = cvss4.parse("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H/E:X/S:P")
    assert cvss4.canonical(m).endswith("SA:H") and cvss4.levels(cvss4.effective(m)) == (0, 0, 0, 1, 0, 0)
    assert cvss4.base_score(m, {"000100": 10.0, "100100": 9.4, "010100": 9.5, "000101": 9.2, "001100": 9.4, "000200": 9.3, "000110": 9.6}) == 10.0
    assert cvss4.base_score(cvss4.parse("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:N/VI:N/VA:N/SC:N/SI:N/SA:N"), {}) == 0.0
    assert cvss4.parse("CVSS:4.0/AV:N") is None and cvss4.parse("CVSS:4.0/AV:Q") is None


def test_cvss4_in_the_chain(spark, tmp_path):
    """Without the published scores a vector of version 4 is unscored, not invalid; with a file that the session names it decides the severity."""
    import json

    from findloom.operators import flatten, normalize

    vector = "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H"
    vuln = {"VulnerabilityID": "CVE-2024-0001", "Severity": "LOW", "CVSS": {"nvd": {"V40Vector": vector, "V2Vector": "nonsense"}}}
    d = spark.createDataFrame([("trivy", "r", "t", json.dumps({"SchemaVersion": 2, "Results": [{"Target": "x", "Vulnerabilities": [vuln]}]}))], "tool string, import_run_id string, tenant_id string, content string")
    raw = flatten.stamped(flatten.route(d), "2020-01-01")
    row = normalize.normalize(raw).first()
    assert [x["code"] for x in row["diagnostics"]] == ["invalid_cvss", "unscored_cvss"] and row["severity"] == "low" and row["cvss"] == []
    scores = {"000100": 10.0, "100100": 9.4, "010100": 9.5, "000101": 9.2, "001100": 9.4, "000200": 9.3, "000110": 9.6}
    (tmp_path / "scores.json").write_text(json.dumps(scores))
    spark.conf.set(cvss4.SETTING, f"{tmp_path}/scores.json")
    row = normalize.normalize(raw).first()
    spark.conf.unset(cvss4.SETTING)
    assert [x["code"] for x in row["diagnostics"]] == ["invalid_cvss"] and row["severity"] == "critical" and [(x["version"], x["base_score"]) for x in row["cvss"]] == [("4.0", 10.0)]


def test_plain_function_as_policy(spark):
    from findloom.operators import normalize

    tools = registry(ToolSpec("own", "generic", ("severity",), lambda: F.lit("high")), ToolSpec("generic", "generic", ()))
    assert "severity@2" in tools["own"].lineage
    f = spark.createDataFrame([("own", "x"), ("else", "y")], "adapter string, finding_id string").selectExpr("*", "'' severity_raw", "cast(null as double) scanner_score", "array() cvss_raw0", "'' vuln_id_raw", "'' purl_raw", "cast(array() as array<string>) cwe_raw")
    f = f.selectExpr("*", "cast(array() as array<struct<source:string,vector:string>>) cvss_raw", "cast(array() as array<struct<level:string,code:string,message:string>>) diagnostics", "named_struct('uri', '', 'target', '') location")
    assert {r["finding_id"]: r["severity"] for r in normalize.normalize(f, tools).collect()} == {"x": "high", "y": "unknown"}


def test_config():
    assert standard_tools()["trivy"].lineage.endswith("cvss@1+severity@2(cvss>label;cvss=nvd,ghsa,redhat,bitnami)+vulnid@1+component@1+cwe@1+path@1")
    assert "sast" in KINDS and len(path_rules(["/a/", "/a/b/"])[0]) == 2
    s = Strategy("l0", "x", ("tool",), ("tool",))
    for bad in (lambda: ScoringConfig(review=900), lambda: ScoringConfig({"default": {"vuln": (-1, 0)}}), lambda: SeverityPolicy(("x",)), lambda: VulnFormat("", "A", "b"), lambda: path_rules(["a"]), lambda: ToolSpec("t", "sarif", ("nope",)), lambda: ToolSpec("t", "sarif", (), strategies=(s, s)), lambda: registry(ToolSpec("t", "sarif", ()), ToolSpec("t", "sarif", ()))):
        with pytest.raises(ValueError):
            bad()
