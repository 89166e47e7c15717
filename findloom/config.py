"""What a user may register: tools, severity policies, id formats, path prefixes, fingerprint strategies and scoring."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Names of severities by label, for general scanners and for SARIF levels.
GENERAL_SCALE = {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low", "info": "info", "informational": "info", "unknown": "unknown"}
SARIF_SCALE = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
#: Kinds of findings, and the order of severities.
KINDS = ("unknown", "sast", "dast", "sca", "secret", "iac", "container")
SEVERITY_RANK = {"info": 1, "unknown": 2, "low": 3, "medium": 4, "high": 5, "critical": 6}


@dataclass(frozen=True)
class VulnFormat:
    """An id format: the source it names, its prefix and body pattern (both in any case), and the case of the body: upper, lower or keep."""

    source: str
    prefix: str
    body: str
    case: str = "upper"

    def __post_init__(self):
        re.compile(self.body)
        if not self.source or not self.prefix or self.case not in ("upper", "lower", "keep"):
            raise ValueError(f"bad id format {self}")


#: The id formats, in the order they're tried.
VULN_FORMATS = (
    VulnFormat("cve", "CVE-", r"\d{4}-\d{4,}"),
    VulnFormat("ghsa", "GHSA-", r"([2-9cfghjmpqrvwx]{4}-){2}[2-9cfghjmpqrvwx]{4}", "lower"),
    VulnFormat("nswg", "NSWG-", r"[a-z]+-\d+"),
    VulnFormat("osv", "OSV-", r"\d{4}-\d+"),
    VulnFormat("pysec", "PYSEC-", r"\d{4}-\d+"),
    VulnFormat("bdu", "BDU:", r"\d{4}-\d{5}", "keep"),
)
#: Build folders cut from absolute paths; * stands for one segment.
PATH_PREFIXES = ("/home/runner/work/*/*/", "/github/workspace/", "/builds/*/*/", "/workspace/", "/src/", "/app/")


def path_rules(prefixes=PATH_PREFIXES) -> list[list[str]]:
    """Prefixes as segments, the longest first."""
    rules = []
    for p in prefixes:
        segments = p.strip("/").split("/")
        if not p.startswith("/") or "" in segments:
            raise ValueError(f"bad path prefix {p!r}")
        rules.append(segments)
    return sorted(rules, key=len, reverse=True)


@dataclass(frozen=True)
class SeverityPolicy:
    """Sources of a severity in order (cvss, score, label), the label scales, and the order of CVSS sources."""

    sources: tuple[str, ...] = ("cvss", "label")
    scales: tuple[dict, ...] = (GENERAL_SCALE,)
    cvss_order: tuple[str, ...] = ("nvd", "ghsa", "redhat", "bitnami")

    def __post_init__(self):
        if not self.sources or set(self.sources) - {"cvss", "score", "label"} or len(set(self.sources)) < len(self.sources):
            raise ValueError(f"bad severity sources {self.sources}")

    @property
    def lineage(self) -> str:
        return ">".join(self.sources) + (f";cvss={','.join(self.cvss_order)}" if "cvss" in self.sources else "")


@dataclass(frozen=True)
class Strategy:
    """A fingerprint level: its name and version, the columns hashed, and those that mustn't be empty."""

    level: str
    name: str
    fields: tuple[str, ...]
    requires: tuple[str, ...]
    version: int = 1


L0 = Strategy("l0", "tool-uid", ("tool", "scope_key", "tool_finding_id"), ("tool", "tool_finding_id"))
L1 = Strategy("l1", "identity", ("scope_key", "kind", "vuln_source", "vuln_id", "component_key", "path"), ("vuln_id",))
L2 = Strategy("l2", "structural", ("scope_key", "rule_id", "path", "code"), ("rule_id", "path", "code"))


@dataclass(frozen=True)
class ToolSpec:
    """A tool: its report format (trivy, sarif, generic or a function of a DataFrame), its normalising steps and its fingerprints."""

    name: str
    flatten: str | Callable
    steps: tuple[str, ...]
    severity: SeverityPolicy | Callable | None = None
    path_fields: tuple[str, ...] = ()
    strategies: tuple[Strategy, ...] = (L0,)

    def __post_init__(self):
        if not self.name or not self.flatten or set(self.steps) - STEP_VERSIONS.keys() or len(set(self.steps)) < len(self.steps):
            raise ValueError(f"incomplete tool {self.name!r}")
        if ("severity" in self.steps) != (self.severity is not None) or ("path" in self.steps) != bool(self.path_fields):
            raise ValueError(f"tool {self.name!r}: a step and its settings go together")
        if len({s.level for s in self.strategies}) < len(self.strategies):
            raise ValueError(f"tool {self.name!r} has a level twice")

    @property
    def lineage(self) -> str:
        """Names and versions of parser and steps."""
        policy = getattr(self.severity, "lineage", None) or getattr(self.severity, "__name__", "custom")
        steps = [f"{s}@{STEP_VERSIONS[s]}" + (f"({policy})" if s == "severity" else "") for s in self.steps]
        return f"{self.name}@1/{'+'.join(steps)}"

    @property
    def fingerprint_lineage(self) -> str:
        return "+".join(f"{s.name}@{s.version}" for s in self.strategies)


STEP_VERSIONS = {"cvss": 1, "severity": 2, "vulnid": 1, "component": 1, "cwe": 1, "path": 1}
FALLBACK = "generic"


def standard_tools() -> dict[str, ToolSpec]:
    return registry(
        ToolSpec("trivy", "trivy", ("cvss", "severity", "vulnid", "component", "cwe", "path"), SeverityPolicy(), ("target",), (L0, L1)),
        ToolSpec("semgrep", "sarif", ("severity", "cwe", "path"), SeverityPolicy(("score", "label"), (SARIF_SCALE,)), ("uri",), (L0, L2)),
        ToolSpec(FALLBACK, "generic", ("severity", "vulnid", "path"), SeverityPolicy(("label",), (GENERAL_SCALE, SARIF_SCALE)), ("uri", "target"), (L0,)),
    )


def registry(*tools: ToolSpec) -> dict[str, ToolSpec]:
    out: dict[str, ToolSpec] = {}
    for t in tools:
        if t.name in out:
            raise ValueError(f"tool {t.name!r} is registered twice")
        out[t.name] = t
    if FALLBACK not in out:
        raise ValueError("a fallback tool is needed")
    return out


#: The features compared, in order, and their (agree, disagree) points by kind.
FEATURES = ("vuln", "component", "path", "code", "line", "rule", "cwe", "severity", "tool-uid")
_PACKAGE = {"vuln": (500, -400), "component": (350, -500), "path": (100, 0), "cwe": (50, 0), "severity": (0, -50), "tool-uid": (800, 0)}
WEIGHTS = {
    "default": {"vuln": (500, -400), "component": (350, -500), "path": (200, 0), "code": (400, -100), "line": (100, -400), "rule": (250, 0), "cwe": (50, 0), "severity": (0, -50), "tool-uid": (800, 0)},
    "sca": _PACKAGE,
    "container": _PACKAGE,
    "sast": {"path": (200, 0), "code": (400, -100), "line": (100, -400), "rule": (250, 0), "cwe": (50, 0), "severity": (0, -50), "tool-uid": (800, 0)},
    "secret": {"path": (300, 0), "code": (300, -100), "line": (100, -400), "rule": (300, 0), "severity": (0, -50), "tool-uid": (800, 0)},
    "iac": {"path": (250, 0), "code": (250, -100), "line": (100, -400), "rule": (350, 0), "cwe": (50, 0), "severity": (0, -50), "tool-uid": (800, 0)},
}


@dataclass(frozen=True)
class ScoringConfig:
    """Weights by kind (kinds without a row use `default`) and the two thresholds, in thousandths."""

    weights: dict = field(default_factory=lambda: WEIGHTS)
    review: int = 550
    merge: int = 800

    def __post_init__(self):
        if not 0 < self.review < self.merge <= 1000:
            raise ValueError("0 < review < merge <= 1000 is needed")
        if "default" not in self.weights:
            raise ValueError("weights need a default row")
        for kind, row in self.weights.items():
            for name, (agree, disagree) in row.items():
                if name not in FEATURES or agree < 0 or disagree > 0:
                    raise ValueError(f"bad weight {kind}/{name}")
