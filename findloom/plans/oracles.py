"""DuckDB SQL for the registered queries, computed on its own from the same derivation of findings."""

from __future__ import annotations

from findloom.plans import views
from findloom.plans.views import FINDINGS, REQUESTS, TENANTS, V2_DIGITS, V2_VECTOR, V3_DIGITS, V3_VECTOR, digit


#: Fixed values, written here again, so that a wrong one in the library shows: severities by label, their order, and the weights of CVSS 2 and 3.
GENERAL_SCALE = {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low", "info": "info", "informational": "info", "unknown": "unknown"}
SARIF_SCALE = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
SEVERITY_RANK = {"info": 1, "unknown": 2, "low": 3, "medium": 4, "high": 5, "critical": 6}
_EFFECT = {"N": 0.0, "P": 0.275, "C": 0.660}
V2 = {"AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "AU": {"M": 0.45, "S": 0.56, "N": 0.704}, "C": _EFFECT, "I": _EFFECT, "A": _EFFECT}
_IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
V3 = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "UI": {"N": 0.85, "R": 0.62}, "S": {"U": 0.0, "C": 0.0}, "C": _IMPACT, "I": _IMPACT, "A": _IMPACT}
CHANGED_PR = {"N": 0.85, "L": 0.68, "H": 0.5}


def case(col: str, table: dict, kind: str = "") -> str:
    value = (lambda v: f"cast({v} as double)") if kind == "double" else (lambda v: f"'{v}'" if isinstance(v, str) else str(v))
    return f"case {col} {' '.join(f"when '{k}' then {value(v)}" for k, v in table.items())} end"


def _weights(digits, table: dict, code: str = "cvss3_code") -> str:
    return ", ".join(f"{case(digit(letters, place, code), table[k], 'double')} as {k}_" for k, letters, place in digits)


V3_SCORE = f"""(select cvss3_code, case when impact <= 0 then 0.0 when r % 10000 = 0 then r / 100000.0 else (floor(r / 10000.0) + 1) / 10.0 end as v3 from (
 select *, cast(round(least(case when s = 'C' then 1.08::double * (impact + ease) else impact + ease end, 10) * 100000) as bigint) r from (
 select *, case when s = 'C' then 7.52::double * (iss - 0.029::double) - 3.25::double * pow(iss - 0.02::double, 15) else 6.42::double * iss end impact,
  8.22::double * AV_ * AC_ * (case when s = 'C' then cpr else PR_ end) * UI_ ease from (
 select *, 1 - (1 - C_) * (1 - I_) * (1 - A_) iss from (
 select distinct cvss3_code, {_weights(V3_DIGITS, V3)}, {digit('UC', 48)} s, {case(digit('NLH', 8), CHANGED_PR, 'double')} cpr from f)))))"""
V2_SCORE = f"""(select cvss3_code, round((0.6::double * impact + 0.4::double * ease - 1.5::double) * (case when impact = 0 then 0 else 1.176::double end) * 10 + 1e-9) / 10 + 0.0 as v2 from (
 select *, 10.41::double * (1 - (1 - C_) * (1 - I_) * (1 - A_)) impact, 20 * AV_ * AC_ * AU_ ease from (select distinct cvss3_code, {_weights(V2_DIGITS, V2, '(cvss3_code % 729)')} from f)))"""


def band(score: str, critical: bool = True) -> str:
    return f"case when {score} >= 9 and {str(critical).lower()} then 'critical' when {score} >= 7 then 'high' when {score} >= 4 then 'medium' when {score} >= 0.1 then 'low' else 'info' end"


GENERAL, SARIF = case("lower(trim(severity_raw))", GENERAL_SCALE), case("lower(trim(severity_raw))", SARIF_SCALE)
BASE = f"with f as ({FINDINGS})"
#: Findings with what normalising gives.
NORM = f"""{BASE}, n as (
 select f.*, sha256(tenant_id || '/' || product_id || '/' || context_id) scope_key, v3, v2,
  case tool when 'trivy' then vuln_id_raw || '|' || p_name || '|1.' || p_size || '|' || target when 'semgrep' then rule_id || '|' || uri || '|' || start_line || '|0' else custom_id end tool_finding_id,
  case tool when 'trivy' then {band('v3')} when 'semgrep' then coalesce(case when scanner_score <= 10 then {band('scanner_score')} end, {SARIF}) else 'unknown' end severity,
  case when tool = 'trivy' then case l_partkey % 5 when 0 then 'cve' when 1 then 'cve' when 2 then 'ghsa' when 3 then 'nswg' else 'unknown' end else '' end vuln_source,
  case when tool <> 'trivy' then '' when l_partkey % 5 = 2 and length(l_partkey::varchar) <= 4 then 'GHSA-' || lower(substr(vuln_id_raw, 6)) when l_partkey % 5 = 4 then vuln_id_raw else upper(trim(vuln_id_raw)) end vuln_id,
  case when tool = 'trivy' then ['npm', 'pypi', 'golang', 'maven', 'deb'][p_size % 5 + 1] end ctype,
  case when tool = 'trivy' then ['@scope', '', 'github.com/foo', 'org.Apache', 'debian'][p_size % 5 + 1] end cspace,
  case when tool = 'trivy' then case p_size % 5 when 0 then lower(replace(p_name, ' ', '_')) when 1 then replace(lower(replace(p_name, ' ', '_')), '_', '-') when 3 then replace(p_name, ' ', '_') else lower(replace(p_name, ' ', '_')) end end cname,
  case tool when 'trivy' then case when l_partkey % 40 = 0 then [] else ['CWE-' || (l_partkey % 40)] end when 'semgrep' then case when l_partkey % 40 in (0, 79) then ['CWE-79'] else ['CWE-' || (l_partkey % 40), 'CWE-79'] end else [] end cwe,
  case tool when 'trivy' then 'package-lock.json' when 'semgrep' then case l_partkey % 4 when 0 then 'src/f' when 1 then 'src/f' when 2 then 'lib/f' else '/opt/x/f' end || l_partkey || '.js' else uri end path,
  replace(snippet, ' ', '') code, start_line line
 from f join {V3_SCORE} using (cvss3_code) join {V2_SCORE} using (cvss3_code)),
c as (select *, case when tool = 'trivy' then 'pkg:' || ctype || '/' || case when cspace = '' then '' else replace(cspace, '@', '%40') || '/' end || cname || '@1.' || p_size || case when p_size % 5 = 4 then '?arch=amd64&distro=debian-12' else '' end end purl from n),
g as materialized (select *, case when purl is not null then sha256(tenant_id || '|' || purl) end component_id from c)"""


def _digest(level: str, *fields: str) -> str:
    return f"'v1:{level}:sha256:' || sha256({' || '.join(f"strlen({f}) || ':' || {f}" for f in fields)})"


PRINTS = f"""{NORM}, p as materialized (
 select finding_id, tenant_id, scope_key, import_run_id, tool, 'l0' as level, 'tool-uid' strategy, 1 version_, {_digest('l0', 'tool', 'scope_key', 'tool_finding_id')} as value from g where tool_finding_id <> ''
 union all select finding_id, tenant_id, scope_key, import_run_id, tool, 'l1', 'identity', 1, {_digest('l1', 'scope_key', 'kind', 'vuln_source', 'vuln_id', 'purl', 'path')} from g where tool = 'trivy'
 union all select finding_id, tenant_id, scope_key, import_run_id, tool, 'l2', 'structural', 1, {_digest('l2', 'scope_key', 'rule_id', 'path', 'code')} from g where tool = 'semgrep')"""
PAIRS = f"""{PRINTS}, ab as materialized (
 select x.finding_id a, y.finding_id b, count(*) n_keys from p x join p y on x.scope_key = y.scope_key and x.tenant_id = y.tenant_id and x.level = y.level and x.value = y.value and x.finding_id < y.finding_id group by 1, 2)"""
_SIGNALS = {
    "vuln": ("x.vuln_id = '' or y.vuln_id = ''", "x.vuln_source = y.vuln_source and x.vuln_id = y.vuln_id"), "component": ("x.purl is null or y.purl is null", "x.purl = y.purl"), "path": ("x.path = '' or y.path = ''", "x.path = y.path"),
    "code": ("x.code = '' or y.code = ''", "x.code = y.code"), "line": ("x.line <= 0 or y.line <= 0", "x.line = y.line"), "rule": ("x.rule_id = '' or y.rule_id = ''", "x.rule_id = y.rule_id"),
    "cwe": ("len(x.cwe) = 0 or len(y.cwe) = 0", "list_has_any(x.cwe, y.cwe)"), "severity": ("x.severity = 'unknown' or y.severity = 'unknown'", "x.severity = y.severity"), "tool-uid": ("x.tool_finding_id = '' or y.tool_finding_id = ''", "x.tool = y.tool and x.tool_finding_id = y.tool_finding_id"),
}
#: Points by kind, agree and disagree, in the order of the features: vuln, component, path, code, line, rule, cwe, severity, tool-uid.
_POINTS = {
    "sca": ((500, -400), (350, -500), (100, 0), (0, 0), (0, 0), (0, 0), (50, 0), (0, -50), (800, 0)),
    "sast": ((0, 0), (0, 0), (200, 0), (400, -100), (100, -400), (250, 0), (50, 0), (0, -50), (800, 0)),
    "unknown": ((500, -400), (350, -500), (200, 0), (400, -100), (100, -400), (250, 0), (50, 0), (0, -50), (800, 0)),
}


def _signal(name: str) -> str:
    unknown, agree = _SIGNALS[name]
    return f"case when {unknown} then 'unknown' when {agree} then 'agree' else 'disagree' end"


_S = ", ".join(f"{_signal(n)} s{i}" for i, n in enumerate(_SIGNALS))
_P = ", ".join(f"case s{i} when 'agree' then {case('kind', {k: v[i][0] for k, v in _POINTS.items()})} when 'disagree' then {case('kind', {k: v[i][1] for k, v in _POINTS.items()})} else 0 end p{i}" for i in range(9))
_REASONS = ", ".join(f"case when s{i} <> 'unknown' then '{n}/' || s{i} || '/' || p{i} end" for i, n in enumerate(_SIGNALS))
EDGES = f"""{PAIRS}, sig as (select a, b, x.kind kind, {_S} from ab join g x on x.finding_id = a join g y on y.finding_id = b),
pts as (select *, {_P} from sig),
e as (select a, b, least(greatest({' + '.join(f'p{i}' for i in range(9))}, 0), 1000)::int points, concat_ws(',', {_REASONS}) reasons from pts),
v as (select *, case when points >= 800 then 'merge' when points >= 550 then 'review' else 'separate' end verdict from e)"""
COUNTS = f"{PAIRS}, cnt as (select finding_id, coalesce(n, 0) n from (select distinct finding_id from p) left join (select i, count(*) n from (select a i from ab union all select b from ab) group by 1) on i = finding_id)"
RATINGS = f"""{NORM}, r as (
 select tenant_id, finding_id, 'nvd' source, 'cvss' scheme, '3.1' as version, {V3_VECTOR} as vector, v3::double score from g where tool = 'trivy'
 union all select tenant_id, finding_id, 'redhat', 'cvss', '2.0', {V2_VECTOR}, v2::double from g where tool = 'trivy'
 union all select tenant_id, finding_id, tool, 'scanner', '', '', scanner_score from g where scanner_score is not null)"""
CWES = f"{NORM}, w as (select tenant_id, finding_id, import_run_id, unnest(cwe) cwe from g)"
_TENANTS = ", ".join(f"('{t}', {n})" for t, n in TENANTS)
CHECKED = f"""with r as ({REQUESTS}), t(id, most) as (values {_TENANTS}),
k as (select r.*, split_part(scope, '/', 1) product_id, case when contains(scope, '/') then substr(scope, strpos(scope, '/') + 1) else '' end context_id, strlen(body)::int size_bytes, most,
 sha256(tenant_id || '/' || split_part(scope, '/', 1) || '/' || case when contains(scope, '/') then substr(scope, strpos(scope, '/') + 1) else '' end) scope_key, sha256(body) sha256 from r left join t on id = tenant_id),
c as (select * replace (case when coalesce(scan_id, '') = '' then 'scan-' || substr(sha256(tenant_id || '/' || scope_key || '/' || tool || '/' || sha256 || '/' || arrival), 1, 32) else scan_id end as scan_id), case when most is null then 'unauthorized' when product_id = '' or not regexp_full_match(tool, '[a-z0-9][a-z0-9._-]{{0,63}}') or size_bytes = 0 then 'bad_request' when size_bytes > most then 'report_too_large' end reject_code from k),
ok as (select * from c where reject_code is null)"""
RUNS = """with runs as (select 't' || (o_custkey % 2) tenant_id, 'r' || o_orderkey import_run_id, o_orderkey n, o_orderdate::timestamp finished_at, case when o_orderkey % 7 = 0 then 'failed' when o_orderkey % 11 = 0 then 'running' else 'completed' end status, o_orderkey % 3 = 0 published from orders)"""
_LE = lambda bounds, col, src: " union all ".join([*[f"select '{b}' le, count(*) n from {src} where {col} <= {b}" for b in bounds], f"select '+Inf', count(*) from {src}"])
SEEDS = f"{PRINTS}, sd as (select p.finding_id, min(p.finding_id) over (partition by p.tenant_id, p.scope_key, p.value) seed, count(*) over (partition by p.tenant_id, p.scope_key, p.value) m from p where level = 'l1')"

#: One merge after another, by points, then a and b, with the groups (node n, root r) of each stretch of findings that can share a fingerprint as a list. A pair is refused that links two
#: older clusters (roots `c:`) or two groups with a separate pair between them.
_ROOT = "list_filter(st, lambda z: z.n = {0})[1].r"


def _replay(name: str, nodes: str, merges: str, apart: str) -> str:
    """CTE `name`(n, r): the groups after all merges. nodes(gid, n, r), merges(gid, a, b, points), apart(gid, a, b)."""
    between = f"len(list_filter(coalesce(ps, []), lambda x: ({_ROOT.format('x.a')} = ra and {_ROOT.format('x.b')} = rb) or ({_ROOT.format('x.a')} = rb and {_ROOT.format('x.b')} = ra))) > 0"
    return f"""{name}_m as materialized (select *, row_number() over (partition by gid order by points desc, a, b) k from ({merges})),
{name}_p as materialized (select gid, list({{'a': a, 'b': b}}) ps from ({apart}) group by gid),
{name}_s as (select gid, 0::bigint k, list({{'n': n, 'r': r}}) st from ({nodes}) group by gid union all
 select gid, k, case when ra = rb or (starts_with(ra, 'c:') and starts_with(rb, 'c:')) or {between} then st else list_transform(st, lambda y: {{'n': y.n, 'r': case when y.r in (ra, rb) then least(ra, rb) else y.r end}}) end
 from (select s.gid, m.k, st, ps, {_ROOT.format('m.a')} ra, {_ROOT.format('m.b')} rb from {name}_s s join {name}_m m on m.gid = s.gid and m.k = s.k + 1 left join {name}_p q on q.gid = s.gid)),
{name} as materialized (select u.x.n n, u.x.r r from (select unnest(arg_max(st, k)) x from {name}_s group by gid) u)"""


_GID = "concat_ws('|', tenant_id, scope_key, tool, floor(l_partkey / 4))"
_V = EDGES.replace("with f as", "with recursive f as", 1) + f""", w as materialized (select v.*, {_GID} gid from v join g on finding_id = a), subject as materialized (select finding_id, {_GID} gid from g where finding_id in (select finding_id from p))"""
_ENDS = "(select {0} from w where {1})"
CLUSTERS = f"""{_V},
{_replay('grp', "select gid, finding_id n, finding_id r from subject", "select gid, a, b, points from w where verdict = 'merge'", "select gid, a, b from w where verdict = 'separate'")},
best as (select finding_id, max(points) points from (select a finding_id, points, a x, b y from w where verdict = 'merge' union all select b, points, a, b from w where verdict = 'merge') join grp ga on ga.n = x join grp gb on gb.n = y where ga.r = gb.r group by 1),
asg as materialized (select g.finding_id, tenant_id, scope_key, tool, import_run_id, r seed, sha256(tenant_id || '/' || scope_key || '/' || r) cluster_id, coalesce(points, 1000)::int points from grp join g on g.finding_id = n left join best on best.finding_id = n),
rev as (select a, b, points, verdict from w join grp ga on ga.n = a join grp gb on gb.n = b where verdict <> 'separate' and ga.r <> gb.r)"""
_LATE = "substr({0}, 8, 1) = '7'"
JOINED = f"""{_V},
{_replay('old', f"select gid, finding_id n, finding_id r from subject where not {_LATE.format('finding_id')}", f"select gid, a, b, points from w where verdict = 'merge' and not {_LATE.format('a')} and not {_LATE.format('b')}", f"select gid, a, b from w where verdict = 'separate' and not {_LATE.format('a')} and not {_LATE.format('b')}")},
mine as materialized (select * from w where {_LATE.format('a')} or {_LATE.format('b')}),
{_replay('grp', "select gid, finding_id n, coalesce('c:' || r, 'f:' || finding_id) r from subject left join old on n = finding_id", "select gid, a, b, points from mine where verdict = 'merge'", "select gid, a, b from mine where verdict = 'separate'")},
best as (select finding_id, max(points) points from (select a finding_id, points, a x, b y from mine where verdict = 'merge' union all select b, points, a, b from mine where verdict = 'merge') join grp ga on ga.n = x join grp gb on gb.n = y where ga.r = gb.r group by 1)"""

SQL = {
    "intake_rejects": f"{CHECKED} select arrival, tenant_id, tool, product_id, context_id, size_bytes, reject_code from c",
    "intake_keys": f"{CHECKED} select arrival, scope_key, sha256, tenant_id || '/' || scan_id || '/' || sha256 raw_key from ok",
    "intake_first_wins": f"{CHECKED} select tenant_id, scope_key, tool, sha256, min(arrival) arrival from ok group by 1, 2, 3, 4",
    "intake_accept": f"""{CHECKED}, old as (select tenant_id, scope_key, tool, sha256, arg_min(scan_id, arrival) scan_id from ok where arrival % 10 = 1 group by 1, 2, 3, 4),
 fst as (select tenant_id, scope_key, tool, sha256, arg_min(scan_id, arrival) scan_id, min(arrival) first_ from ok group by 1, 2, 3, 4)
 select arrival, ok.tenant_id, ok.tool, coalesce(old.scan_id, fst.scan_id) scan_id, old.scan_id is null and arrival = first_ is_new
 from ok join fst using (tenant_id, scope_key, tool, sha256) left join old using (tenant_id, scope_key, tool, sha256)""",
    "intake_events": f"""{CHECKED}, old as (select distinct tenant_id, scope_key, tool, sha256 from ok where arrival % 10 = 1),
 fst as (select tenant_id, scope_key, tool, sha256, arg_min(product_id, arrival) product_id, arg_min(context_id, arrival) context_id from ok group by 1, 2, 3, 4)
 select fst.tenant_id, product_id, context_id, fst.tool, count(*) n from fst left join old using (tenant_id, scope_key, tool, sha256) where old.sha256 is null or substr(fst.sha256, 1, 1) not between '0' and '7' group by 1, 2, 3, 4""",
    "run_start": f"{RUNS} select n, 'trivy' tool, import_run_id run, 'running' status from runs where n % 2 = 0 and status <> 'completed' union all select n, 'semgrep', 'new', 'running' from runs where n % 3 = 0",
    "run_counts": f"{RUNS} select import_run_id, 'completed' status, count(l_orderkey)::bigint finding_count from runs left join (select l_orderkey from lineitem where l_suppkey % 3 = 0) on l_orderkey = n where status <> 'failed' group by 1",
    "run_failures": f"""{RUNS}, t as (select n, status, case n % 3 when 0 then 'trivy' when 1 then 'semgrep' else 'homegrown' end tool from runs),
 w as (select tool, status, {views.by_tool(views.REPORTS, 1)} why from t)
 select tool, case when why is not null and status <> 'completed' then 'failed' else status end status, case when status <> 'completed' then why end reason, count(*) n_runs from w group by 1, 2, 3""",
    "run_events": f"""{RUNS}, e as (select case when n % 13 = 0 then 'no tenant' when n % 17 = 0 then 'unknown run' when status <> 'completed' then 'run is not completed' when n % 5 = 0 then 'processed' else 'to process' end reason from runs)
 select reason, count(*) n_events from e where reason <> 'processed' group by 1""",
    "backlogs": f"""{RUNS}, a as (select * from runs where status = 'completed' and n % 5 <> 0 and finished_at >= timestamp '1998-08-05' - interval 90 days), b as (select * from runs where status = 'completed' and not published)
 select 'unprocessed' backlog, count(*) n, coalesce(date_diff('second', min(finished_at), timestamp '1998-08-05'), 0) age_seconds from a union all select 'unpublished', count(*), coalesce(date_diff('second', min(finished_at), timestamp '1998-08-05'), 0) from b""",
    "run_states": f"{RUNS} select status, count(*) n from runs group by 1",
    "runs_to_publish": f"{RUNS} select import_run_id, published or status = 'completed' was_published, not published and status = 'completed' is_new from runs",
    "trivy_flatten": f"{BASE} select import_run_id, finding_id, vuln_id_raw || '|' || p_name || '|1.' || p_size || '|' || target tool_finding_id, kind, severity_raw, vuln_id_raw, purl_raw, '0.5' tool_version, target, cwe_raw cwes, 'redhat=' || {V2_VECTOR} cvss, case when starts_with(target, '/') then 'absolute_path' else '' end codes from f where tool = 'trivy'",
    "sarif_flatten": f"""{BASE} select import_run_id, finding_id, rule_id || '|' || uri || '|' || start_line || '|0' tool_finding_id, kind, 'Rule ' || rule_id title, case when l_linenumber % 4 = 1 then 'warning' else severity_raw end severity_raw, 7.5::double scanner_score, '1.2' tool_version, rule_id, uri, start_line, snippet, 'CWE-79' cwes,
 case when starts_with(uri, '/') then 'absolute_path' else '' end codes from f where tool = 'semgrep'""",
    "generic_flatten": "select o_orderkey, 'unknown' kind, 'unparsed report' title, case when o_orderkey % 3 = 0 then '{\"bytes\":8}' else '{\"id\":' || o_orderkey || '}' end raw, 'unknown_format,unknown_tool' codes, 'generic' adapter from orders",
    "unparsed_elements": f"""with o as (select o_orderkey n, case o_orderkey % 2 when 0 then 'trivy' else 'semgrep' end tool from orders),
 e as (select n, tool, {views.by_tool(views.ELEMENTS, 0)} raw, {views.by_tool(views.ELEMENTS, 1)} title, case when n % 5 = 0 then '/t' else 't' end target from o),
 c as (select *, case when title is null then tool = 'trivy' end bad_vulnerability, case when title is null then tool = 'semgrep' end bad_result from e)
 select n, tool, case tool when 'trivy' then 'sca' else 'sast' end kind, coalesce(title, case tool when 'trivy' then 'unparsed vulnerability' else 'unparsed result' end) title, raw,
 concat_ws(',', case when bad_vulnerability then 'invalid_vulnerability' when bad_result then 'invalid_result' end, case when tool = 'trivy' and target = '/t' then 'absolute_path' end, case when n % 7 = 0 then case tool when 'trivy' then 'trivy_schema_version' else 'sarif_version' end end) codes,
 case when tool = 'trivy' and title is not null then target end target from c
 union all select n, tool, 'unknown', 'unsupported trivy section: secrets', '{{"count":2,"section":"secrets","target":"' || target || '"}}', concat_ws(',', 'unsupported_section', case when n % 7 = 0 then 'trivy_schema_version' end), null from c where tool = 'trivy' and n % 6 = 0""",
    "severities": f"{NORM} select finding_id, severity, {case('severity', SEVERITY_RANK)} severity_rank, case when tool = 'custom-scanner' then 'unknown_severity' when tool = 'semgrep' and scanner_score > 10 then 'invalid_score' else '' end codes from g",
    "severity_labels": f"{BASE} select distinct severity_raw, {GENERAL} as general, {SARIF} as sarif, coalesce({GENERAL}, {SARIF}) as both from f",
    "score_bands": f"select score, case when score between 0 and 10 then {band('score')} end v3, case when score between 0 and 10 then {band('score', False)} end v2, not score between 0 and 10 bad from (select distinct l_quantity / 4.0 - 1 score from lineitem)",
    "vuln_ids": f"{NORM} select finding_id, vuln_source, vuln_id from g where tool = 'trivy'",
    "cwe_numbers": f"{NORM} select finding_id, array_to_string(cwe, ',') cwes, false bad from g",
    "purls": f"{NORM} select finding_id, purl, ctype as type, cspace as namespace, cname as name, '1.' || p_size as version from g where tool = 'trivy'",
    "paths": f"{NORM} select finding_id, path, code, line from g",
    "cvss_v3": f"{BASE} select cvss3_code, '3.1' as version, {V3_VECTOR} as vector, v3::double base_score from {V3_SCORE}",
    "cvss_v2": f"{BASE} select cvss3_code, '2.0' as version, {V2_VECTOR} as vector, v2::double base_score from {V2_SCORE}",
    "components": f"{NORM} select distinct tenant_id, component_id, purl, ctype as type, cspace as namespace, cname as name, '1.' || p_size as version from g where purl is not null",
    "ratings": f"{RATINGS} select * from r",
    "finding_cwes": f"{CWES} select tenant_id, finding_id, cwe from w",
    "fingerprints": f"{PRINTS} select finding_id, level, strategy, version_ as version, value from p",
    "fingerprint_levels": f"{PRINTS} select import_run_id, level, count(*) n from p group by 1, 2",
    "fingerprint_formats": f"{PRINTS} select distinct level, strategy, version_ as version, true well_formed from p",
    "skipped_levels": f"{NORM} select case when tool = 'custom-scanner' then 'other' else tool end tool, count(*) findings, count(case when tool_finding_id = '' then 1 end) skipped_l0, 0::bigint skipped_l1, 0::bigint skipped_l2, count(case when tool_finding_id = '' then 1 end) unfingerprinted from g group by 1",
    "duplicate_groups": f"{PRINTS} select tenant_id, scope_key, level, value, count(*) findings, min(finding_id) first_finding from p group by 1, 2, 3, 4 having count(*) > 1",
    "candidate_pairs": f"{PAIRS} select a finding_id, b candidate_id, n_keys::int n_keys from ab union all select b, a, n_keys::int from ab",
    "candidate_counts": f"{COUNTS} select finding_id, n n_candidates from cnt",
    "candidate_histogram": f"{COUNTS} select le, n, (select sum(n) from cnt)::bigint as sum, (select count(*) from cnt) as count from ({_LE((0, 1, 2, 3, 5, 10, 25, 50, 100, 500, 1000), 'n', 'cnt')})",
    "candidate_places": f"""{PAIRS}, o as (select a x, b y from ab union all select b, a from ab)
 select case substr(y, 8, 1) when '7' then 'run' when '1' then 'member' when '3' then 'member' else 'unclustered' end place, count(*) n from o where substr(x, 8, 1) = '7' group by 1""",
    "pair_scores": f"{EDGES} select a, b, points, verdict, reasons from v",
    "verdict_counts": f"{EDGES} select verdict, count(*) pairs, sum(points)::bigint points from v group by 1",
    "verdicts_by_tool": f"{EDGES} select case when tool = 'custom-scanner' then 'other' else tool end tool, count(case when verdict = 'merge' then 1 end) merge, count(case when verdict = 'review' then 1 end) review, count(case when verdict = 'separate' then 1 end) separate from v join g on finding_id = a group by 1",
    "representative_pairs": f"""{PRINTS}, rec as (select finding_id, concat_ws(chr(1), kind, severity, rule_id, vuln_source, vuln_id, purl, array_to_string(cwe, ','), path, code, line, tool, tool_finding_id) || chr(1) || (purl is null) r from g),
 rep as (select tenant_id, scope_key, level, value, r, min(p.finding_id) i from p join rec using (finding_id) group by 1, 2, 3, 4, 5)
 select distinct least(x.i, y.i) a, greatest(x.i, y.i) b from rep x join rep y on x.tenant_id = y.tenant_id and x.scope_key = y.scope_key and x.level = y.level and x.value = y.value and x.i < y.i""",
    "clusters_sca": f"{SEEDS} select finding_id, seed, 1000 points from sd",
    "clusters_constrained": f"{CLUSTERS} select finding_id, cluster_id, seed, true is_new, points from asg",
    "review_queue": f"{CLUSTERS} select * from rev",
    "cluster_stats": f"{CLUSTERS} select (select count(distinct cluster_id) from asg) created, 0::bigint joined, (select count(*) from rev) review",
    "confidence_histogram": f"{CLUSTERS}, cf as (select points / 1000 confidence from asg) select le, n, round((select sum(confidence) from cf), 3)::double as sum, (select count(*) from cf) as count from ({_LE([i / 10 for i in range(1, 11)], 'confidence', 'cf')})",
    "joined_clusters": f"{JOINED} select n finding_id, starts_with(r, 'f:') is_new, coalesce(points, 1000)::int points from grp left join best on finding_id = n where {_LATE.format('n')}",
    "clusters_by_tool": f"""{CLUSTERS} select case tool when 'custom-scanner' then 'other' else tool end tool, sum(fs)::bigint findings, sum(cr)::bigint created, 0::bigint joined, sum(rv)::bigint review, 0::bigint unclustered
 from (select tool, 1 fs, (finding_id = seed)::int cr, 0 rv from asg union all select tool, 0, 0, 1 from rev join g on finding_id = a) group by 1""",
    "shared_clusters": f"""{CLUSTERS}, sh as (select cluster_id, min(import_run_id) < max(import_run_id) several from asg group by 1) select import_run_id, count(*) members, count(case when several then 1 end) shared from asg join sh using (cluster_id) group by 1""",
    "run_findings": f"{NORM} select finding_id, import_run_id, severity, purl, array_to_string(list_sort(cwe), ',') cwes from g",
    "worst_findings": f"{NORM} select tenant_id, scope_key, position::int as position, finding_id, severity from (select *, row_number() over (partition by tenant_id, scope_key order by {case('severity', SEVERITY_RANK)} desc, finding_id) as position from g) where position <= 5",
    "top_ratings": f"{RATINGS} select tenant_id, scheme, source, position::int as position, finding_id, version, score from (select *, row_number() over (partition by tenant_id, scheme, source order by score desc, finding_id, vector) as position from r) where position <= 10",
    "findings_by_cwe": f"{CWES} select tenant_id, cwe, count(*) findings from w group by 1, 2",
    "findings_by_component": f"{NORM} select tenant_id, component_id, count(*) findings from g where component_id is not null group by 1, 2",
    "run_summary": f"""{CWES} select import_run_id, count(*) findings, count(component_id) component_uses, count(distinct component_id) components, '1.0' tool_versions, count(case when rule_id <> '' then 1 end) with_rule, count(case when snippet <> '' then 1 end) with_snippet,
 2 * count(case when tool = 'trivy' then 1 end) cvss_rows, count(case when tool = 'trivy' then 1 end) cvss_findings, sum(len(cwe))::bigint cwe_rows, count(case when len(cwe) > 0 then 1 end) cwe_findings from g group by 1""",
}
