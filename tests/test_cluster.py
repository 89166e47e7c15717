"""Clustering scenarios, and random graphs against a plain greedy clusterer; scoring properties; candidate counts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from findloom.config import ScoringConfig
from findloom.operators import candidates, classes, cluster, reports, scoring
from findloom.plans import queries

EDGE = "a string, b string, points int, verdict string, reasons array<struct<feature:string,signal:string,points:int>>"


def run(spark, findings, edges, existing=()):
    f = spark.createDataFrame([(x, "t", "s") for x in findings], "finding_id string, tenant_id string, scope_key string")
    rows = [(min(a, b), max(a, b), p, v, []) for a, b, p, v in edges]
    random.shuffle(rows)
    assigned, review = cluster.cluster(f, spark.createDataFrame(rows, EDGE), spark.createDataFrame(list(existing), "finding_id string, cluster_id string"))
    return {r["finding_id"]: (r["seed"] or r["cluster_id"], r["points"]) for r in assigned.collect()}, {(r["a"], r["b"]) for r in review.collect()}


def plain(findings, edges, existing):
    """All edges in one global order."""
    anchor = dict(existing)
    node = lambda x: f"c:{anchor[x]}" if x in anchor else x
    groups = {node(x): {node(x)} for x in [*findings, *anchor, *[e for a, b, *_ in edges for e in (a, b)]]}
    apart = {frozenset((node(a), node(b))) for a, b, _, v in edges if v == "separate"}
    merges = sorted(((-p, min(a, b), max(a, b)) for a, b, p, v in edges if v == "merge"))
    for _, a, b in merges:
        x, y = groups[node(a)], groups[node(b)]
        if x is y or sum(n.startswith("c:") for n in x | y) > 1 or any(frozenset((m, n)) in apart for m in x for n in y):
            continue
        x |= y
        for n in y:
            groups[n] = x
    out = {}
    for f in findings:
        g = groups[node(f)]
        c = [n[2:] for n in g if n.startswith("c:")]
        best = min(((p, a, b) for p, a, b in merges if f in (a, b) and groups[node(a)] is groups[node(b)]), default=None)
        out[f] = (c[0] if c else min(g), -best[0] if best else 1000)
    review = {(min(a, b), max(a, b)) for a, b, _, v in edges if v in ("merge", "review") and groups[node(a)] is not groups[node(b)]}
    return out, review


def test_scenarios(spark):
    assert run(spark, "abcd", [("a", "b", 900, "merge"), ("b", "c", 850, "merge")]) == ({"a": ("a", 900), "b": ("a", 900), "c": ("a", 850), "d": ("d", 1000)}, set())
    assert run(spark, "abc", [("a", "b", 950, "merge"), ("b", "c", 850, "merge"), ("a", "c", 0, "separate")]) == ({"a": ("a", 950), "b": ("a", 950), "c": ("c", 1000)}, {("b", "c")})
    assert run(spark, "ab", [("a", "b", 600, "review")])[1] == {("a", "b")}
    assert run(spark, "n", [("n", "x", 900, "merge")], [("x", "C1"), ("y", "C1")]) == ({"n": ("C1", 900)}, set())
    assert run(spark, "n", [("n", "x", 900, "merge"), ("n", "y", 850, "merge")], [("x", "C1"), ("y", "C2")]) == ({"n": ("C1", 900)}, {("n", "y")})
    assert run(spark, "mn", [("m", "n", 900, "merge"), ("m", "x", 800, "merge"), ("n", "x", 0, "separate")], [("x", "C1")]) == ({"m": ("m", 900), "n": ("m", 900)}, {("m", "x")})


@pytest.mark.parametrize("whole", [50_000, 0])
def test_random_graphs(spark, whole, monkeypatch):
    monkeypatch.setattr(cluster, "WHOLE", whole)
    r = random.Random(5)
    findings, edges, existing = [], [], []
    for g in range(40 if whole else 15):  # many small graphs in one run
        own = [f"{g:02d}{c}" for c in "abcdef"]
        old = [(f"{g:02d}x{k}", f"K{g}{k // 2}") for k in range(r.randint(0, 3))]
        findings += own
        existing += old
        nodes = own + [x for x, _ in old]
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                if (a in own or b in own) and r.random() < 0.5:
                    v = r.choice(["merge", "merge", "review", "separate"])
                    edges.append((a, b, {"merge": r.choice([800, 850, 900, 1000]), "review": 600, "separate": 0}[v], v))
    assert run(spark, findings, edges, existing) == plain(findings, edges, existing)


def test_scores_are_symmetric(spark):
    rows = [("a", "sca", "high", "", "cve:1", "pkg:x", ["CWE-1"], "p", "", 0, "t|1"), ("b", "sca", "low", "", "cve:1", "pkg:x", [], "q", "", 0, "t|2"), ("c", "sast", "low", "r", "", "", [], "p", "x", 3, "")]
    recs = spark.createDataFrame(rows, "finding_id string, kind string, severity string, rule string, vuln string, component string, cwe array<string>, path string, code string, line int, tool_uid string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in scoring.score_pairs(pairs, recs, ScoringConfig()).collect()}
    assert got["a", "b"]["points"] == got["b", "a"]["points"] == 800 and got["a", "b"]["verdict"] == "merge"
    assert sum(x["points"] for x in got["a", "b"]["reasons"]) == 800
    assert got["a", "c"]["verdict"] == "separate" and [x["feature"] for x in got["a", "c"]["reasons"]] == ["kind"]


def test_candidate_counts_need_no_pairs(spark):
    r = random.Random(3)
    prints = [(f"f{i:03d}", "t", f"s{r.randint(0, 1)}", lv, str(r.randint(0, 9))) for i in range(80) for lv in r.sample(["l0", "l1"], r.randint(1, 2))]
    scope = {}
    prints = [(f, t, scope.setdefault(f, s), lv, v) for f, t, s, lv, v in prints]
    p = spark.createDataFrame(prints, "finding_id string, tenant_id string, scope_key string, level string, value string")
    pairs = candidates.candidates(p, p).groupBy("finding_id").count().collect()
    counts = {x["finding_id"]: x["n_candidates"] for x in candidates.candidate_counts(p, p).collect()}
    assert {k: v for k, v in counts.items() if v} == {x["finding_id"]: x["count"] for x in pairs}


RECORD = "finding_id string, kind string, severity string, rule string, vuln string, component string, cwe array<string>, path string, code string, line int, tool_uid string"
PRINT = "finding_id string, tenant_id string, scope_key string, level string, value string"


def _random_findings(seed, n, scopes, few):
    """Findings whose records repeat, with the keys that their fields give; some have no id of their own, so that copies don't merge."""
    r = random.Random(seed)
    recs, prints, members = [], [], []
    for k in range(n):
        f, scope, kind = f"{r.randrange(10**6):06d}-{k}", f"s{r.randrange(scopes)}", r.choice(["sca", "sast", "unknown"])
        vuln, path, code = r.choice(["", "cve:1", "cve:2"][:few]), r.choice(["", "p", "q"][:few]), r.choice(["", "x", "y"][:few])
        rule, uid, line = r.choice(["", "r"]), r.choice(["", "", "t|1", "t|2"]), r.choice([0, 1, 2])
        recs.append((f, kind, r.choice(["high", "unknown"]), rule, vuln, r.choice(["", "pkg"]), r.choice([[], ["CWE-1"]]), path, code, line, uid))
        prints += [(f, "t", scope, level, v) for level, v, there in (("l0", uid, uid), ("l1", f"{kind}{vuln}{path}", vuln), ("l2", f"{rule}{path}{code}", rule and path and code)) if there]
        if r.random() < 0.25:
            members.append((f, f"K{scope}{r.randrange(3)}"))
    return recs, prints, members


@pytest.mark.parametrize("hubs", [10_000, 3])
def test_classes_give_what_pairs_give(spark, hubs, monkeypatch):
    monkeypatch.setattr(classes, "HUBS", hubs)
    recs, prints, members = _random_findings(7, 260, 6, 2 if hubs == 3 else 3)
    known = {f for f, *_ in prints}
    recs, p = spark.createDataFrame(recs, RECORD), spark.createDataFrame(prints, PRINT)
    old = spark.createDataFrame([m for m in members if m[0] in known], "finding_id string, cluster_id string")
    every = candidates.pairs(p)
    fresh = old.select("finding_id")
    new = every.join(fresh.withColumnRenamed("finding_id", "a"), "a", "left_anti").unionByName(every.join(fresh.withColumnRenamed("finding_id", "b"), "b", "left_anti")).distinct()
    edges = scoring.score_pairs(new.select("a", "b"), recs)
    subjects = p.select("finding_id", "tenant_id", "scope_key").distinct().join(fresh, "finding_id", "left_anti")
    want, queue = cluster.cluster(subjects, edges, old)
    membership, table = classes.classes(p, recs, old)
    scored = classes.scored_classes(p, recs, table)
    got, review = classes.cluster_classes(membership, table, scored)
    rows = lambda d: {r["finding_id"]: (r["cluster_id"], r["is_new"], r["seed"], r["points"], str(r["reasons"]), r["partner"]) for r in d.collect()}
    assert rows(got) == rows(want) and len({v[0] for v in rows(got).values()}) < len(rows(got))
    pairs = lambda d: sorted((r["a"], r["b"], r["points"], r["verdict"]) for r in d.collect())
    assert pairs(classes.expand_pairs(review, membership)) == pairs(queue) and pairs(classes.expand_pairs(scored, membership)) == pairs(edges)
    assert cluster.stats(got, review).first() == cluster.stats(want, queue).first()
    assert table.count() < membership.count()


def test_a_block_of_100_000_copies(spark):
    """Two records in one block: three pairs of classes, whatever their copies."""
    f = spark.range(100_000).selectExpr("lpad(cast(id as string), 6, '0') finding_id", "'sca' kind", "'high' severity", "'' rule", "'cve:1' vuln", "case when id % 2 = 0 then 'pkg' else '' end component", "array('CWE-1') cwe", "'p' path", "'' code", "0 line", "'t|1' tool_uid")
    p = f.selectExpr("finding_id", "'t' tenant_id", "'s' scope_key", "'l0' level", "'v' value")
    membership, table = classes.classes(p, f)
    edges = classes.scored_classes(p, f, table)
    assert {(r["a"], r["b"], r["pairs"]) for r in edges.collect()} == {("000000", "000001", 50_000**2), ("000000", "000000", 50_000 * 49_999 // 2), ("000001", "000001", 50_000 * 49_999 // 2)}
    assigned, review = classes.cluster_classes(membership, table, edges)
    assert tuple(assigned.selectExpr("count(*)", "count(distinct cluster_id)", "min(seed)").first()) == (100_000, 1, "000000") and review.isEmpty()


def _bytes(spark):
    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(place) for f in names)


def test_scratch_of_scored_classes_is_small(spark):
    """What verdict_counts leaves in spark.checkpoint.dir, for each of 6,000 findings; checkpoints of rows with all of their columns took 1,002 bytes."""
    before = _bytes(spark)
    queries.verdict_counts(spark, "/root/testdata/sf0.001").collect()
    assert _bytes(spark) - before < 400 * 6000


def test_pairs_of_two_tools_go_to_the_smaller_finding(spark):
    """Findings a, d of one class and tool, b, c of another: of their four pairs a's two count for its tool, b-d and c-d for the other's."""
    table = spark.createDataFrame([("a", 2, "trivy"), ("b", 2, "semgrep")], "class_id string, n long, run_tool string")
    membership = spark.createDataFrame([("a", "a", 2), ("d", "a", 2), ("b", "b", 2), ("c", "b", 2)], "finding_id string, class_id string, n long")
    edges = spark.createDataFrame([("a", "b", 4, "merge"), ("a", "a", 1, "review")], "a string, b string, pairs long, verdict string")
    got = reports.verdicts_by_tool(classes.first_tool(edges, table, lambda: membership)).collect()
    assert {tuple(r) for r in got} == {("trivy", 2, 1, 0), ("semgrep", 2, 0, 0)}


def test_shared_keys_and_counts_from_keys_on_the_row(spark):
    """What candidates() says, from blocks; one index told both ways, a part of it against all, and counts of findings without any key."""
    r = random.Random(11)
    rows = [(f"f{i:03d}", "t", f"s{i % 2}", [(lv, f"{r.randint(0, 12)}".encode()) for lv in sorted(r.sample(["l0", "l1", "l2"], r.randint(0, 3)))]) for i in range(90)]
    k = spark.createDataFrame(rows, "finding_id string, tenant_id string, scope_key string, keys array<struct<level:string,value:binary>>")
    p = k.selectExpr("finding_id", "tenant_id", "scope_key", "inline(keys)").withColumn("value", F.hex("value"))
    late, b = p.where("finding_id like '%7'"), candidates.blocks(k)
    want = lambda s: {(x["finding_id"], x["candidate_id"], len(x["keys"])) for x in candidates.candidates(s, p).collect()}
    for subjects, got in ((p, candidates.shared_keys(b, b)), (late, candidates.shared_keys(b.where("finding_id like '%7'"), b))):
        rows = got.collect()
        assert {tuple(x) for x in rows} == want(subjects) and len({tuple(x)[:2] for x in rows}) == len(rows)
    counts = {x["finding_id"]: x["n_candidates"] for x in candidates.candidate_counts(k, k).collect()}
    assert counts == {x["finding_id"]: x["n_candidates"] for x in candidates.candidate_counts(p, p.select("*")).collect()} and len(counts) < 90


@pytest.mark.parametrize("name", ["candidate_counts", "candidate_places"])
def test_scratch_of_candidates_is_small(spark, name):
    """For each finding; checkpoints of fingerprints took 190 bytes."""
    before = _bytes(spark)
    getattr(queries, name)(spark, "/root/testdata/sf0.001").collect()
    assert _bytes(spark) - before < 150 * 6000


def test_findings_are_derived_once(spark):
    """run_findings reads what it wrote, and run_summary joins no ratings or CWEs with their runs."""
    assert not any("lineitem" in f for f in queries.run_findings(spark, "/root/testdata/sf0.001").inputFiles())
    assert str(queries.run_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()).count("Join ") == 2
