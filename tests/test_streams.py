"""The streams' promises: no event is lost in a crash, finished jobs aren't sent again, bad events go to dead letters, half a report harms no other."""

import json

from pyspark.sql import functions as F

from findloom.operators import candidates, classes, cluster, counters, flatten, intake, reports, scoring
from findloom.operators.components import connected
from findloom.sources.tables import Tables, read_events, read_reports
from findloom.streaming import jobs

REQUEST = "arrival long, tenant_id string, tool string, scope string, scan_id string, body string"
TRIVY = json.dumps({"SchemaVersion": 2, "Results": [{"Target": "package-lock.json", "Vulnerabilities": [{"VulnerabilityID": f"CVE-2024-000{i}", "PkgName": "lib", "InstalledVersion": "1", "Severity": "HIGH"} for i in range(3)]}]})


def _place(spark, tmp_path, rows, folder="in"):
    spark.createDataFrame(rows, REQUEST).write.mode("append").json(f"{tmp_path}/{folder}")
    return Tables(spark, f"{tmp_path}/tables"), spark.createDataFrame([("t", 10_000)], "id string, max_report_bytes long")


def test_job_states_and_repeats(spark, tmp_path):
    t, tenants = _place(spark, tmp_path, [(1, "t", "trivy", "p/c", "scan-1", TRIVY), (2, "t", "trivy", "p/c", "scan-2", '{"half":')])
    run = lambda: jobs.intake_stream(read_events(spark, f"{tmp_path}/in", REQUEST), t, tenants, f"{tmp_path}/e1", f"{tmp_path}/c1").awaitTermination()
    run()
    jobs.normalize_stream(read_events(spark, f"{tmp_path}/e1/*"), t, f"{tmp_path}/e2", f"{tmp_path}/c2").awaitTermination()
    assert {(r["scan_id"], r["state"]) for r in t.read("jobs").collect()} == {("scan-1", "done"), ("scan-2", "pending")}
    assert {(r["status"], r["finding_count"], r["event_published_at"] is not None) for r in t.read("runs").collect()} == {("completed", 3, True), ("failed", None, False)}
    checked = intake.checked(spark.createDataFrame([(9, "t", "trivy", "p/c", "again", TRIVY), (10, "t", "trivy", "p/c", "half", '{"half":')], REQUEST), tenants)
    _, answers, events = intake.accept(checked, t.read("jobs"))
    assert {r["scan_id"] for r in answers.collect()} == {"scan-1", "scan-2"} and [r["scan_id"] for r in events.collect()] == ["scan-2"]


def test_crash_before_the_flag(spark, tmp_path):
    """The batch runs again after its events are out but before its runs are marked, and once more after."""
    t, tenants = _place(spark, tmp_path, [(1, "t", "trivy", "p/c", "scan-1", TRIVY)])
    events = jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants)
    now = F.current_timestamp()
    first = jobs.normalize_batch(events, t, now)
    assert first.count() == 1 and t.read("runs").where("event_published_at is null").count() == 1
    again = jobs.normalize_batch(events, t, now)
    assert [r["import_run_id"] for r in again.collect()] == [r["import_run_id"] for r in first.collect()]
    jobs.published(again, t, now)
    assert jobs.normalize_batch(events, t, now).count() == 0 and t.read("runs").where("event_published_at is null").count() == 0 and t.read("findings").count() == 3


def test_dead_letters(spark, tmp_path):
    t, tenants = _place(spark, tmp_path, [(1, "t", "trivy", "p/c", "scan-1", TRIVY)])
    jobs.published(ready := jobs.normalize_batch(jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants), t, F.current_timestamp()), t, F.current_timestamp())
    good = ready.first()["import_run_id"]
    lines = [json.dumps({"tenant_id": "t", "import_run_id": good}), json.dumps({"tenant_id": "", "import_run_id": good}), json.dumps({"tenant_id": "t", "import_run_id": "lost"}), json.dumps({"tenant_id": "t"}), "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/events")
    jobs.cluster_stream(read_events(spark, f"{tmp_path}/events"), t, f"{tmp_path}/c").awaitTermination()
    assert sorted(r["reason"] for r in t.read("dead_letters").collect()) == ["no run id", "no tenant", "undecodable", "unknown run"]
    assert t.read("dead_letters").where("reason = 'undecodable'").first()["undecodable"] == "not json"
    assert t.read("members").count() == 3 and t.read("processing_runs").count() == 1


def test_half_reports_and_many_targets(spark):
    """A report cut anywhere is told as undecodable, and flattening it harms no other; ordinals stay apart beyond 2,147 targets and with sections."""
    cuts = [(str(n), TRIVY[:n]) for n in range(0, len(TRIVY) + 1, 7)] + [("whole", TRIVY)]
    d = spark.createDataFrame(cuts, "import_run_id string, content string").withColumn("tool", F.lit("trivy"))
    assert {r["import_run_id"] for r in flatten.undecodable(d).collect()} == {n for n, x in cuts if x != TRIVY}
    rows = flatten.trivy(d).collect()
    assert [r["title"] for r in rows if r["import_run_id"] == "whole"] == [f"CVE-2024-000{i}" for i in range(3)]
    target = lambda i: {"Target": f"t{i}", "Vulnerabilities": [{"VulnerabilityID": "CVE-1"}], "Secrets": [{}], "Misconfigurations": [{}]}
    doc = json.dumps({"SchemaVersion": 2, "Results": [target(i) for i in range(2200)]})
    many = flatten.trivy(spark.createDataFrame([("r", doc)], "import_run_id string, content string"))
    assert many.count() == many.select("ordinal").distinct().count() == 3 * 2200


def test_reads(spark, tmp_path):
    """Raw objects by key, findings of a run, clusters of findings, members that runs share, lookups of one finding."""
    (tmp_path / "raw/t/scan-1").mkdir(parents=True)
    (tmp_path / "raw/t/scan-1/abc").write_text(TRIVY)
    assert [tuple(r)[:3] for r in read_reports(spark, f"{tmp_path}/raw").select("tenant_id", "scan_id", "sha256").collect()] == [("t", "scan-1", "abc")]
    f = spark.createDataFrame([("t", "b", "r1", "c1"), ("t", "a", "r1", None), ("t", "z", "r2", "c1")], "tenant_id string, finding_id string, import_run_id string, component_id string")
    c = spark.createDataFrame([("t", "c1", "pkg:npm/x")], "tenant_id string, component_id string, purl string")
    w = spark.createDataFrame([("t", "b", "CWE-9"), ("t", "b", "CWE-10")], "tenant_id string, finding_id string, cwe string")
    assert [(r["finding_id"], r["purl"], r["cwes"]) for r in reports.run_findings(f, c, w, "r1").collect()] == [("a", None, []), ("b", "pkg:npm/x", ["CWE-10", "CWE-9"])]
    m = spark.createDataFrame([("k1", "a"), ("k1", "z"), ("k2", "b")], "cluster_id string, finding_id string")
    assert {tuple(r) for r in reports.clusters_of(m, f.where("import_run_id = 'r1'")).collect()} == {("a", "k1"), ("b", "k2")}
    assert tuple(reports.shared_members(m, f, "r1").first()) == (2, 1)
    assert {tuple(r) for r in reports.shared_by_run(m, f).collect()} == {("r1", 2, 1), ("r2", 1, 1)}
    p = spark.createDataFrame([("t", "s", x, "r", "l0", "n", 1, v) for x, v in (("a", "1"), ("b", "1"), ("z", "2"), ("y", "1"))], "tenant_id string, scope_key string, finding_id string, import_run_id string, level string, strategy string, version int, value string")
    assert {r["candidate_id"] for r in candidates.candidates(p.where("finding_id = 'a'"), p).collect()} == {"b", "y"}
    assert {tuple(r) for r in candidates.pairs(p).collect()} == {("a", "b"), ("a", "y"), ("b", "y")}


def test_hubs(spark, monkeypatch):
    """A star whose centre isn't its smallest node, and a chain."""
    from findloom.operators import components

    monkeypatch.setattr(components, "HUB", 5)
    monkeypatch.setattr(components, "SMALL", 0)
    edges = [("m", f"n{i:03d}") for i in range(50)] + [("a", "n007")] + [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(30)] + [("lone", "lone")]
    got = dict(connected(spark.createDataFrame(edges, "a string, b string")).collect())
    assert {got[f"n{i:03d}"] for i in range(50)} | {got["m"], got["a"]} == {"a"} and {got[f"x{i:02d}"] for i in range(31)} == {"x00"} and got["lone"] == "lone"


def test_blocks_of_100_000(spark):
    """300,000 ordered candidates in blocks of four on two levels."""
    p = spark.range(100_000).select(F.lit("t").alias("tenant_id"), F.lit("s").alias("scope_key"), F.col("id").cast("string").alias("finding_id"), F.explode(F.array(F.struct(F.lit("l0").alias("level"), (F.col("id") / 4).cast("long").cast("string").alias("value")), F.struct(F.lit("l1").alias("level"), ((F.col("id") / 4).cast("long") + 7).cast("string").alias("value")))).alias("x")).select("*", "x.*")
    assert candidates.candidate_counts(p, p).agg(F.sum("n_candidates")).first()[0] == 300_000 and candidates.pairs(p).count() == 150_000


def test_interleaved_batches_lose_nothing(spark, tmp_path, monkeypatch):
    """While a batch is normalised, another one is accepted, and a third marks runs as published; the tables keep what all of them have written."""
    t, tenants = _place(spark, tmp_path, [(1, "007", "trivy", "p/c", "scan-1", TRIVY)])
    tenants = spark.createDataFrame([("007", 10_000)], "id string, max_report_bytes long")
    accept = lambda k: jobs.intake_batch(spark.createDataFrame([(k, "007", "trivy", "p/c", f"scan-{k}", f'{{"SchemaVersion":2,"k":{k}}}')], REQUEST), t, tenants)
    events = jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants)
    write, log = t._write, []

    def busy(name, rows):
        if name in ("runs", "jobs") and not log:
            log.append(name)
            accept(2)
        write(name, rows)
        if name == "jobs" and log == ["runs"]:
            log.append(name)
            accept(3)

    monkeypatch.setattr(t, "_write", busy)
    ready = jobs.normalize_batch(events, t, F.current_timestamp())
    monkeypatch.setattr(t, "_write", write)
    assert log == ["runs", "jobs"]
    assert {(r["tenant_id"], r["scan_id"], r["state"]) for r in t.read("jobs").collect()} == {("007", "scan-1", "done"), ("007", "scan-2", "pending"), ("007", "scan-3", "pending")}
    jobs.published(ready, t, F.current_timestamp())
    jobs.published(ready, t, F.current_timestamp())
    (run,) = t.read("runs").collect()
    assert run["status"] == "completed" and run["finding_count"] == 3 and run["event_published_at"] is not None
    checked = intake.checked(spark.createDataFrame([(9, "007", "trivy", "p/c", "again", TRIVY)], REQUEST), tenants)
    assert [r["scan_id"] for r in intake.accept(checked, t.read("jobs"))[1].collect()] == ["scan-1"]


def test_states_by_rank(spark, tmp_path):
    """A late `failed` doesn't undo a completed run, the first writer's scan stands, and flags stay."""
    t = Tables(spark, f"{tmp_path}/tables")
    row = lambda scan, state: spark.createDataFrame([("t", "s", "trivy", "x", scan, "k", "p", "c", state)], jobs.JOBS)
    for scan, state in (("first", "pending"), ("second", "pending"), ("third", "done"), ("fourth", "pending")):
        t.log("jobs", row(scan, state))
    assert [(r["scan_id"], r["state"]) for r in t.read("jobs").collect()] == [("first", "done")]
    run = lambda status, at: spark.createDataFrame([("t", "s", "trivy", "x", "scan", "p", "c", "r", status, None, 1, None, None)], jobs.RUNS).withColumn("event_published_at", F.lit(at).cast("timestamp"))
    for status, at in (("failed", None), ("completed", None), ("completed", "2024-01-01"), ("completed", None), ("failed", None)):
        t.log("runs", run(status, at))
    assert [(r["status"], str(r["event_published_at"])[:4]) for r in t.read("runs").collect()] == [("completed", "2024")]


def test_pruned_reads(spark, tmp_path):
    """A batch on one scope reads its own partitions, and no more of them when other tenants grow."""
    t = Tables(spark, f"{tmp_path}/tables")
    rows = lambda tenants, scopes: spark.createDataFrame([(x, f"s{i}", f"{x}-{i}", "l0", "v") for x in tenants for i in range(scopes)], "tenant_id string, scope_key string, finding_id string, level string, value string")
    t.append("fingerprints", rows(["a", "b"], 40))
    batch = spark.createDataFrame([("a", "s7")], "tenant_id string, scope_key string")
    read = lambda: t.read("fingerprints", of=batch)
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    before = files(read())
    plan = read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tenant_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "scope_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read().where("scope_key = 's7'").count() == 1 and 0 < len(before) < len(files(t.read("fingerprints"))) / 20
    t.append("fingerprints", rows(["c", "d"], 40))
    assert files(read()) == before and t.read("fingerprints").count() == 160
    t.append("fingerprints", rows(["a"], 40))
    assert t.read("fingerprints").count() == 160


def test_reports_that_fail_their_run(spark, tmp_path):
    """Only a registered tool's report fails, for its syntax or a value of a wrong type; text of other tools is a finding."""
    bodies = {"trivy": ['{"SchemaVersion":2,"Results":{"a":1}}', '{"SchemaVersion":2,"Results":[]}'], "semgrep": ['{"version":2}'], "homegrown": ["plain text", '{"half":']}
    rows = [(10 * i + k, "t", tool, "p/c", f"scan-{tool}-{k}", b) for i, (tool, bs) in enumerate(bodies.items()) for k, b in enumerate(bs)]
    t, tenants = _place(spark, tmp_path, rows)
    jobs.normalize_batch(jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants), t, F.current_timestamp())
    got = {r["scan_id"]: (r["status"], r["finding_count"], r["reason"]) for r in t.read("runs").collect()}
    wrong = ("failed", None, "report has a value of a wrong type")
    assert got == {"scan-trivy-0": wrong, "scan-trivy-1": ("completed", 0, None), "scan-semgrep-0": wrong, "scan-homegrown-0": ("completed", 1, None), "scan-homegrown-1": ("completed", 1, None)}
    found = {r["scan_id"]: (r["title"], r["raw"], [d["code"] for d in r["diagnostics"]][:2]) for r in t.read("findings").collect()}
    assert found == {"scan-homegrown-0": ("unparsed report", '{"bytes":10}', ["unknown_format", "unknown_tool"]), "scan-homegrown-1": ("unparsed report", '{"bytes":8}', ["unknown_format", "unknown_tool"])}


def _vulnerable(names):
    return json.dumps({"SchemaVersion": 2, "Results": [{"Target": "package-lock.json", "Vulnerabilities": [{"VulnerabilityID": f"CVE-2024-{n}", "PkgName": "lib", "InstalledVersion": "1", "Severity": "HIGH", "PkgIdentifier": {"PURL": "pkg:npm/lib@1"}} for n in names]}]})


def test_waves_and_counters(spark, tmp_path):
    """Runs that share no finding go in one wave; clusters are those of one run after another. The counters are what the queries give."""
    runs_ = [["0001", "0001"], ["0003"], ["0001", "0003"]]
    t, tenants = _place(spark, tmp_path, [(k, "t", "trivy", "p/c", f"scan-{k}", _vulnerable(x)) for k, x in enumerate(runs_)] + [(9, "t", "homegrown", "p/c", "scan-9", "plain text")])
    ready = jobs.normalize_batch(jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants), t, F.current_timestamp())
    scans = {r["scan_id"]: r["import_run_id"] for r in ready.collect()}
    t.log("runs", t.read("runs").withColumn("finished_at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(substring(scan_id, 6, 1) as int), 0)")))
    other = Tables(spark, f"{tmp_path}/replay")
    for name in ("runs", "findings"):
        (other.log if name == "runs" else other.append)(name, t.read(name))
    events = spark.createDataFrame([("t", r) for r in scans.values()], "tenant_id string, import_run_id string")
    assert jobs.cluster_batch(events, t) == 2 and jobs.cluster_batch(events, t) == 0
    for k in (0, 1, 2):
        assert jobs.cluster_batch(events.where(F.col("import_run_id") == scans[f"scan-{k}"]), other) == 1
    rows = lambda x: sorted((r["finding_id"], r["cluster_id"], str(r["confidence"]), r["reasons"]) for r in x.read("members").collect())
    assert rows(t) == rows(other) and len(rows(t)) == 5 and t.read("clusters").count() == other.read("clusters").count() == 2
    totals = lambda x: {(r["counter"], r["label"]): r["n"] for r in counters.counters_by_tool(x.read("run_counters")).groupBy("counter", "label").agg(F.sum("n").alias("n")).collect()}
    n = totals(t)
    old = totals(other)
    alone = {("findings", ""), ("skipped", "l0"), ("unfingerprinted", "")}  # the text of another tool
    assert {k: v - (k in alone) for k, v in n.items() if v > (k in alone)} == old and n["findings", ""] == 6 and n["unfingerprinted", ""] == 1 and n["skipped", "l0"] == 1 and n["created", ""] == 2
    members = t.read("members")
    for r in reports.histogram(members.select(F.col("confidence").cast("double").alias("c")), "c", reports.CONFIDENCE_BOUNDS).collect():
        assert n.get(("confidence_le", r["le"]), 0) == r["n"]
    assert n["confidence_le", "+Inf"] == n["candidates_le", "+Inf"] == members.count() == n["joined", ""] + 3
    assert {(r["level"], r["code"]) for r in t.read("finding_diagnostics").collect()} == {("info", "fingerprint_level_skipped"), ("warn", "no_fingerprint")}
    p = t.read("fingerprints")
    mine = p.where(F.col("import_run_id") == scans["scan-2"])
    assert sorted(r["n_candidates"] for r in candidates.candidate_counts(mine, p).collect()) == [1, 2]


def test_large_reports_leave_their_task(spark, tmp_path):
    """One report of 20,000 findings among small ones: parsed in a task of its own, its findings dealt to all."""
    large, small = _vulnerable([f"{i:04d}" for i in range(20_000)]), _vulnerable(["0001"])
    d = spark.createDataFrame([("big", "trivy", large)] + [(f"r{i}", "trivy", small) for i in range(40)], "import_run_id string, tool string, content string")
    dealt = jobs.by_size(d, target=len(large))
    where = {r["import_run_id"]: r["p"] for r in dealt.select("import_run_id", F.spark_partition_id().alias("p")).collect()}
    assert len(where) == 41 and sum(p == where["big"] for p in where.values()) <= 20
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    flatten.stamped(flatten.route(dealt), F.current_timestamp()).repartition("finding_id").withColumn("p", F.spark_partition_id()).write.parquet(f"{tmp_path}/found")
    sizes = sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/found").groupBy("p").count().collect())
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert sum(sizes) == 20_040 and len(sizes) > 1 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_spread(spark, tmp_path):
    """One row group is dealt to all cores, whatever the keys hold; a table of many splits isn't moved."""
    from findloom.sources.tables import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(10_000).selectExpr("nullif(id, 7) id", "id % 3 x").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() == cores and sorted(dealt.collect(), key=str) == sorted(one.collect(), key=str)
    assert spread(one.limit(0), "id").count() == 0
    wide = spark.range(0, 100, 1, 4 * cores)
    assert spread(wide, "id") is wide


def test_blocker_scorer_and_clusterer_of_ones_own(spark, tmp_path):
    """Two reports of one scope name the same vulnerability; the stream uses a blocker without pairs of two classes, a scorer that is told of copies alone and a
    clusterer of one group. (Copies whose own pairs don't merge would stay single, whatever the clusterer says: see classes.)"""
    t, tenants = _place(spark, tmp_path, [(k, "t", "trivy", "p/c", f"scan-{k}", _vulnerable(x)) for k, x in enumerate((["0001"], ["0001", "0003"]))])
    ready = jobs.normalize_batch(jobs.intake_batch(spark.read.schema(REQUEST).json(f"{tmp_path}/in"), t, tenants), t, F.current_timestamp())
    events = spark.createDataFrame([tuple(r) for r in ready.select("tenant_id", "import_run_id").collect()], "tenant_id string, import_run_id string")
    seen = []

    def inside(prints, table):
        return classes.class_pairs(prints, table).where("a = b")

    def told(pairs, recs, config=None):
        seen.append((pairs.count(), pairs.where("a <> b").count()))
        return scoring.score_pairs(pairs, recs, config)

    def one_group(findings, edges, existing):
        seen.append(edges.count())
        assigned, review = cluster.cluster(findings, edges, existing)
        return assigned.withColumn("cluster_id", F.lit("all")), review

    jobs.cluster_batch(events, t, joint=True, blocker=inside, scorer=told, clusterer=one_group)
    assert seen == [(1, 0), 0] and {r["cluster_id"] for r in t.read("members").collect()} == {"all"}
