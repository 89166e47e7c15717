"""The three jobs as micro-batches. Every batch is idempotent, so an event that comes twice, or a restart, leaves the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findloom.config import ScoringConfig, ToolSpec, standard_tools
from findloom.operators import candidates, classes, cluster, counters, dims, fingerprint, flatten, intake, normalize, runs, scoring
from findloom.operators.components import checkpointed
from findloom.sources.tables import UNDECODABLE, Tables, read_parts, within, write_raw

JOBS = "tenant_id string, scope_key string, tool string, sha256 string, scan_id string, raw_key string, product_id string, context_id string, state string"
RUNS = "tenant_id string, scope_key string, tool string, sha256 string, scan_id string, product_id string, context_id string, import_run_id string, status string, finished_at timestamp, finding_count long, reason string, event_published_at timestamp"
MEMBERS = "cluster_id string, finding_id string, tenant_id string, scope_key string, confidence decimal(4,3), reasons string, decided_by string"


def _stream(source: DataFrame, batch, checkpoint: str, once: bool = True) -> StreamingQuery:
    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def intake_batch(requests: DataFrame, tables: Tables, tenants: DataFrame) -> DataFrame:
    """Accepts requests against all jobs so far: no watermark, as an old key still counts. Returns the events to send."""
    checked = checkpointed(intake.checked(requests, tenants))
    new, answers, events = intake.accept(checked, tables.read("jobs", JOBS, checked))
    new, events = checkpointed(new), checkpointed(events)
    won = answers.where("is_new").select("arrival", "tenant_id", F.col("scan_id").alias("won"))
    bodies = checked.join(won, ["arrival", "tenant_id"]).select("tenant_id", F.col("won").alias("scan_id"), "sha256", F.col("body").alias("content"), "size_bytes")
    write_raw(bodies, tables.path("raw"))
    tables.log("jobs", new)
    return events


def normalize_batch(events: DataFrame, tables: Tables, clock, tools: dict[str, ToolSpec] | None = None, macro_scores=None) -> DataFrame:
    """Reports of events (raw_key, tenant_id, product_id, context_id, tool, scan_id) to findings and their child tables; jobs of completed runs are done.
    Returns the runs whose event has to go out; published() says so once it has."""
    wanted = checkpointed(events.dropDuplicates(["raw_key"]).withColumns({"scope_key": fingerprint.scope_key(), "raw_tenant": F.substring_index("raw_key", "/", 1)}))
    raw = within(read_parts(tables.spark, tables.path("raw")), wanted.select(F.col("raw_tenant").alias("tenant_id")))
    reports = wanted.join(raw.select(F.concat_ws("/", "tenant_id", "scan_id", "sha256").alias("raw_key"), "sha256", "content"), "raw_key")
    started = checkpointed(runs.start(reports.select("tenant_id", "scope_key", "tool", "sha256", "scan_id", "product_id", "context_id", "content"), tables.read("runs", RUNS, wanted)))
    bad = checkpointed(flatten.undecodable(started, tools))
    good = started.join(bad, "import_run_id", "left_anti")
    found = flatten.stamped(flatten.route(by_size(good.select("tenant_id", "scope_key", "product_id", "context_id", "tool", "scan_id", "import_run_id", "content")), tools), clock, tools).repartition("finding_id")  # a large report's findings leave its task
    found = checkpointed(normalize.normalize(found, tools, macro_scores).withColumn("component_id", dims.component_id()))
    tables.append("components", dims.new_components(found))
    tables.append("findings", found)
    tables.append("ratings", dims.ratings(found, ("scope_key",)))
    tables.append("cwes", dims.finding_cwes(found, ("scope_key",)))
    blank = started.drop("content").withColumns({"finished_at": F.lit(None).cast("timestamp"), "finding_count": F.lit(None).cast("long"), "reason": F.lit(None).cast("string"), "event_published_at": F.lit(None).cast("timestamp")})
    failed = runs.fail(blank, bad)
    done = runs.complete(failed.where("status = 'running'"), found, clock)
    tables.log("runs", done.unionByName(failed.where("status = 'failed'")))
    # jobs that another batch accepts meanwhile are rows of their own: nothing is replaced
    finished = tables.read("jobs", JOBS, wanted).where("state <> 'done'").join(done.select(*runs.KEY), runs.KEY, "left_semi")
    tables.log("jobs", finished.withColumn("state", F.lit("done")))
    return checkpointed(runs.to_publish(tables.read("runs", RUNS, wanted)))


def by_size(reports: DataFrame, content: str = "content", target: int = 32 << 20) -> DataFrame:
    """reports dealt to tasks of about `target` bytes: one that is larger than a quarter of that has a task of its own, others share by hash."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    total, large = reports.agg(F.coalesce(F.sum(size), F.lit(0)), F.count_if(4 * size > target)).first()
    bins = max(1, -(-total // target))
    place = F.when(4 * size > target, F.concat(F.lit("large"), F.col("import_run_id"))).otherwise(F.pmod(F.xxhash64("import_run_id"), F.lit(bins)).cast("string"))
    return reports.withColumn("__place", place).repartition(int(bins + 2 * large), "__place").drop("__place")


def published(ready: DataFrame, tables: Tables, clock) -> None:
    """Marks runs whose event is out. A crash before this sends an event again, never none: readers take each run once."""
    own = tables.read("runs", RUNS, ready.withColumn("scope_key", fingerprint.scope_key())).join(ready.select("import_run_id"), "import_run_id", "left_semi")
    tables.log("runs", runs.published(own, ready, clock))


def cluster_batch(events: DataFrame, tables: Tables, tools: dict[str, ToolSpec] | None = None, config: ScoringConfig | None = None, joint: bool = False, scorer=None, clusterer=None, blocker=None) -> int:
    """Completed runs to fingerprints and clusters, with counters and diagnostics; bad events go to dead_letters. Returns how many waves it took.

    Runs of one scope are replayed in the order in which they finished, as that decides what joins what. Only runs that share a fingerprint can meet in a score, so a wave takes every run
    whose earlier runs with a common fingerprint are done: the rest of a backfill goes at once, with the result of one run after another. joint=True takes all runs at
    once and may merge groups that a replay keeps apart. Copies are classes with counts, never pairs. scorer, clusterer and blocker replace score_pairs, cluster() and class_pairs();
    a blocker may keep pairs of classes apart that share a fingerprint, but bring none together that don't, as waves rely on that.
    """
    tools = tools or standard_tools()
    all_runs = tables.read("runs", RUNS, events)
    valid, dead = runs.split_events(events, all_runs)
    tables.append("dead_letters", dead)
    todo = runs.unprocessed(valid, tables.read("processing_runs", "tenant_id string, import_run_id string", events)).select("tenant_id", "import_run_id")
    own = all_runs.join(todo, ["tenant_id", "import_run_id"], "left_semi").select("tenant_id", "import_run_id", "scope_key", F.col("tool").alias("run_tool"), "finished_at")
    own = checkpointed(own)
    if own.isEmpty():
        return 0
    findings = tables.read("findings", of=own).drop("description", "raw")
    now = checkpointed(fingerprint.with_place(findings.join(own.select("import_run_id", "run_tool"), "import_run_id")))
    prints = checkpointed(fingerprint.fingerprints(now, tools))
    after = checkpointed(run_order(own, prints.limit(0) if joint else prints))
    waves = 0
    while not own.isEmpty():
        waiting = after.join(own.select(F.col("import_run_id").alias("earlier")), "earlier", "left_semi").select("import_run_id").distinct()
        ready = checkpointed(own.join(waiting, "import_run_id", "left_anti"))
        mine = ready.select("import_run_id")
        _wave(ready, now.join(mine, "import_run_id", "left_semi"), prints.join(mine, "import_run_id", "left_semi"), tables, tools, config, scorer, clusterer, blocker)
        own, waves = checkpointed(own.join(mine, "import_run_id", "left_anti")), waves + 1
    return waves


def run_order(batch: DataFrame, prints: DataFrame) -> DataFrame:
    """(earlier, import_run_id): runs of a scope that have to be clustered one after the other, as they share a fingerprint; of each fingerprint's runs only neighbours in the order."""
    order = F.struct("finished_at", "import_run_id")
    runs_of = prints.select(*candidates.KEY, "import_run_id").distinct().join(batch.select("import_run_id", "finished_at"), "import_run_id")
    earlier = F.lag("import_run_id").over(W.partitionBy(*candidates.KEY).orderBy(order))
    return runs_of.select(earlier.alias("earlier"), "import_run_id").where("earlier is not null").distinct()


def _wave(batch: DataFrame, now: DataFrame, prints: DataFrame, tables: Tables, tools: dict[str, ToolSpec], config: ScoringConfig | None, scorer, clusterer, blocker) -> None:
    tables.append("fingerprints", prints)
    findings = tables.read("findings", of=batch)
    index, members = tables.read("fingerprints", of=batch), tables.read("members", MEMBERS, batch)
    # of earlier findings only those that share a fingerprint with the batch, in its own scopes, and only such fingerprints
    now_keys = prints.select(*candidates.KEY).distinct()
    own = prints.select("finding_id")
    shared = checkpointed(index.join(now_keys, candidates.KEY, "left_semi").join(own, "finding_id", "left_anti").select("finding_id", *candidates.KEY))
    ids = shared.select("finding_id").distinct()
    clustered = members.select("finding_id", "cluster_id").join(ids.union(own), "finding_id", "left_semi")
    recs = scoring.records(fingerprint.with_place(findings.join(clustered.select("finding_id").union(own).distinct(), "finding_id", "left_semi")))
    recs, all_prints = checkpointed(recs), checkpointed(shared.unionByName(prints.select("finding_id", *candidates.KEY)))
    membership, table = classes.classes(all_prints, recs, clustered, ids.join(clustered, "finding_id", "left_anti"))
    pairs = checkpointed((blocker or classes.class_pairs)(all_prints, table))
    edges = classes.scored_classes(all_prints, recs, table, config, scorer, pairs)
    assigned, review = classes.cluster_classes(membership, table, edges, clusterer)
    assigned = checkpointed(assigned)
    clusters, rows = cluster.new_tables(assigned)
    tables.append("clusters", clusters)
    tables.append("members", rows.join(assigned.select("finding_id", "scope_key"), "finding_id"))
    counts = candidates.candidate_counts(prints, all_prints)
    tables.append("run_counters", counters.run_counters(now, pairs, edges, assigned, review, counts, tools))
    tables.append("finding_diagnostics", fingerprint.diagnostics(now, tools))
    tables.append("processing_runs", batch.select("tenant_id", "import_run_id"))


def intake_stream(requests: DataFrame, tables: Tables, tenants: DataFrame, events_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Events land as JSON in a folder of the batch, so a batch that runs again replaces its own."""
    def batch(df: DataFrame, number: int) -> None:
        intake_batch(df, tables, tenants).write.mode("overwrite").json(f"{events_path}/batch={number}")

    return _stream(requests, batch, checkpoint, once)


def normalize_stream(events: DataFrame, tables: Tables, events_path: str, checkpoint: str, tools=None, once: bool = True, macro_scores=None) -> StreamingQuery:
    """Events are added to a folder of the batch before their runs are marked. macro_scores are CVSS 4's published scores (see functions.cvss4)."""
    def batch(df: DataFrame, number: int) -> None:
        blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        broken = F.col(UNDECODABLE).isNotNull() if UNDECODABLE in df.columns else F.lit(False)
        told = df.withColumn("reason", F.when(broken, "undecodable").when(blank("tenant_id"), "no tenant").when(blank("raw_key"), "no raw key"))
        tables.append("dead_letters", told.where("reason is not null"))
        fine = told.where("reason is null").drop("reason", UNDECODABLE)
        ready = normalize_batch(fine, tables, F.current_timestamp(), tools, macro_scores)
        ready.write.mode("append").json(f"{events_path}/batch={number}")
        published(ready, tables, F.current_timestamp())

    return _stream(events, batch, checkpoint, once)


def cluster_stream(events: DataFrame, tables: Tables, checkpoint: str, tools=None, config=None, once: bool = True) -> StreamingQuery:
    return _stream(events, lambda df, _: cluster_batch(df, tables, tools, config), checkpoint, once)

