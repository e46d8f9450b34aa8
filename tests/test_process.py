"""Process operators, decisions, the run fold in batch and as a stream, constraints and artifacts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.digests import digest
from sparkloom.operators import checks, decisions, process
from sparkloom.sources import artifacts, documents
from sparkloom.streaming import runs


def test_outcomes(spark):
    e = [
        ("1", "s", "work-started", "2024-01-01T00:00:00Z", None), ("1", "s", "released", "2024-01-05T00:00:00Z", None), ("2", "s", "pr-ready", "2024-01-01T01:00:00Z", None), ("3", "s", "validation-completed", "2024-01-01T02:00:00Z", "fail"),
        ("4", "s", "validation-completed", "2024-01-01T03:00:00Z", "pass"), ("5", "s", "follow-up-opened", "2024-01-02T00:00:00Z", None), ("6", "t", "review-completed", "2024-01-01T00:00:00Z", None), ("7", "t", "review-requested", "2024-01-02T00:00:00Z", None),
        ("8", "t", "no-such-type", "2024-01-01T00:00:00Z", None), ("8", "t", "pr-ready", "2024-01-03T00:00:00Z", None), ("9", " ", "released", "2024-01-03T00:00:00Z", None), (None, "t", "released", "2024-01-03T00:00:00Z", None), ("10", "t", "released", "bad", None),
    ]
    valid = process.valid_outcome_events(spark.createDataFrame(e, "id string, subject string, type string, timestamp string, outcome string"))
    assert sorted(r.id for r in valid.collect()) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    got = {r.subject: r for r in process.outcome_metrics(valid, "2024-01-03T00:00:00Z").collect()}
    assert (got["s"].cycle_seconds, got["s"].follow_up_seconds, got["s"].first_pass_validation, got["s"].release_seconds) == (3600.0, 86400.0, False, None)
    assert (got["t"].review_seconds, got["t"].first_pass_validation, got["t"].follow_up_seconds) == (None, None, None)
    assert process.first_pass_rate(process.outcome_metrics(valid, "2024-01-03")).first().first_pass_rate == 0.0


RUNS = "run_id string, seq long, kind string, to int, criterion string, outcome string, errors array<string>, origin string, findings long, state string, operation_kind string, timestamp string"


def run_rows(spark):
    t = lambda n: f"2024-01-01T00:00:{n:02}Z"
    rows = [
        ("r", 1, "started", None, None, None, None, None, None, None, None, t(0)), ("r", 2, "observation", None, "c", "fail", ["x", "x", "y"], "collector-observed", None, None, None, t(1)), ("r", 3, "observation", None, "c", "pass", None, "collector-observed", None, None, None, t(2)),
        ("r", 4, "observation", None, "c", "pass", None, "claimed", None, None, None, t(3)), ("r", 5, "advanced", 4, None, None, None, None, None, None, None, t(4)), ("r", 6, "observation", None, "c", "pass", None, "claimed", None, None, None, t(5)),
        ("r", 7, "paused", None, None, None, None, None, None, None, None, t(6)), ("r", 8, "resumed", None, None, None, None, None, None, None, None, t(9)), ("r", 9, "returned", 3, None, None, None, None, 2, None, None, t(10)),
        ("r", 10, "operation", None, None, None, None, None, None, "unknown", "issue-projection", t(11)), ("q", 1, "resumed", None, None, None, None, None, None, None, None, t(1)),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_runs(spark):
    e = run_rows(spark)
    a = process.attempts(e)
    assert [(r.seq, r.phase, r.retry, r.causes) for r in a.orderBy("seq").collect()] == [(2, 0, False, None), (3, 0, True, ["x", "y"]), (4, 0, True, ["unclassified"]), (6, 4, False, None)]
    assert {r.cause: r.n for r in process.retry_causes(a).collect()} == {"x": 1, "y": 1, "unclassified": 1}
    m = {r.run_id: r for r in process.run_metrics(e).collect()}["r"]
    assert (m.attempts, m.observed, m.passed, m.evidence_seconds, m.acceptance_seconds, m.setup_seconds, m.active_seconds) == (4, 2, 1, 2.0, 4.0, 4.0, None)
    assert (m.promotions, m.returned_findings, m.unknown_operations, m.projection_failures) == (1, 2, 1, 1)
    assert {r.run_id: r.seconds for r in process.recoveries(e).collect()} == {"r": 3.0, "q": None}


def test_usage(spark):
    rows = [(1, "p", "e", "tok", 10.0, "cumulative"), (2, "p", "e", "tok", 15.0, "cumulative"), (3, "p", "e", "tok", 4.0, "delta"), (4, "p", "e", "tok", 9.0, "cumulative"), (5, "p", "e2", "tok", 1.0, "cumulative"), (6, "p", "e2", "tok", 0.5, "cumulative")]
    d = process.usage_deltas(spark.createDataFrame(rows, "seq long, provider string, epoch string, unit string, value double, mode string"))
    assert [r.delta for r in d.orderBy("seq").collect()] == [10.0, 5.0, 4.0, 5.0, 1.0, None]
    assert process.usage_totals(d).first().asDict() == {"provider": "p", "unit": "tok", "total": 25.0, "resets": 1}
    b = spark.createDataFrame([("advisory", 1.0, 9.0, 9.0, False), ("admission-enforced", 10.0, 5.0, 6.0, False), ("admission-enforced", 10.0, None, 6.0, False), ("provider-enforced", 10.0, 1.0, 1.0, False), ("provider-enforced", 10.0, 1.0, 1.0, True)], "level string, limit double, used double, estimated_next double, can_stop boolean")
    assert [r.admitted for r in process.budget_admission(b).collect()] == [True, False, False, False, True]


def test_coverage(spark):
    j = spark.createDataFrame([("a", True, ["x", "y"]), ("b", None, ["x", "z"]), ("c", False, ["z"])], "id string, required boolean, criteria array<string>")
    o = spark.createDataFrame([("x",), ("y",), ("x",)], "criterion string")
    got = {r.id: (r.required, r.missing, r.verified) for r in process.journey_coverage(j, o).collect()}
    assert got == {"a": (True, 0, True), "b": (True, 1, False), "c": (False, 1, False)}
    want = spark.createDataFrame([("release", "v1", "stable", False, 100), ("tag", "v1", "any", True, None), ("merge", "m", "any", False, None)], "kind string, target string, channel string, exercised boolean, max_age_ms long")
    seen = spark.createDataFrame([("release", "v1", True, "pass", False, None, 50, False), ("release", "v1", True, "pass", True, None, 50, False), ("tag", "v1", True, "pass", False, False, 1, False), ("merge", "m", True, "pass", False, None, 1, False), ("merge", "m", True, "fail", False, None, 1, True)], "kind string, target string, verified boolean, outcome string, prerelease boolean, exercised boolean, age_ms long, unresolved boolean")
    assert {r.kind: (r.valid, r.status) for r in process.lifecycle(want, seen).collect()} == {"release": (1, "pass"), "tag": (0, "blocked"), "merge": (1, "blocked")}


def test_sessions(spark, tmp_path):
    def record(i, kind, platform, profile, tests=None, findings=(), children=(), at="2026-01-01T00:00:00Z"):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "kind": kind, "title": i, "summary": "s", "mergedAt": at, "harness": {"platform": platform}, "sdlc": {"workflowProfile": profile, "mode": "m", "review": "r"}, "verification": {"testsPassed": tests}, "findings": [{"summary": f} for f in findings], "children": list(children)}))

    record("pr-1", "pr", "p1", "standard", 10)
    record("pr-2", "pr", "p2", "high-assurance", 15, ["f"], at="2026-01-02T00:00:00Z")
    record("rollup-1", "rollup", "p1", "high-assurance", None, (), ["pr-1", "pr-2"], "2026-01-03T00:00:00Z")
    s = documents.sessions(spark, f"file:{tmp_path}")
    assert process.kind_counts(s).first().asDict() == {"sessions": 3, "pr": 2, "rollup": 1, "release": 0}
    assert [r.testsPassed for r in process.tests_over_time(s).collect()] == [10, 15]
    assert [r.id for r in process.timeline(s).collect()] == ["pr-1", "pr-2", "rollup-1"]
    flat = s.select(F.col("harness.platform").alias("platform"), (F.col("sdlc.workflowProfile") == "high-assurance").alias("high_assurance"), F.size("findings").alias("findings"))
    rates = {r.platform: (r.sessions, r.high_assurance_rate, r.findings_rate) for r in process.platform_rates(flat).collect()}
    assert rates == {"p1": (2, 0.5, 0.0), "p2": (1, 1.0, 1.0)}
    assert process.unpivot_rates(process.platform_rates(flat)).count() == 4
    assert checks.check_sessions(s).isEmpty()
    record("pr-3", "odd", "p1", "standard", children=["pr-9"])
    assert {r.rule for r in checks.check_sessions(documents.sessions(spark, f"file:{tmp_path}")).collect()} == {"kind", "refers:child"}


def test_evaluations(spark):
    c = spark.createDataFrame([("a", "x1", "contains", "x"), ("a", "x1", "regex", "^x[0-9]$"), ("b", "{}", "json-valid", None), ("b", "{}", "not-contains", "}"), ("c", None, "contains", "x")], "case_id string, text string, kind string, value string")
    r = process.eval_score(process.assertions(c), 0.3).first()
    assert (r.cases, r.passed, r.ok) == (3, 1, True) and r.score == pytest.approx(1 / 3)
    refs = spark.createDataFrame([("k", None, True), ("k", "default", True), ("k", "s", True), ("k", "s", False)], "kind string, scope string, authoritative boolean")
    assert [(x.scope, x.n) for x in process.duplicate_authority(refs).collect()] == [("default", 2)]
    t = spark.createDataFrame([(1, "api_key = 1"), (2, "User: x" + "y" * 2000), (3, "User: x"), (4, None)], "id long, t string")
    assert sorted((x.id, x.code) for x in process.text_findings(t, "id", "t").collect()) == [(1, "evidence.secrets"), (2, "evidence.raw-log")]


def test_decisions(spark):
    def mode(requested="auto-minimal", profile="bounded", risk="low", effort="low", uncertainty="low", surfaces=(), **k):
        m = decisions.collaboration_mode(*(F.lit(x) for x in (requested, profile, risk, effort, uncertainty)), F.array(*map(F.lit, surfaces)).cast("array<string>"), **{a: F.lit(b) for a, b in k.items()})
        return spark.range(1).select(m).first()[0]

    assert mode() == "single-agent" and mode(profile="standard") == "advisory" and mode(risk="high") == "council" and mode(effort="high") == "parallel-discovery"
    assert mode(surfaces=["auth"], requested="spike") == "human-gated" and mode(requested="council") == "council" and mode(spike=True, broad=True) == "spike"
    req = spark.createDataFrame([("r", "tester", ["docs"], True)], "request_id string, owner string, surfaces array<string>, public_contract boolean")
    seats = {r.role: r.required for r in decisions.council_seats(req).collect()}
    assert seats == {"architect": True, "developer": True, "reviewer": True, "analyst": True, "technical-writer": False}
    cand = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("q", 0, "z")], "role string, place long, agent string")
    agents = spark.createDataFrame([("a", True, False), ("b", True, True)], "agent string, enabled boolean, available boolean")
    assert {x.role: (x.agent, x.status, x.tried) for x in decisions.first_available(cand, agents).collect()} == {"r": ("b", "routed", 2), "q": (None, "blocked", 1)}
    i = spark.createDataFrame([("i", "k", ["a", "b"], ["b"], False), ("j", "k", ["c"], [], True), ("l", "none", ["c"], [], False)], "intent_id string, kind string, required array<string>, optional array<string>, manual boolean")
    p = spark.createDataFrame([("p1", "k", ["a"], 0), ("p2", "k", ["b"], 1)], "provider string, kind string, facets array<string>, place long")
    assert {x.intent_id: (x.provider, x.status) for x in decisions.bind_provider(i, p).collect()} == {"i": ("p1", "degraded"), "j": (None, "manual"), "l": (None, "blocked")}
    branch = lambda b: spark.range(1).select(decisions.branch_class(F.lit(b).cast("string"))).first()[0]
    assert [branch(b) for b in (None, "main", "fix/a-1", "fix/1", "issue/12-ab", "wt/x", "other")] == ["detached", "protected", "work", "invalid", "compatibility", "compatibility", "invalid"]
    path = lambda x: spark.range(1).select(decisions.bounded_path(F.lit(x), ["secret"], ["README.md"], ["docs/"], ["test"])).first()[0]
    assert [path(x) for x in ("README.md", "docs/a", "docs/secret", "src/a", "src/test_a")] == [True, True, False, False, True]
    ok = lambda a, b: spark.range(1).select(decisions.rank_allows(F.lit(a), F.lit(b), runs.BOUNDARIES)).first()[0]
    assert ok("open-pr", "propose") and not ok("propose", "open-pr") and not ok("open-pr", "x")
    assert [spark.range(1).select(decisions.status_outcome(F.lit(s))).first()[0] for s in (404, 302, 500)] == ["dead", "alive", "queued"]


def chain(*kinds, run="r", generation=0):
    out, last = [], None
    for i, (kind, payload) in enumerate(kinds):
        d = hashlib.sha256(f"{run}{i}{kind}".encode()).hexdigest()
        out.append((run, i, f"e{i}", last, d, generation, kind, "2024-01-01T00:00:00Z", json.dumps(payload)))
        last = d
    return out


START = ("started", {"profile": "standard", "boundary": "open-pr", "goalRef": "g", "owner": "o"})
D = "a" * 64


def fold(spark, rows):
    return {r.run_id: r for r in runs.next_action(runs.fold_runs(spark.createDataFrame(rows, runs.EVENTS))).collect()}


def test_run_fold(spark):
    contract = ("contract-frozen", {"contract": {"criteria": [{"id": "c"}]}, "sourceRevision": "s"})
    advanced = [("advanced", {"from": i, "to": i + 1, "acceptanceDigest": D, "candidateDigest": D}) for i in range(8)]
    done = ("completed", {"acceptanceDigest": D, "candidateDigest": D})
    rows = chain(START, ("candidate", {"digest": D}), *advanced, done, run="full")
    rows += chain(START, contract, ("candidate", {"digest": D}), run="ready")
    rows += chain(START, ("advanced", {"from": 0, "to": 2, "acceptanceDigest": D, "candidateDigest": None}), run="skips")
    rows += chain(START, ("operation", {"id": "o", "payloadDigest": D, "state": "planned"}), ("operation", {"id": "o", "payloadDigest": D, "state": "submitted"}), run="open")
    rows += chain(START, ("operation", {"id": "o", "payloadDigest": D, "state": "submitted"}), run="early")
    rows += chain(START, ("paused", {"reason": "x"}), ("candidate", {"digest": D}), run="paused")
    rows += chain(("candidate", {"digest": D}), run="unstarted")
    rows += chain(START, ("resumed", {"previousOwnerStopped": True, "boundary": "external-action", "owner": "p"}), run="wider")
    repeated = chain(START, ("checkpoint", {}), run="repeat")
    rows += [*repeated, (*repeated[1][:1], 5, *repeated[1][2:])]
    broken = chain(START, ("checkpoint", {}), run="broken")
    rows += [broken[0], (*broken[1][:3], "0" * 64, *broken[1][4:])]
    got = fold(spark, rows)
    assert (got["full"].status, got["full"].phase, got["full"].next_action, got["full"].events) == ("completed", 8, "none", 11)
    assert got["ready"].next_action == "verify-and-advance" and got["open"].next_action == "reconcile-operations"
    assert (got["repeat"].status, got["repeat"].events, got["repeat"].next_action) == ("active", 2, "freeze-contract")
    for run, why in (("skips", "invalid phase"), ("early", "durable first"), ("paused", "requires recovery"), ("unstarted", "generation zero"), ("wider", "widen"), ("broken", "stale event parent")):
        assert got[run].status == "rejected" and why in got[run].rejected, run
    assert (got["skips"].phase, got["skips"].events) == (0, 1)


def test_rework_and_generations(spark):
    rows = chain(START, ("candidate", {"digest": D}), *[("advanced", {"from": i, "to": i + 1, "acceptanceDigest": D, "candidateDigest": D}) for i in range(4)], ("returned", {"to": 3, "findings": [{"id": "f", "requiredChange": "c"}]}), ("observation", {"observation": {"candidateDigest": D, "digest": "q", "outcome": "pass"}}), ("rework-resolved", {"id": "f", "observationDigests": ["q"]}), run="rework")
    first = chain(START, ("paused", {"reason": "x"}), ("resumed", {"previousOwnerStopped": True, "boundary": "propose", "owner": "p"}), ("checkpoint", {}), run="gen")
    late = (*first[3][:5], 1, *first[3][6:])
    got = fold(spark, [*rows, *first[:3], late])
    assert (got["rework"].phase, got["rework"].open_rework) == (3, 0)
    assert (got["gen"].generation, got["gen"].owner, got["gen"].status) == (1, "p", "active")
    assert fold(spark, first)["gen"].status == "rejected"


def test_stream_equals_batch(spark, tmp_path):
    rows = chain(START, ("candidate", {"digest": D}), ("paused", {"reason": "x"}), run="a") + chain(START, ("completed", {}), run="b")
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    names = [c.split()[0] for c in runs.EVENTS.split(", ")]
    latest = {}
    for part in (rows[:2], rows[2:]):
        (src / f"{len(list(src.iterdir()))}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part))
        stream = runs.fold_stream(runs.files_stream(spark, f"file:{src}", runs.EVENTS))

        def keep(batch, _):
            latest.update({r.run_id: r for r in batch.collect()})

        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"file:{out}").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination(120)
    want = {r.run_id: r for r in runs.fold_runs(spark.createDataFrame(rows, runs.EVENTS)).collect()}
    assert latest == want


def test_append_once(spark, tmp_path):
    path = f"file:{tmp_path}/receipts"
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    runs.append_once(df, path)
    runs.append_once(df.unionByName(spark.createDataFrame([("c", 3)], "id string, n int")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_artifacts(spark, tmp_path):
    store = artifacts.Store(spark, f"file:{tmp_path}/store")
    rows = spark.createDataFrame([("aa1", 1), ("ab2", 2)], "id string, n long")
    assert store.read("x") is None and store.unused("x") == []
    d = store.stage("x", rows)
    assert d == artifacts.table_digest(rows.repartition(3)) != artifacts.table_digest(rows.withColumn("n", F.col("n") + 1))
    with pytest.raises(Exception):
        store.publish("x", "0" * 64)
    store.publish("x", d)
    assert store.current("x") == d and store.read("x").count() == 2
    d2 = store.stage("x", rows.limit(1))
    store.publish("x", d2)
    assert store.unused("x") == [d]
    with pytest.raises(ValueError):
        store.prune("x", d)
    assert store.prune("x", d2) == [d] and store.read("x").count() == 1
    with pytest.raises(ValueError):
        store.stage("x", rows, [checks.repeated(rows.union(rows), "x", "id")])
    spark.createDataFrame([("zz", 9)], "id string, n long").withColumn("prefix", F.lit("zz")).drop("prefix").write.mode("append").parquet(store.folder("x", d2) + "/prefix=zz")
    with pytest.raises(ValueError):
        store.validate("x", d2)
    r = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 3, "a"), ("l", 4, "a")], "idempotency_key string, seq long, body string")
    assert sorted((x.idempotency_key, x.body, x.conflict) for x in artifacts.receipts(r).collect()) == [("k", "a", True), ("l", "a", False)]
    assert {x.prefix: x.records for x in artifacts.shard_index(rows).collect()} == {"aa": 1, "ab": 1}


def test_documents(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"format_version": 3, "lists": [{"id": "1", "name": "a/b", "stars": 5, "state": "eligible", "detail": "lists/x.json", "freshness": {"days": 3}}, {"id": "2", "state": "pending"}]}))
    lists = documents.index(spark, f"file:{tmp_path}/index.json")
    assert lists.count() == 2 and lists.first().freshness.days == 3
    (tmp_path / "lists").mkdir()
    for n in "xy":
        (tmp_path / "lists" / f"{n}.json").write_text(json.dumps({"repository_id": "1", "entries": [{"title": "t", "url": "u", "properties": {"Language": "Rust"}}], "entry_count": 1, "unique_links": 1}))
    assert [r.detail for r in documents.details(spark, f"file:{tmp_path}/lists", lists).collect()] == ["lists/x.json"]
    assert checks.check_details(documents.details(spark, f"file:{tmp_path}/lists")).isEmpty()
    (tmp_path / "live").mkdir()
    url = "https://github.com/o/r"
    pid = hashlib.sha256(url.encode()).hexdigest()[:20]
    rec = {"id": pid, "url": url, "owner": "o", "repo": "r", "archived": False, "last_commit_at": None, "releases": {"observed_count": 1, "latest_at": "x", "median_interval_days": 2.0}, "observed_at": "now"}
    shard = {"format_version": 1, "prefix": pid[:2], "projects": [rec]}
    (tmp_path / "live" / f"{pid[:2]}.json").write_text(json.dumps(shard | {"digest": digest(shard)}))
    live = documents.shards(spark, f"file:{tmp_path}/live", documents.LIVENESS)
    assert documents.by_id(live, [pid]).first().owner == "o"
    assert [r.rule for r in checks.check_liveness(live).collect()] == ["cadence"]
    pages = spark.createDataFrame([("q", 1, "t", json.dumps({"total_count": 2, "incomplete_results": False, "items": [{"id": 7, "full_name": "a/b", "stargazers_count": 3}, {"id": -1}]}))], "query string, page int, observed_at string, body string")
    assert [(r.id, r.name, r.total) for r in documents.search_hits(pages).collect()] == [("7", "a/b", 2)]
    answers = spark.createDataFrame([("b", json.dumps({"data": {"r0": {"x": 1}, "r1": None, "r2": {"x": 2}}, "errors": [{"path": ["r2"]}]}))], "batch string, body string")
    assert [r.alias for r in documents.batch_answers(answers).collect()] == ["r0"]
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="a" name="x"/><testcase name="y"><failure/></testcase><testcase name="z"><skipped/></testcase></testsuite>')
    assert {r.id: r.outcome for r in documents.junit(spark, f"file:{tmp_path}/j.xml").collect()} == {"a.x": "pass", "y": "fail", "z": "skipped"}
    (tmp_path / "k.xml").write_text('<!DOCTYPE x><testsuite><testcase name="x"/></testsuite>')
    with pytest.raises(Exception):
        documents.junit(spark, f"file:{tmp_path}/k.xml").collect()
    (tmp_path / "n.txt").write_text("3\t1\tsrc/a.py\n-\t-\tb.png\nnoise\n")
    assert {r.path: (r.added, r.deleted) for r in documents.change_sizes(spark, f"file:{tmp_path}/n.txt").collect()} == {"src/a.py": (3, 1), "b.png": (None, None)}
    assert documents.file_digests(spark, f"file:{tmp_path}/n.txt").first().digest == hashlib.sha256((tmp_path / "n.txt").read_bytes()).hexdigest()


def test_evidence_and_seals(spark):
    c = spark.createDataFrame([("r", "a", "d", "c"), ("r", "b", "d", "c")], "run_id string, criterion string, definition string, candidate string")
    o = spark.createDataFrame([("r", "a", "d", "c", "pass", "x", 1), ("r", "a", "d", "c", "fail", "y", 2), ("r", "a", "d", "old", "pass", "z", 3)], "run_id string, criterion string, definition string, candidate string, outcome string, digest string, seq long")
    assert {x.criterion: (x.outcome, x.digest) for x in process.latest_evidence(c, o).collect()} == {"a": ("fail", "y"), "b": ("missing", None)}
    calls = spark.createDataFrame([(1.0, False), (3.0, False), (9.0, True)], "s double, bad boolean")
    assert process.latency_stats(calls, "s", "bad").first().asDict() == {"calls": 3, "mean": 2.0, "median": 2.0, "least": 1.0, "largest": 3.0, "failure_rate": 0.3333}
    assert process.tally(spark.createDataFrame([("a",), ("a",), (None,)], "v string"), "v", ("a", "b")).first().asDict() == {"a": 2, "b": 0}
    s = process.seal(spark.createDataFrame([("1", 2.0, None)], "id string, n double, gone string"), "run-event")
    assert s.first().digest == digest({"id": "1", "n": 2, "type": "run-event", "version": 1}) and process.broken_seals(s).isEmpty()
    assert process.broken_seals(s.withColumn("n", F.lit(3.0))).count() == 1
    j = spark.createDataFrame([('{"a": "x", "n": 1}',), ('{"a": "y", "n": 1}',), ('{"a": "x", "n": "no"}',), ("bad",), (None,)], "j string")
    assert [x.parsed is not None for x in process.conforms(j, "j", "a string, n long", {"a": ["x"]}).collect()] == [True, False, False, False, False]


def test_registry_and_targets(spark):
    from sparkloom.operators import activity

    p = spark.createDataFrame([("a", "1", True, 0), ("b", "2", True, 1), ("c", "3", False, 0), ("d", "4", None, 0), ("d", "5", True, 0)], "pack_id string, path string, enabled boolean, errors long")
    assert {x.path: x.state for x in decisions.registry(p).collect()} == {"1": "valid", "2": "invalid", "3": "disabled", "4": "duplicate", "5": "duplicate"}
    t = spark.createDataFrame([("x", "y", "z", "m1"), (None, "y", "z", "m1"), (None, None, "z", "m1"), (None, None, None, "m1-a"), (None, None, None, "q")], "requested string, configured string, current string, model string")
    assert [(x.target, x.basis) for x in decisions.execution_target(t, [("^m1", "one"), ("^m", "any")]).collect()] == [("x", "explicit"), ("y", "configured"), ("z", "self"), ("one", "model"), (None, "clarification")]
    lists = spark.createDataFrame([("1", "https://x/A/", True, "eligible"), ("2", "https://x/p", True, "pending")], "id string, url string, public boolean, state string")
    q = spark.createDataFrame([("https://x/a", None), ("https://x/fork", "https://x/A"), ("https://x/p", None)], "url string, parent_url string")
    assert [x.list_id for x in activity.published_repository(q, lists).orderBy("url").collect()] == ["1", "1", None]


def test_bind_provider_of_many_intents_and_providers(spark):
    import random
    import threading

    r, names = random.Random(3), ["a", "b", "c", None]
    some = lambda: r.choice([None, [], *[r.sample(names, r.randint(1, 3)) for _ in range(6)]])
    asked = [(f"i{k}", r.choice(["x", "y", None]), some(), some(), r.random() < 0.5) for k in range(200)]
    given = [(r.choice([f"p{k}", None]), r.choice(["x", "y", None]), some(), k % 7) for k in range(12)]
    i = spark.createDataFrame(asked, "intent_id string, kind string, required array<string>, optional array<string>, manual boolean")
    p = spark.createDataFrame(given, "provider string, kind string, facets array<string>, place long")
    want = {}
    for key, kind, required, optional, manual in asked:
        ranks = []
        for name, k, facets, place in given:
            if name and kind and k == kind and required is not None:
                lacks = set(required) - set(facets or [])
                if lacks <= set(optional or []):
                    ranks.append((1 if lacks else 0, place, name))
        want[key] = (min(ranks)[2], ("bound", "degraded")[min(ranks)[0]]) if ranks else (None, "manual" if manual else "blocked")
    assert {x.intent_id: (x.provider, x.status) for x in decisions.bind_provider(i, p).collect()} == want
    # 2.5 billion pairs, few different ones
    facets = lambda c: F.filter(F.array(F.when(c % 2 == 0, "a"), F.when(c % 3 == 0, "b")), lambda f: f.isNotNull())
    many = spark.range(50_000)
    i = many.select(F.col("id").alias("intent_id"), F.lit("k").alias("kind"), facets(F.col("id")).alias("required"), F.array().cast("array<string>").alias("optional"), F.lit(False).alias("manual"))
    p = many.select(F.format_string("p%05d", "id").alias("provider"), F.lit("k").alias("kind"), facets(F.col("id")).alias("facets"), (-F.col("id")).alias("place"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    got = {x.provider: x["count"] for x in decisions.bind_provider(i, p).groupBy("provider").count().collect()}
    late.cancel()
    assert got == {"p49998": 33_333, "p49999": 16_667}
