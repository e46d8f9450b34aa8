from pyspark.sql import functions as F

from sparkloom.operators import decisions
from sparkloom.operators import governance as g


def codes(found):
    return sorted((r.key, r.code) for r in found.collect())


def test_attribution(spark):
    claims = spark.createDataFrame([("ok", True, "standard", None), ("one", False, None, None), ("none", True, None, None), ("self", True, "standard", None), ("said", True, "high-assurance", "small team"), ("odd", True, None, None)], "claim_id string, multi_agent boolean, profile string, disclosure string")
    row = lambda c, role, actual, ind="independent", status="pass": (c, role, "a", actual, "worktree", ind, status)
    rows = [row("ok", "developer", "a"), row("ok", "review", "b"), row("one", "developer", "zz"), row("self", "developer", "a"), row("self", "review", "a"), row("self", "tester", "b"), row("said", "developer", "a"), row("said", "review", "a", "self-review"), row("said", "tester", "b"), row("odd", "developer", "a", "x", "what"), row("odd", "review", "b", "self-review")]
    df = spark.createDataFrame(rows, "claim_id string, role string, planned string, actual string, context string, independence string, status string")
    assert codes(g.attribution(df, claims, ["a", "b"])) == [("none", "attribution.rows"), ("odd", "attribution.independence"), ("odd", "attribution.not-self-review"), ("odd", "attribution.status"), ("said", "attribution.high-assurance"), ("self", "attribution.self-review")]
    r = {x.key: x.ok for x in g.report(g.attribution(df, claims, ["a", "b"]), claims.select(F.col("claim_id").alias("key"))).collect()}
    assert r["ok"] and r["one"] and not r["self"]


def test_evidence(spark):
    schema = "id string, mode string, reason string, synthesis string, local_only boolean, helpers array<struct<role:string,permissions:string,executor:string,transport:string,single_writer:boolean>>, loops array<struct<max_iterations:int,stop_conditions:array<string>,exit_reason:string>>"
    h = lambda p, w=None: ("r", p, "e", "t", w)
    rows = [("ok", "council", "r", "s", True, [h("reader"), h("reader")], None), ("alone", "single-agent", "r", None, None, None, None), ("few", "council", "r", "s", True, [h("reader")], []), ("spike", "spike", "r", "s", True, [h("writer", True)], [(1, ["x"], "done")]), ("bad", "advisory", None, None, None, [h("writer"), h("writer")], [(0, [], None)])]
    got = codes(g.collaboration_evidence(spark.createDataFrame(rows, schema), ("single-agent", "advisory", "council", "spike")))
    assert [k for k, _ in got if k != "bad"] == ["few"]
    assert {c for k, c in got if k == "bad"} == {"evidence.reason", "evidence.writers", "evidence.single-writer", "evidence.synthesis", "evidence.local", "evidence.iterations", "evidence.stop", "evidence.exit"}


def test_transitions(spark):
    s = spark.createDataFrame([("1", "observed", None, "s", None, None, None), ("2", "accepted", "triaged", "s", "analyst", "g", None), ("3", "accepted", "proposed", "s", "developer", None, "developer"), ("4", "odd", "observed", " ", None, None, None)], "id string, state string, previous string, summary string, triage_role string, goal_ref string, next_role string")
    assert codes(g.signals(s)) == [("3", "signal.goal"), ("3", "signal.route"), ("3", "signal.transition"), ("3", "signal.triage"), ("4", "signal.state"), ("4", "signal.summary"), ("4", "signal.transition")]
    h = spark.createDataFrame([("1", "proposed", None, None, None, None, None, None, None), ("2", "ready", "proposed", "pr-readiness", "o", "r", None, ["a"], ["v"]), ("3", "completed", "ready", "developer", None, None, None, [], None)], "id string, state string, previous string, source_role string, external_owner string, rollback_ref string, rollback_reason string, artifacts array<string>, validations array<string>")
    assert codes(g.handoffs(h)) == [("3", f"handoff.{x}") for x in ("artifacts", "owner", "rollback", "source", "transition", "validations")]


def test_issues_and_manifests(spark):
    i = spark.createDataFrame([("1", "## Acceptance criteria\nx", ["bug"]), ("2", "a feature", ["old:x"]), ("3", None, None)], "id string, body string, labels array<string>")
    body, labels = F.col("body"), F.col("labels")
    found = g.issues(i, ["bug"], ["old:"], decisions.release_impact(body, labels), decisions.release_assignment(body, labels, F.lit("open"), F.lit(None).cast("string")))
    assert codes(found) == [("1", "issue.release.assignment"), ("2", "issue.acceptance"), ("2", "issue.labels.forbidden"), ("2", "issue.labels.type"), ("2", "issue.release.assignment"), ("3", "issue.acceptance"), ("3", "issue.labels.type")]
    m = spark.createDataFrame([("1", 0.5, [("a", ["regex"])]), ("2", 1.5, [("a", ["odd"]), ("a", [])]), ("3", None, [])], "id string, threshold double, cases array<struct<id:string,kinds:array<string>>>")
    assert codes(g.manifests(m)) == [("2", "eval.kinds"), ("2", "eval.threshold"), ("2", "eval.unique"), ("3", "eval.cases"), ("3", "eval.threshold")]


def test_observations(spark):
    schema = "id string, candidate string, wanted_candidate string, definition string, wanted_definition string, origin string, outcome string, source_verified boolean, completed_at string, assertions array<struct<id:string,outcome:string>>, required array<string>"
    rows = [("1", "c", "c", "d", "d", "collector-observed", "pass", True, "2024-01-01T00:00:00Z", [("a", "pass")], ["a"]), ("2", "x", "c", "d", None, "claimed", "fail", None, "2024-02-01T00:00:00Z", [("a", "fail")], ["a"]), ("3", "c", "c", "d", "d", "collector-observed", "pass", True, "2023-01-01T00:00:00Z", None, [])]
    got = codes(g.observations(spark.createDataFrame(rows, schema), "2024-01-02T00:00:00Z", 10 * 86_400_000))
    assert [c for k, c in got if k == "1"] == [] and {c for k, c in got if k == "3"} == {"observation.required", "observation.age"}
    assert {c for k, c in got if k == "2"} == {f"observation.{x}" for x in ("candidate", "definition", "origin", "outcome", "source", "assertions", "age")}


def test_council(spark):
    req = spark.createDataFrame([("ok", "d", "o", [("a", True), ("b", False)]), ("bad", "d", "o", [("a", True), ("c", True)])], "request_id string, digest string, owner string, seats array<struct<role:string,required:boolean>>")
    adv = spark.createDataFrame([("ok", "x", "d", "a", [("1", True), ("2", False)]), ("bad", "y", "old", "a", [("1", True)]), ("bad", "z", "d", "a", []), ("bad", "w", "d", "q", [])], "request_id string, digest string, request_digest string, role string, objections array<struct<id:string,blocking:boolean>>")
    syn = spark.createDataFrame([("ok", "d", "complete", ["x"], [("x", "1", "accepted", "r")]), ("bad", "old", "draft", ["y"], [("y", "1", "accepted", " ")])], "request_id string, request_digest string, status string, advice_digests array<string>, dispositions array<struct<advice_digest:string,objection_id:string,disposition:string,reason:string>>")
    assert codes(g.council(req, adv, syn)) == [("bad", f"council.{x}") for x in ("digests", "incomplete", "missing", "objection", "stale-advice", "stale-synthesis", "twice", "uninvited")]


def test_deliveries_and_pairs(spark):
    schema = "delivery_id string, handoff_state string, handoff_digest string, handoff_contract string, bound_handoff string, contract_digest string, bound_contract string, delivery_role string, producer_role string, candidate string, bound_candidate string, delivery_status string, criteria array<struct<id:string,required:boolean,verification:string>>, results array<struct<id:string,status:string,evidence:int>>"
    base = ("issued", "h", "c", "h", "c", "c", "r", "r", "x", "x", "submitted")
    rows = [("pass", *base, [("1", True, "deterministic")], [("1", "pass", 1)]), ("judge", *base, [("1", True, "semantic")], []), ("fail", *base, [("1", True, "deterministic")], [("1", "pass", 0)]), ("role", *base[:7], "other", *base[8:], None, None)]
    got = {r.delivery_id: r for r in g.deliveries(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {"pass": "pass", "judge": "semantic-review-required", "fail": "fail", "role": "fail"}
    assert [c.id for c in got["role"].checks if not c["pass"]] == ["role-binding"]
    e = spark.createDataFrame([("s", "p1", "dev", "test", "pass"), ("s", "p2", "test", "rev", "pass"), ("t", "p1", "dev", "test", "pass"), ("u", "p1", "dev", "test", "pass"), ("u", "p2", "dev", "rev", "pass")], "subject string, platform string, from_role string, to_role string, status string")
    assert {r.subject: r.ok for r in g.acceptance_pairs(e, "p1", "p2").collect()} == {"s": True, "t": False, "u": False}


def test_session_records(spark):
    body = """## Agent review
- Implemented by: p1
- Mode: multi-agent
- Review: self-review
- Workflow profile: high-assurance
## Workflow evidence
- Role-pass summary: did it
## CI-equivalent validation
- Status: passed
- Commands: `make`, `pytest`
pytest: 12 passed
## Role attribution matrix
| role | who |
|---|---|
| developer | a |
| review | b |
## Follow-up issues
#7 and #8
## Implemented issues
- Closes #4
- Implements #3
## Related issues
- Refs #3
- Refs #9
"""
    rows = spark.createDataFrame([(1, "T", "u", "2026-01-01", body), (2, "U", "u", "2026-01-02", None)], "number long, title string, url string, merged_at string, body string")
    a, b = g.session_records(rows).orderBy("id").collect()
    assert (a.id, a.summary, a.harness.platform, a.sdlc.mode, a.sdlc.review, a.sdlc.humanReviewRequired, a.verification.testsPassed) == ("pr-1", "did it", "p1", "multi-agent", "self-review", True, 12)
    assert a.sdlc.phasesRun == ["developer", "review"] and [(i.number, i.relation) for i in a.repository.issues] == [(3, "implements"), (4, "closes"), (9, "refs")] and a.followUps == [7, 8]
    assert [(v.name, v.result) for v in a.verification.validators] == [("make", "passed"), ("pytest", "passed")]
    assert (b.summary, b.harness.platform, b.verification.testsPassed, len(b.sdlc.phasesRun)) == ("U", "human", None, 9) and b.followUps == [] and b.repository.issues == []
    r = g.rollup_record(g.session_records(rows), "rollup-1", "R", "2026-01-03").first()
    assert r.children == ["pr-1", "pr-2"]


def test_merges(spark):
    assert g.deep_merge({"a": [1, 2], "b": {"c": 1}}, {"a": [2, 3], "b": {"d": 2}, "e": 0}) == {"a": [1, 2, 3], "b": {"c": 1, "d": 2}, "e": 0}
    m = spark.createDataFrame([({"x": ["1"]}, {"x": ["2", "1"], "y": ["3"]})], "a map<string,array<string>>, b map<string,array<string>>").select(g.merged_maps(F.col("a"), F.col("b")).alias("m")).first().m
    assert m == {"x": ["1", "2"], "y": ["3"]}
