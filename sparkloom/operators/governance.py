"""Validators of process records as findings: key, severity, code. A record is in order if it has no blocker or high one.

Nested records come as structs and arrays, so that most rules are one pass without a shuffle; only rules between
records (distinct agents, council advice, pairs of envelopes) join or group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import micros
from ..functions.markdown import field, section, table_rows

#: Vocabularies of attribution rows, signals and handoffs.
CONTEXTS = ("current-session", "fresh-session", "forked-context", "local-cli-child-process", "provider-api-call", "human-handoff", "worktree", "intercom-session")
INDEPENDENCE = ("independent", "self-review", "not-applicable")
STATUSES = ("pass", "blocked", "returned", "skipped")
SIGNAL_MOVES = (("observed", "proposed"), ("proposed", "triaged"), ("triaged", "accepted"), ("triaged", "rejected"))
HANDOFF_MOVES = (("proposed", "ready"), ("ready", "accepted"), ("accepted", "completed"), ("proposed", "blocked"), ("ready", "blocked"), ("accepted", "blocked"))
PHASES = ("product-manager", "analyst", "architect", "implementation-planner", "developer", "tester", "reviewer", "technical-writer", "pr-readiness")
LIFECYCLE_KINDS = ("merge", "checks", "tag", "release", "deployment", "rollback")


def findings(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each rule that a record breaks: key, severity, code. A rule says what is wrong; null is not wrong."""
    found = F.array(*(F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, bad in rules))
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("key", "f.severity", "f.code")


def report(found: DataFrame, keys: DataFrame) -> DataFrame:
    """key, findings, ok for each key."""
    rows = keys.select("key").distinct().join(found, "key", "left").groupBy("key")
    return rows.agg(F.count("code").alias("findings"), (F.count_if(F.col("severity").isin("blocker", "high")) == 0).alias("ok"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def empty(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def not_in(value: Column, allowed) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def bad_move(before: Column, after: Column, first: str, moves) -> Column:
    """Whether a state can't follow the one before it; the first state follows none."""
    pairs = [f"{a}>{z}" for a, z in moves]
    return F.coalesce((after != first) & not_in(F.concat_ws(">", before, after), pairs), F.lit(False))


def attribution(rows: DataFrame, claims: DataFrame, platforms: list[str], roles=(*PHASES, "review", "orchestrator")) -> DataFrame:
    """Findings on claims that several agents took part. claims: claim_id, multi_agent, profile, disclosure; rows: claim_id,
    role, planned, actual, context, independence, status. Claims of one agent have none."""
    several = claims.where("multi_agent")
    own = rows.join(several.select("claim_id"), "claim_id", "left_semi")
    per_row = findings(
        own, "claim_id",
        [
            ("low", "attribution.role", not_in(F.col("role"), roles)), ("high", "attribution.planned", not_in(F.col("planned"), platforms)), ("high", "attribution.actual", not_in(F.col("actual"), platforms)),
            ("high", "attribution.context", not_in(F.col("context"), CONTEXTS)), ("high", "attribution.independence", not_in(F.col("independence"), INDEPENDENCE)),
            ("high", "attribution.status", not_in(F.substring_index(F.coalesce("status", F.lit("")), ":", 1), STATUSES)),
        ],
    )
    pick = lambda role, c: F.min(F.when(F.col("role") == role, F.col(c)))
    by_claim = several.join(
        own.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("actual", F.lit(""))).alias("agents"), pick("developer", "actual").alias("dev"), pick("review", "actual").alias("rev"), pick("review", "independence").alias("ind")),
        "claim_id", "left",
    )
    same, disclosed = F.col("dev") == F.col("rev"), (F.col("ind") == "self-review") & ~empty(F.col("disclosure")) & (F.lower(F.trim("disclosure")) != "not-applicable")
    whole = findings(
        by_claim, "claim_id",
        [
            ("high", "attribution.rows", F.col("n").isNull()), ("high", "attribution.agents", F.col("agents") < 2), ("high", "attribution.self-review", same & ~F.coalesce(disclosed, F.lit(False))),
            ("high", "attribution.high-assurance", same & disclosed & (F.col("profile") == "high-assurance")), ("high", "attribution.not-self-review", ~same & (F.col("ind") == "self-review")),
        ],
    )
    return together(per_row, whole)


def collaboration_evidence(rows: DataFrame, modes) -> DataFrame:
    """Findings on records (id, mode, reason, synthesis, local_only, helpers array<struct<role, permissions, executor,
    transport, single_writer>>, loops array<struct<max_iterations, stop_conditions, exit_reason>>)."""
    n = F.when(F.col("helpers").isNull(), 0).otherwise(F.size("helpers"))
    writers = F.size(F.filter("helpers", lambda h: h["permissions"] == "writer"))
    some = lambda a, f: F.coalesce(F.exists(a, f), F.lit(False))
    return findings(
        rows, "id",
        [
            ("high", "evidence.mode", not_in(F.col("mode"), modes)), ("high", "evidence.reason", empty(F.col("reason"))), ("high", "evidence.helpers", (F.col("mode") != "single-agent") & (n == 0)),
            ("high", "evidence.two-helpers", F.col("mode").isin("council", "parallel-discovery") & (n < 2)), ("high", "evidence.writers", writers > 1), ("high", "evidence.writer-mode", (writers == 1) & (F.col("mode") != "spike")),
            ("high", "evidence.role", some("helpers", lambda h: empty(h["role"]))), ("high", "evidence.permissions", some("helpers", lambda h: empty(h["permissions"]))),
            ("low", "evidence.executor", some("helpers", lambda h: (h["permissions"] != "human-gate") & (empty(h["executor"]) | empty(h["transport"])))),
            ("high", "evidence.single-writer", some("helpers", lambda h: (h["permissions"] == "writer") & ~F.coalesce(h["single_writer"], F.lit(False)))),
            ("high", "evidence.synthesis", (n > 0) & empty(F.col("synthesis"))), ("low", "evidence.local", (n > 0) & ~F.coalesce("local_only", F.lit(False))),
            ("high", "evidence.iterations", some("loops", lambda x: ~F.coalesce(x["max_iterations"] >= 1, F.lit(False)))), ("high", "evidence.stop", some("loops", lambda x: F.coalesce(F.size(x["stop_conditions"]) < 1, F.lit(True)))),
            ("high", "evidence.exit", some("loops", lambda x: empty(x["exit_reason"]))),
        ],
    )


def signals(rows: DataFrame) -> DataFrame:
    """Findings on external signals: id, state, previous, summary, triage_role, goal_ref, next_role."""
    states = {x for move in SIGNAL_MOVES for x in move}
    return findings(
        rows, "id",
        [
            ("high", "signal.state", not_in(F.col("state"), states)), ("high", "signal.summary", empty(F.col("summary"))), ("high", "signal.transition", bad_move(F.col("previous"), F.col("state"), "observed", SIGNAL_MOVES)),
            ("high", "signal.triage", F.col("state").isin("triaged", "accepted", "rejected") & not_in(F.col("triage_role"), ("product-manager", "analyst"))),
            ("high", "signal.goal", (F.col("state") == "accepted") & empty(F.col("goal_ref"))), ("high", "signal.route", F.col("next_role") == "developer"),
        ],
    )


def handoffs(rows: DataFrame) -> DataFrame:
    """Findings on delivery handoffs: id, state, previous, source_role, external_owner, rollback_ref, rollback_reason,
    artifacts, validations (array<string>)."""
    states = {x for move in HANDOFF_MOVES for x in move}
    ready = F.col("state").isin("ready", "accepted", "completed")
    none = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    return findings(
        rows, "id",
        [
            ("high", "handoff.state", not_in(F.col("state"), states)), ("high", "handoff.transition", bad_move(F.col("previous"), F.col("state"), "proposed", HANDOFF_MOVES)), ("high", "handoff.owner", ready & empty(F.col("external_owner"))),
            ("high", "handoff.source", ready & not_in(F.col("source_role"), ("pr-readiness", "technical-writer"))), ("high", "handoff.rollback", ready & empty(F.col("rollback_ref")) & empty(F.col("rollback_reason"))),
            ("high", "handoff.artifacts", ready & none("artifacts")), ("high", "handoff.validations", ready & none("validations")),
        ],
    )


def issues(rows: DataFrame, types: list[str], forbidden: list[str], impact: Column, assignment: Column) -> DataFrame:
    """Findings on issues: id, body, labels."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return findings(
        rows, "id",
        [
            ("high", "issue.labels.type", ~F.arrays_overlap(labels, F.array(*map(F.lit, types)))), ("blocker", "issue.labels.forbidden", F.exists(labels, lambda x: reduce(lambda a, p: a | x.startswith(p), forbidden, F.lit(False)))),
            ("medium", "issue.acceptance", ~F.coalesce("body", F.lit("")).rlike(r"(?i)##\s+Acceptance criteria")), ("medium", "issue.release.assignment", (assignment == "needs-assignment") & (impact != "unknown")),
        ],
    )


def manifests(rows: DataFrame) -> DataFrame:
    """Findings on evaluation manifests: id, threshold, cases array<struct<id, kinds array<string>>>."""
    kinds = F.array(*map(F.lit, ("contains", "not-contains", "regex", "json-valid")))
    ids = F.transform("cases", lambda c: c["id"])
    return findings(
        rows, "id",
        [
            ("high", "eval.threshold", ~F.coalesce(F.col("threshold").between(0, 1), F.lit(False))), ("high", "eval.cases", F.coalesce(F.size("cases") < 1, F.lit(True))),
            ("high", "eval.unique", F.size(ids) != F.size(F.array_distinct(ids))), ("high", "eval.kinds", F.exists("cases", lambda c: F.size(F.array_except(c["kinds"], kinds)) > 0)),
        ],
    )


def observations(rows: DataFrame, as_of: str, max_age_ms: int | None = None, origins=("collector-observed", "external-resolved")) -> DataFrame:
    """Findings on observations against what was asked: id, candidate, wanted_candidate, definition, wanted_definition,
    origin, outcome, source_verified, completed_at, assertions array<struct<id, outcome>>, required array<string>."""
    age = (micros(F.lit(as_of)) - micros(F.col("completed_at"))) / 1000
    passed = F.transform(F.filter("assertions", lambda a: a["outcome"] == "pass"), lambda a: a["id"])
    rules = [
        ("high", "observation.required", F.coalesce(F.size("required") < 1, F.lit(True))), ("high", "observation.source", ~F.coalesce("source_verified", F.lit(False))), ("high", "observation.candidate", ~F.col("candidate").eqNullSafe(F.col("wanted_candidate"))),
        ("high", "observation.definition", ~F.col("definition").eqNullSafe(F.col("wanted_definition"))), ("high", "observation.origin", not_in(F.col("origin"), origins)), ("high", "observation.outcome", ~F.col("outcome").eqNullSafe("pass")),
        ("high", "observation.assertions", F.size(F.array_except("required", F.coalesce(passed, F.array().cast("array<string>")))) > 0), ("high", "observation.age", F.coalesce(age < 0, F.lit(True)) | (F.lit(False) if max_age_ms is None else age > max_age_ms)),
    ]
    return findings(rows, "id", rules)


def council(requests: DataFrame, advice: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Findings on councils. requests: request_id, digest, owner, seats array<struct<role, required>>; advice: request_id, digest,
    request_digest, role, objections array<struct<id, blocking>>; synthesis: request_id, request_digest, status, advice_digests
    array<string>, dispositions array<struct<advice_digest, objection_id, disposition, reason>>.

    Every required seat advises once, nobody else does, each blocking objection is disposed of once with a reason, and
    the synthesis names exactly the advice that was given. Joined by request; no council's records are gathered but
    the digests of its advice, one for each seat.
    """
    seats = requests.select("request_id", "owner", F.explode("seats").alias("s")).select("request_id", "owner", "s.role", "s.required")
    given = advice.join(requests.select("request_id", F.col("digest").alias("_d"), "owner"), "request_id", "left")
    missing = seats.where("required").join(advice.select("request_id", "role"), ["request_id", "role"], "left_anti").select(F.col("request_id").alias("key"), F.lit("council.missing").alias("code"))
    uninvited = given.join(seats.where("role <> owner").select("request_id", "role"), ["request_id", "role"], "left_anti").select(F.col("request_id").alias("key"), F.lit("council.uninvited").alias("code"))
    twice = advice.groupBy("request_id", "role").count().where("count > 1").select(F.col("request_id").alias("key"), F.lit("council.twice").alias("code"))
    stale = given.where(~F.col("request_digest").eqNullSafe(F.col("_d"))).select(F.col("request_id").alias("key"), F.lit("council.stale-advice").alias("code"))
    blocking = advice.select("request_id", F.col("digest").alias("advice_digest"), F.explode("objections").alias("o")).where("o.blocking").select("request_id", "advice_digest", F.col("o.id").alias("objection_id"))
    settled = synthesis.select("request_id", F.explode("dispositions").alias("x")).select("request_id", "x.*")
    fine = F.col("disposition").isin("accepted", "rejected-with-reason") & ~empty(F.col("reason"))
    counts = settled.groupBy("request_id", "advice_digest", "objection_id").agg(F.count("*").alias("n"), F.count_if(fine).alias("good"))
    open_ = blocking.join(counts, ["request_id", "advice_digest", "objection_id"], "left").where("n IS NULL OR n <> 1 OR good <> 1").select(F.col("request_id").alias("key"), F.lit("council.objection").alias("code"))
    digests = advice.groupBy("request_id").agg(F.sort_array(F.collect_list("digest")).alias("_a"))
    s = requests.select("request_id", F.col("digest").alias("_d")).join(synthesis, "request_id", "left").join(digests, "request_id", "left")
    none = F.array().cast("array<string>")
    whole = findings(
        s, "request_id",
        [
            ("high", "council.incomplete", ~F.col("status").eqNullSafe("complete")), ("high", "council.stale-synthesis", ~F.col("request_digest").eqNullSafe(F.col("_d"))),
            ("high", "council.digests", ~F.sort_array(F.coalesce("advice_digests", none)).eqNullSafe(F.coalesce("_a", none))),
        ],
    )
    return together(*(x.withColumn("severity", F.lit("high")).select("key", "severity", "code") for x in (missing, uninvited, twice, stale, open_)), whole)


def deliveries(rows: DataFrame) -> DataFrame:
    """delivery_id, checks array<struct<id, pass>>, status of deliveries against handoff and contract, joined in one row: handoff_state,
    handoff_digest, handoff_contract, bound_handoff, contract_digest, bound_contract, delivery_role, producer_role, candidate,
    bound_candidate, delivery_status, criteria array<struct<id, required, verification>>, results array<struct<id, status, evidence>>.

    Status: fail if a check does, semantic-review-required if a required criterion needs judgement, else pass.
    """
    check = lambda name, ok: F.struct(F.lit(name).alias("id"), F.coalesce(ok, F.lit(False)).alias("pass"))
    same = lambda a, b: F.col(a) == F.col(b)
    hit = lambda c: F.exists("results", lambda r: (r["id"] == c["id"]) & (r["status"] == "pass") & (r["evidence"] > 0))
    must = F.filter("criteria", lambda c: c["required"] & (c["verification"] == "deterministic"))
    per = F.transform(must, lambda c: F.struct(F.concat(F.lit("criterion:"), c["id"]).alias("id"), F.coalesce(hit(c), F.lit(False)).alias("pass")))
    fixed = [
        check("handoff-valid", F.col("handoff_state") == "issued"), check("handoff-contract", same("handoff_contract", "contract_digest")), check("delivery-valid", F.col("delivery_status") == "submitted"), check("handoff-binding", same("bound_handoff", "handoff_digest")),
        check("contract-binding", same("bound_contract", "contract_digest")), check("role-binding", same("producer_role", "delivery_role")), check("candidate-binding", same("bound_candidate", "candidate")),
    ]
    checks = F.concat(F.array(*fixed), F.coalesce(per, F.array().cast("array<struct<id:string,pass:boolean>>")))
    judged = F.coalesce(F.exists("criteria", lambda c: c["required"] & (c["verification"] != "deterministic")), F.lit(False))
    rows = rows.select("delivery_id", checks.alias("checks"), judged.alias("_j"))
    return rows.select("delivery_id", "checks", F.when(F.exists("checks", lambda c: ~c["pass"]), "fail").when(F.col("_j"), "semantic-review-required").otherwise("pass").alias("status"))


def acceptance_pairs(envelopes: DataFrame, first: str, second: str) -> DataFrame:
    """subject, ok for pairs of envelopes (subject, platform, from_role, to_role, status) of two platforms: each passes, and
    the first hands over to the role that the second starts from."""
    own = lambda p, n: envelopes.where(F.col("platform") == p).groupBy("subject").agg(F.count("*").alias(f"n{n}"), F.min("from_role").alias(f"from{n}"), F.min("to_role").alias(f"to{n}"), F.min("status").alias(f"s{n}"), F.max("status").alias(f"t{n}"))
    rows = own(first, 1).join(own(second, 2), "subject", "full_outer")
    fine = (F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("to1") == F.col("from2")) & (F.col("s1") == "pass") & (F.col("t1") == "pass") & (F.col("s2") == "pass") & (F.col("t2") == "pass")
    return rows.select("subject", F.coalesce(fine, F.lit(False)).alias("ok"))


def session_records(rows: DataFrame) -> DataFrame:
    """Session records from pull requests (number, title, url, merged_at, body): what their sections and fields say, with
    the defaults of a session that says nothing. Of an issue's mentions the strongest counts: implements, closes, refs."""
    body = F.coalesce("body", F.lit(""))
    review, evidence, ci = section(body, "Agent review"), section(body, "Workflow evidence"), section(body, "CI-equivalent validation")
    or_else = lambda text, name, default: F.coalesce(F.nullif(field(text, name), F.lit("")), F.lit(default))
    said = F.lower(field(review, "Review"))
    roles = F.array_distinct(F.filter(F.transform(table_rows(section(body, "Role attribution matrix")), lambda r: F.get(r, F.lit(0))), lambda x: x != ""))
    tests = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t in (ci, evidence) for p in (r"(?i)(\d+)\s+(?:passing\s+)?tests?\s+pass(?:ed|ing)?", r"(?i)pytest[^\n]*?(\d+)\s+passed")))
    follow = section(body, "Follow-up issues")
    lines = lambda where, verb: F.transform(F.regexp_extract_all(where, F.lit(rf"(?m)^-\s+{verb} #(\d+)"), 1), lambda x: x.cast("long"))
    done, near = section(body, "Implemented issues"), section(body, "Related issues")
    ranked = F.concat(_named(lines(done, "Implements"), "implements"), _named(lines(done, "Closes"), "closes"), _named(lines(near, "Refs"), "refs"))
    first = F.filter(ranked, lambda x, i: ~F.exists(F.slice(ranked, F.lit(1), i), lambda y: y["number"] == x["number"]))
    status = F.lower(field(ci, "Status"))
    result = F.when(status == "passed", "passed").when(status.isin("", "not-run-with-reason"), "not-run-with-reason").otherwise("failed")
    names = F.array_distinct(F.filter(F.transform(F.split(field(ci, "Commands"), ","), lambda x: F.regexp_replace(F.trim(x), "^`|`$", "")), lambda x: x != ""))
    return rows.select(
        F.concat(F.lit("pr-"), F.col("number")).alias("id"), F.lit("pr").alias("kind"), "title", F.coalesce(F.nullif(field(evidence, "Role-pass summary"), F.lit("")), F.col("title")).alias("summary"), F.col("merged_at").alias("mergedAt"),
        F.struct(or_else(review, "Implemented by", "human").alias("platform"), or_else(review, "Executor", "human").alias("executor"), or_else(review, "Transport", "manual").alias("transport")).alias("harness"),
        F.struct(
            or_else(review, "Mode", "single-agent").alias("mode"), or_else(review, "Workflow profile", "standard").alias("workflowProfile"), F.when(F.size(roles) > 0, roles).otherwise(F.array(*map(F.lit, PHASES))).alias("phasesRun"),
            F.when(said == "self-review", "self-review").when(said.isin("human-review-requested", "human-reviewed"), "human").otherwise("independent").alias("review"), (field(review, "Workflow profile") == "high-assurance").alias("humanReviewRequired"),
        ).alias("sdlc"),
        F.struct(F.col("number").alias("prNumber"), F.col("url").alias("prUrl"), first.alias("issues")).alias("repository"),
        F.struct(F.transform(names, lambda n: F.struct(n.alias("name"), result.alias("result"))).alias("validators"), tests.cast("long").alias("testsPassed")).alias("verification"),
        F.when(follow.rlike(r"(?im)^\s*none\s*$"), F.array().cast("array<long>")).otherwise(F.transform(F.regexp_extract_all(follow, F.lit(r"#(\d+)"), 1), lambda x: x.cast("long"))).alias("followUps"),
    )


def _named(numbers: Column, name: str) -> Column:
    return F.transform(numbers, lambda n: F.struct(n.alias("number"), F.lit(name).alias("relation")))


def rollup_record(sessions: DataFrame, key: str, title: str, merged_at: str) -> DataFrame:
    """One row: a roll-up of the sessions that went before it, in the order of merging."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("mergedAt", "id"))), lambda x: x["id"])
    return sessions.agg(order.alias("children")).select(F.lit(key).alias("id"), F.lit("rollup").alias("kind"), F.lit(title).alias("title"), F.lit(merged_at).alias("mergedAt"), "children", F.array(*map(F.lit, PHASES)).alias("phasesRun"))


def merged_maps(base: Column, patch: Column) -> Column:
    """Two map<string, array<string>>: keys of either, arrays as ordered unions."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(base, patch, lambda _, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def deep_merge(base, patch):
    """Configuration trees on the driver: maps merge key by key, lists become ordered unions, other values are replaced."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return {k: deep_merge(base[k], patch[k]) if k in base and k in patch else patch.get(k, base.get(k)) for k in [*base, *(k for k in patch if k not in base)]}
    if isinstance(base, list) and isinstance(patch, list):
        return [*base, *(x for x in patch if x not in base)]
    return patch
