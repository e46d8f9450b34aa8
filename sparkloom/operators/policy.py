"""Collaboration plans, delivery policies, branch strategies, decisions on community issues, configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .governance import empty, findings

#: Scouts of a council and of a discovery, limits, and the roles, permissions and requirements by mode.
COUNCIL_SCOUTS = ("risk-scout", "implementation-strategist", "testability-scout", "docs-impact-scout")
DISCOVERY_SCOUTS = ("requirements-scout", "architecture-scout")
MAX_DEPTH, MAX_ITERATIONS = 1, 3
MODE_ROLES = {"single-agent": (), "advisory": ("risk-scout",), "council": COUNCIL_SCOUTS, "parallel-discovery": DISCOVERY_SCOUTS, "spike": ("spike-implementer",), "human-gated": ("human-reviewer",)}
MODE_REQUIRES = {
    "single-agent": ("workflow-orchestration",), "advisory": ("workflow-orchestration", "delegated-work"), "council": ("workflow-orchestration", "delegated-work"), "parallel-discovery": ("workflow-orchestration", "delegated-work", "parallel-fanout"),
    "spike": ("workflow-orchestration", "delegated-work", "isolated-workspace"), "human-gated": ("workflow-orchestration",),
}
#: Settings of a delivery policy that can't be changed, and origins that count as deterministic.
FIXED_POLICY = {"contractVersion": "2", "sourceAcknowledgmentRequired": "true", "highAssuranceHumanReviewPhase": "6", "unknownWriterBlocksRecovery": "true", "admissionBudgetRejectsUnknownUsage": "true"}
ORIGINS = ("collector-observed", "external-resolved")
#: Labels that say what came of an issue, and kinds of flags.
OUTCOMES = ("staged", "resolved", "queued")
FLAGS = ("Dead link", "Miscategorized", "Duplicate")
#: What a repository's URL looks like.
REPOSITORY = r"^https://github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"


def _list(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _by_mode(mode: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, values in table.items():
        out = F.when(mode == name, _list(*values)).otherwise(out)
    return out


def collaboration_plans(requests: DataFrame, max_delegates: int | None = None, max_depth: int = MAX_DEPTH, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """requests (mode, profile, transport, delegated status, binding and others) with plan struct.

    binding: status of the provider that was bound (bound, degraded, manual, blocked); transport: how it is reached;
    delegated: whether it does delegated work in full. The plan: roles and their permissions, requirements, controls, limits,
    whether another mode may stand in, environment, strategy, writer, human gate, synthesis, and errors. A mode that isn't known has no
    roles and an error; nulls count as unknown.
    """
    mode, roles = F.col("mode"), _by_mode(F.col("mode"), MODE_ROLES)
    permission = F.when(mode == "spike", "writer").when(mode == "human-gated", "human-gate").otherwise("read-only")
    helpers = F.transform(F.coalesce(roles, _list()), lambda r: F.struct(r.alias("role"), permission.alias("permissions"), F.when(mode == "parallel-discovery", 40).alias("max_files")))
    delegates = F.when(mode == "council", F.size(roles)).when(mode == "parallel-discovery", 2).otherwise(1) if max_delegates is None else F.lit(max_delegates)
    controls = F.concat(_list("single-writer", "authority-may-only-narrow"), F.when(F.col("profile") == "high-assurance", _list("review-independence", "human-approval")).otherwise(_list()))
    gated = F.coalesce(mode == "human-gated", F.lit(False))
    environment = F.when(mode == "spike", "worktree").when(gated | (F.col("transport") == "manual"), "human-handoff").when(F.coalesce(F.col("delegated") == "full", F.lit(False)), "forked-context").otherwise("current-session")
    errors = F.filter(F.array(F.when(roles.isNull(), "mode"), F.when(F.col("binding") == "blocked", "binding")), lambda x: x.isNotNull())
    plan = F.struct(
        F.coalesce(roles, _list()).alias("roles"), helpers.alias("helpers"), F.coalesce(_by_mode(mode, MODE_REQUIRES), _list()).alias("requires"), controls.alias("controls"),
        F.struct(delegates.alias("delegates"), F.lit(max_depth).alias("depth"), F.lit(max_iterations).alias("iterations")).alias("limits"), (~mode.isin("human-gated", "spike")).alias("fallback"),
        F.when(mode == "single-agent", _list("manual")).otherwise(_list("sequential", "manual")).alias("fallback_modes"), environment.alias("environment"), F.when(F.col("binding") == "degraded", "fallback").otherwise("provider-native-or-adapter").alias("strategy"),
        F.when(mode == "spike", "isolated-worktree-helper").otherwise("parent").alias("writer"), gated.alias("human_gate"), (F.size(helpers) > 0).alias("synthesis"), errors.alias("errors"),
    )
    return requests.withColumn("plan", plan)


def policy_findings(rows: DataFrame) -> DataFrame:
    """Findings on delivery policies: id, settings map<string, string>, origins array<string>, maxima map<string, double>, budget
    struct<unit, level, limit>. Fixed settings can't be changed, and the budget must enforce each maximum that there is."""
    given = lambda k: F.try_element_at("settings", F.lit(k))
    fixed = [("blocker", f"policy.{k}", given(k).isNotNull() & (given(k) != v)) for k, v in FIXED_POLICY.items()]
    b = F.col("budget")
    enforced = lambda unit, most: F.coalesce((b["unit"] == unit) & (b["level"] != "advisory") & ~F.isnan(b["limit"]) & (b["limit"] <= most), F.lit(False))
    units = F.map_entries("maxima")
    return findings(
        rows, "id",
        [
            *fixed, ("high", "policy.origins", F.col("origins").isNotNull() & ((F.size("origins") < 1) | (F.size(F.array_except("origins", _list(*ORIGINS))) > 0))),
            ("high", "policy.journeys", given("requiredJourneyCoverage").isNotNull() & ~given("requiredJourneyCoverage").isin("true", "false")),
            ("high", "policy.maximum", F.exists(units, lambda u: (u["key"] == "") | ~F.coalesce(u["value"] >= 0, F.lit(False)))), ("high", "policy.budget", F.exists(units, lambda u: ~enforced(u["key"], u["value"]))),
        ],
    )


def branching_findings(rows: DataFrame) -> DataFrame:
    """Findings on branch strategies: id, trunk, release_candidate (may be null), integration, target, promotion, denied, prefixes
    (array<string>), bounded boolean."""
    tiers = F.filter(F.array("trunk", "release_candidate", "integration"), lambda x: x.isNotNull())
    odd = lambda c: F.coalesce(F.exists(c, empty) | (F.size(F.array_distinct(c)) != F.size(c)), F.lit(True))
    outside = lambda c: F.size(F.array_except(tiers, c)) > 0
    return findings(
        rows, "id",
        [
            ("high", "branching.trunk", empty(F.col("trunk"))), ("high", "branching.integration", empty(F.col("integration"))), ("high", "branching.target", empty(F.col("target"))), ("high", "branching.candidate", F.trim("release_candidate") == ""),
            *(("high", f"branching.{c}.entries", odd(c)) for c in ("promotion", "denied", "prefixes")), ("high", "branching.distinct", F.size(F.array_distinct(tiers)) != F.size(tiers)),
            ("high", "branching.target.promotion", ~F.array_contains("promotion", F.col("target"))), ("high", "branching.promotion.tiers", outside("promotion")), ("high", "branching.denied.tiers", outside("denied")),
            ("high", "branching.prefixes", F.col("bounded") & (F.size("prefixes") < 1)),
        ],
    )


def processed(labels: Column, outcomes=OUTCOMES) -> Column:
    """Whether an issue has a label of an outcome already."""
    return F.coalesce(F.arrays_overlap(labels, _list(*outcomes)), F.lit(False))


def _said(outcome: str, basis: str, reason: str | None = None) -> Column:
    """A decision; a reason to close is given where it closes the issue."""
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(basis).alias("basis"), F.lit(reason is not None).alias("closed"), F.lit(reason).alias("close_reason"))


def proposal_decision(url: Column, repository: Column, state: Column) -> Column:
    """Of a proposed list: struct<outcome, basis, closed, close_reason>. repository: what the API answered (found, missing,
    limited); state: the classifier's, null where the metadata or the README can't be had."""
    return (
        F.when(~F.coalesce(F.trim(url).rlike(REPOSITORY), F.lit(False)), _said("resolved", "url", "not planned")).when(repository == "limited", _said("queued", "unavailable"))
        .when(F.coalesce(repository != "found", F.lit(True)), _said("resolved", "missing", "not planned")).when(state == "eligible", _said("staged", "eligible", "completed"))
        .when(state == "excluded", _said("resolved", "excluded", "not planned")).otherwise(_said("queued", "pending"))
    )


def flag_decision(flag: Column, url: Column, status: Column, published: Column, topics: Column, computed: Column, fork: Column, parent_state: Column) -> Column:
    """Of a flagged entry, as of proposal_decision. status: of an HTTP request, null where none came through; published: whether the
    catalogue has the list, with its topics and those computed now; fork and the state of the list that it was forked from."""
    dead = F.when(status.isin(404, 410), _said("resolved", "dead", "completed")).when(status.between(200, 399), _said("resolved", "alive", "not planned")).otherwise(_said("queued", "status"))
    none = _list()
    same = F.sort_array(F.coalesce(topics, none)) == F.sort_array(F.coalesce(computed, none))
    moved = F.when(~F.coalesce(published, F.lit(False)), _said("queued", "unpublished")).when(same, _said("resolved", "same topics", "not planned")).otherwise(_said("resolved", "other topics", "completed"))
    twice = F.when(~url.rlike(REPOSITORY), _said("resolved", "url", "not planned")).when(F.coalesce(fork, F.lit(False)) & (parent_state == "eligible"), _said("resolved", "fork", "completed")).otherwise(_said("queued", "fork"))
    return (
        F.when(~F.coalesce(flag.isin(*FLAGS), F.lit(False)), _said("queued", "flag")).when(empty(url), _said("resolved", "no url", "not planned"))
        .when(flag == "Dead link", dead).when(flag == "Miscategorized", moved).otherwise(twice)
    )


def intake_summary(decided: DataFrame) -> DataFrame:
    """One row: how many issues were decided, how many closed, and the count of each outcome, 0 for those without any."""
    d = F.col("decision")
    return decided.agg(F.count("*").alias("issues"), F.count_if(d["closed"]).alias("closed"), *(F.count_if(d["outcome"] == o).alias(o) for o in OUTCOMES))


def step_summary(steps: DataFrame) -> DataFrame:
    """Steps of pipeline runs (run_id, step, place, status, seconds) by run: how many, how many failed, the first that failed, and the
    time that all took."""
    bad = F.col("status") != "ok"
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(bad).alias("failed"), F.min_by("step", F.when(bad, F.col("place"))).alias("first_failed"), F.sum("seconds").alias("seconds"))


def config_rows(spark: SparkSession, path: str, field: str, row: str) -> DataFrame:
    """Rows of a table in JSON configuration files, such as roles, methods or platforms, with the file's name and whether the
    slug occurs more than once in that file."""
    read = spark.read.schema(f"`{field}` array<struct<{row}>>").option("multiLine", True).json(path)
    rows = read.select(F.col("_metadata.file_name").alias("file"), F.inline(field))
    twice = rows.groupBy("file", "slug").agg((F.count("*") > 1).alias("repeated"))
    return rows.join(twice, ["file", "slug"])
