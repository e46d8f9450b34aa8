"""Process events: outcome metrics, attempts and retries, usage counters, coverage, sessions, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import micros, seconds_between

#: Types of outcome events.
EVENT_TYPES = (
    "work-started", "validation-completed", "review-requested", "review-completed", "pr-ready",
    "released", "follow-up-opened", "follow-up-closed", "incident-opened", "regression-eval-added",
)
KINDS = ("pr", "rollup", "release")


def valid_outcome_events(events: DataFrame) -> DataFrame:
    """Events (id, subject, type, timestamp string, outcome) with a known type, a subject and a date; of those that share
    an id the first by timestamp. A bad event doesn't use up its id."""
    fine = events.where(F.col("id").isNotNull() & (F.col("id") != "") & (F.trim("subject") != "") & F.col("type").isin(*EVENT_TYPES) & micros(F.col("timestamp")).isNotNull())
    names = [c for c in events.columns if c != "id"]
    return fine.groupBy("id").agg(F.min(F.struct("timestamp", *[c for c in names if c != "timestamp"])).alias("e")).select("id", *(f"e.{c}" for c in names))


def outcome_metrics(events: DataFrame, as_of: Column | str) -> DataFrame:
    """One row a subject: five durations in seconds and first_pass_validation, from its first event of each type.

    Missing ends and negative durations are null, but an open follow-up is as old as as_of says. A validation counts
    by its first outcome; null without one. events: as of valid_outcome_events.
    """
    as_of = F.lit(as_of) if isinstance(as_of, str) else as_of
    at = lambda t: F.min(F.when(F.col("type") == t, F.col("timestamp")))
    first = events.groupBy("subject").agg(*(at(t).alias(t) for t in EVENT_TYPES), F.min_by("outcome", F.when(F.col("type") == "validation-completed", F.struct("timestamp", "id"))).alias("_o"))
    span = lambda a, z: seconds_between(F.col(a), z if isinstance(z, Column) else F.col(z))
    passed = F.when(F.col("validation-completed").isNotNull(), F.coalesce(F.col("_o") == "pass", F.lit(False)))
    return first.select(
        "subject", span("work-started", "pr-ready").alias("cycle_seconds"), span("review-requested", "review-completed").alias("review_seconds"), span("pr-ready", "released").alias("release_seconds"),
        span("follow-up-opened", F.coalesce("follow-up-closed", as_of)).alias("follow_up_seconds"), span("incident-opened", "regression-eval-added").alias("incident_seconds"), passed.alias("first_pass_validation"),
    )


def first_pass_rate(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("subjects"), F.avg(F.col("first_pass_validation").cast("int")).alias("first_pass_rate"))


def attempts(events: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Observations with their phase and whether they are retries.

    events: run, kind, to (phase that an event moves to), criterion, outcome, errors array<string>, timestamp. A run's
    events stand in `order`; the phase is the last one moved to, 0 before that. Earlier observations of a criterion in
    a phase make a retry, whose causes are the errors of the one before, or `unclassified`.
    """
    w = W.partitionBy(run).orderBy(*order)
    moved = F.when(F.col("kind").isin("advanced", "returned"), F.col("to"))
    phased = events.withColumn("phase", F.coalesce(F.last(moved, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)))
    own = phased.where("kind = 'observation'")
    v = W.partitionBy(run, "phase", "criterion").orderBy(*order)
    none = F.array(F.lit("unclassified"))
    before = F.lag(F.when(F.size(F.coalesce("errors", F.array())) > 0, F.array_distinct("errors")).otherwise(none)).over(v)
    return own.withColumn("causes", before).withColumn("retry", F.col("causes").isNotNull())


def retry_causes(found: DataFrame, run: str = "run_id") -> DataFrame:
    return found.where("retry").select(run, F.explode("causes").alias("cause")).groupBy(run, "cause").agg(F.count("*").alias("n"))


def run_metrics(events: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A row a run: attempts, observed, passed, first evidence, acceptance and phase durations in seconds, promotions,
    returned findings, unknown operations. events as in attempts, with origin, findings (long), state, operation_kind."""
    place = F.struct(*order)
    seen = (F.col("kind") == "observation") & F.col("origin").isin("collector-observed", "external-resolved")
    passing = seen & (F.col("outcome") == "pass")
    at = lambda c: F.min_by("timestamp", F.when(c, place))
    rows = events.groupBy(run).agg(
        F.count_if(F.col("kind") == "observation").alias("attempts"), F.count_if(seen).alias("observed"), F.count_if(passing).alias("passed"),
        F.min_by("timestamp", place).alias("_first"), at(passing).alias("_evidence"), at(F.col("kind").isin("advanced", "completed")).alias("_accepted"),
        at((F.col("kind") == "advanced") & (F.col("to") == 4)).alias("_active"), at(F.col("kind") == "completed").alias("_done"),
        F.count_if(F.col("kind") == "advanced").alias("promotions"), F.coalesce(F.sum(F.when(F.col("kind") == "returned", F.col("findings"))), F.lit(0)).alias("returned_findings"),
        F.count_if((F.col("kind") == "operation") & (F.col("state") == "unknown")).alias("unknown_operations"),
        F.count_if((F.col("kind") == "operation") & (F.col("operation_kind") == "issue-projection") & F.col("state").isin("unknown", "failed")).alias("projection_failures"),
    )
    span = lambda a, z, n: seconds_between(F.col(a), F.col(z)).alias(n)
    return rows.select(run, "attempts", "observed", "passed", span("_first", "_evidence", "evidence_seconds"), span("_first", "_accepted", "acceptance_seconds"), span("_first", "_active", "setup_seconds"), span("_active", "_done", "active_seconds"), "promotions", "returned_findings", "unknown_operations", "projection_failures")


def recoveries(events: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """For each resumed event the seconds since the last pause or block before it; null without one."""
    w = W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    stop = F.last(F.when(F.col("kind").isin("paused", "blocked"), F.col("timestamp")), ignorenulls=True).over(w)
    return events.withColumn("_stop", stop).where("kind = 'resumed'").withColumn("seconds", seconds_between(F.col("_stop"), F.col("timestamp"))).drop("_stop")


def usage_deltas(rows: DataFrame, scope: tuple[str, ...] = ("provider", "epoch", "unit"), value: str = "value", mode: str = "mode", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Counters with delta and reset: a cumulative value less the last value of its scope, of either mode, or a delta as
    it is. A cumulative value that falls within an epoch is a reset: an error of the source, flagged, and without a delta."""
    before = F.coalesce(F.lag(value).over(W.partitionBy(*scope).orderBy(*order)), F.lit(0))
    cumulative = F.col(mode) == "cumulative"
    reset = cumulative & (F.col(value) < before)
    return rows.withColumn("reset", reset).withColumn("delta", F.when(~reset, F.when(cumulative, F.col(value) - before).otherwise(F.col(value))))


def usage_totals(deltas: DataFrame, by: tuple[str, ...] = ("provider", "unit")) -> DataFrame:
    return deltas.groupBy(*by).agg(F.sum("delta").alias("total"), F.count_if("reset").alias("resets"))


def budget_admission(rows: DataFrame) -> DataFrame:
    """rows (level, limit, used, estimated_next, can_stop) with known, exceeded, enforceable, admitted, reason."""
    known = F.coalesce((F.col("used") >= 0) & (F.col("estimated_next") >= 0), F.lit(False))
    exceeded = F.when(known, F.col("used") + F.col("estimated_next") > F.col("limit"))
    enforceable = (F.col("level") != "provider-enforced") | F.coalesce("can_stop", F.lit(False))
    admitted = (F.col("level") == "advisory") | (known & ~F.coalesce(exceeded, F.lit(True)) & enforceable)
    reason = F.when(~known, "Usage or next-attempt bound unknown").when(~enforceable, "Provider cannot enforce cancellation").when(exceeded, "Budget exhausted").otherwise("Within budget")
    return rows.select("*", known.alias("known"), exceeded.alias("exceeded"), enforceable.alias("enforceable"), admitted.alias("admitted"), reason.alias("reason"))


def journey_coverage(journeys: DataFrame, passing: DataFrame) -> DataFrame:
    """id, required, criteria, missing (counts), verified for journeys (id, required, criteria array<string>): a journey is
    verified if every criterion that it names has a passing observation. passing: criterion. Criteria meet observations by an equi-join."""
    named = journeys.select("id", F.coalesce("required", F.lit(True)).alias("required"), F.explode_outer("criteria").alias("criterion"))
    had = passing.select("criterion").distinct().withColumn("_had", F.lit(True))
    rows = named.join(had, "criterion", "left").groupBy("id").agg(F.bool_and("required").alias("required"), F.count("criterion").alias("criteria"), F.count_if(F.col("_had").isNull()).alias("missing"))
    return rows.withColumn("verified", F.col("missing") == 0)


def lifecycle(required: DataFrame, observations: DataFrame) -> DataFrame:
    """kind, target, channel, valid, status of required evidence: pass if one observation is verified, passed, of the
    channel, exercised if asked, fresh enough, and none of the same target is unresolved."""
    r, o = required.alias("r"), observations.alias("o")
    rows = r.join(o, (F.col("r.kind") == F.col("o.kind")) & (F.col("r.target") == F.col("o.target")), "left")
    fine = (
        F.col("o.verified") & (F.col("o.outcome") == "pass") & (F.col("o.age_ms") >= 0)
        & ((F.col("r.channel") == "any") | (F.col("o.prerelease") == (F.col("r.channel") == "prerelease")))
        & (~F.coalesce("r.exercised", F.lit(False)) | F.coalesce("o.exercised", F.lit(False)))
        & (F.col("r.max_age_ms").isNull() | (F.col("o.age_ms") <= F.col("r.max_age_ms")))
    )
    out = rows.groupBy("r.kind", "r.target", "r.channel").agg(F.count_if(F.coalesce(fine, F.lit(False))).alias("valid"), F.coalesce(F.bool_or("o.unresolved"), F.lit(False)).alias("_open"))
    return out.select("kind", "target", "channel", "valid", F.when((F.col("valid") > 0) & ~F.col("_open"), "pass").otherwise("blocked").alias("status"))


def platform_rates(sessions: DataFrame, platform: str = "platform", high: str = "high_assurance", findings: str = "findings") -> DataFrame:
    """sessions, high_assurance_rate, findings_rate per platform."""
    return sessions.groupBy(platform).agg(F.count("*").alias("sessions"), F.round(F.avg(F.col(high).cast("int")), 4).alias("high_assurance_rate"), F.round(F.sum(findings) / F.count("*"), 4).alias("findings_rate")).orderBy(platform)


def common_values(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """Values by frequency, of equals the first seen first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("_s")).orderBy(F.desc("n"), "_s").drop("_s")


def kind_counts(sessions: DataFrame) -> DataFrame:
    """One row: the number of sessions, and of each kind, 0 for kinds without any."""
    return sessions.agg(F.count("*").alias("sessions"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def timeline(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "id", "kind", "title", "summary", "mergedAt", "wave", F.col("harness.platform").alias("platform"), F.col("sdlc.workflowProfile").alias("workflowProfile"), F.col("sdlc.mode").alias("mode"),
        F.coalesce("sdlc.humanReviewRequired", F.lit(False)).alias("humanReviewRequired"), F.col("repository.prNumber").alias("prNumber"), F.col("repository.prUrl").alias("prUrl"),
        F.coalesce("repository.issues", F.array()).alias("issues"), F.coalesce("children", F.array()).alias("children"),
    ).orderBy("mergedAt", "id")


def tests_over_time(sessions: DataFrame) -> DataFrame:
    """Sessions that counted their tests, in the order of merging; unknown counts are left out, not zero."""
    own = sessions.where(F.col("verification.testsPassed").isNotNull()).orderBy("mergedAt", "id")
    return own.select(F.substring("mergedAt", 1, 10).alias("date"), "id", "title", F.col("verification.testsPassed").alias("testsPassed"))


def unpivot_rates(rates: DataFrame) -> DataFrame:
    return rates.unpivot(["platform"], ["high_assurance_rate", "findings_rate"], "metric", "rate")


def assertions(cases: DataFrame) -> DataFrame:
    """cases (case_id, text, kind, value) with passed: contains, not-contains, regex, json-valid; null texts fail."""
    passed = (
        F.when(F.col("kind") == "contains", F.contains("text", F.col("value")))
        .when(F.col("kind") == "not-contains", ~F.contains("text", F.col("value")))
        .when(F.col("kind") == "regex", F.expr("text rlike value"))
        .when(F.col("kind") == "json-valid", F.try_parse_json("text").isNotNull())
    )
    return cases.withColumn("passed", F.coalesce(passed, F.lit(False)))


def eval_score(cases: DataFrame, threshold: float) -> DataFrame:
    """One row: a case passes if all its assertions do; the score is the share of such cases."""
    by_case = cases.groupBy("case_id").agg(F.bool_and("passed").alias("ok"))
    return by_case.agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("int")).alias("score")).withColumn("ok", F.col("score") >= threshold)


def duplicate_authority(refs: DataFrame, by: tuple[str, ...] = ("kind", "scope")) -> DataFrame:
    """(kind, scope) pairs of which more than one reference claims to be authoritative."""
    scope = [F.coalesce(c, F.lit("default")).alias(c) if c == "scope" else F.col(c) for c in by]
    return refs.where("authoritative").groupBy(*scope).agg(F.count("*").alias("n")).where("n > 1")


def text_findings(rows: DataFrame, key: str, text: str, longest: int = 2000) -> DataFrame:
    """key, severity, code of texts that may hold secrets or raw transcripts."""
    secret = F.col(text).rlike(r"(?i)BEGIN (RSA|OPENSSH|PRIVATE) KEY|api[_-]?key\s*=|secret\s*=|token\s*=")
    raw = F.col(text).rlike(r"(?i)(^|\n)(User|Assistant|Tool|System):") & (F.length(text) > longest)
    found = F.array(F.when(secret, F.struct(F.lit("blocker").alias("severity"), F.lit("evidence.secrets").alias("code"))), F.when(raw, F.struct(F.lit("high").alias("severity"), F.lit("evidence.raw-log").alias("code"))))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(key, "f.severity", "f.code")


def latest_evidence(criteria: DataFrame, observed: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """criteria (run_id, criterion, definition, candidate) with outcome and digest of the last observation of that definition
    and candidate; missing without one."""
    keys = ["run_id", "criterion", "definition", "candidate"]
    last = observed.groupBy(*keys).agg(F.max_by(F.struct("outcome", "digest"), F.struct(*order)).alias("_l"))
    return criteria.join(last, keys, "left").select(*criteria.columns, F.coalesce("_l.outcome", F.lit("missing")).alias("outcome"), F.col("_l.digest").alias("digest"))


def latency_stats(calls: DataFrame, latency: str, failed: str) -> DataFrame:
    """One row: calls, mean, median, least and largest latency of those that succeeded, and the rate of failures."""
    ok = F.when(~F.col(failed), F.col(latency))
    return calls.agg(F.count("*").alias("calls"), F.avg(ok).alias("mean"), F.median(ok).alias("median"), F.min(ok).alias("least"), F.max(ok).alias("largest"), F.round(F.avg(F.col(failed).cast("int")), 4).alias("failure_rate"))


def tally(rows: DataFrame, value: str, expected: tuple[str, ...]) -> DataFrame:
    """One row with a count for each expected value, 0 for those that don't occur."""
    return rows.agg(*(F.count_if(F.col(value) == x).alias(x) for x in expected))


def seal(rows: DataFrame, kind: str) -> DataFrame:
    """rows with type, version and digest: SHA-256 of the record's canonical JSON without nulls and without the digest."""
    from ..functions.digests import record_digest

    names = [c for c in rows.columns if c not in ("type", "version", "digest")]
    sealed = rows.select(*names, F.lit(kind).alias("type"), F.lit(1).alias("version"))
    return sealed.withColumn("digest", record_digest(F.to_json(F.struct(*sealed.columns))))


def broken_seals(rows: DataFrame) -> DataFrame:
    """Sealed records whose digest isn't that of their content, or no digest at all."""
    from ..functions.digests import record_digest

    names = [c for c in rows.columns if c != "digest"]
    return rows.withColumn("_now", record_digest(F.to_json(F.struct(*names)))).where(~F.col("digest").eqNullSafe(F.col("_now"))).drop("_now")


def conforms(rows: DataFrame, json: str, schema: str, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with parsed (null where the JSON text doesn't fit the schema, or a field has a value outside its list)."""
    parsed = F.from_json(json, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = F.try_parse_json(json).isNotNull() & parsed["_bad"].isNull()
    for name, allowed in (enums or {}).items():
        ok = ok & F.coalesce(parsed[name].isin(*allowed), F.lit(False))
    return rows.withColumn("parsed", F.when(ok, parsed.dropFields("_bad")))
