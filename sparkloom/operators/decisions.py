"""Decision tables: ordered rules over flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of change that need a person, limits on the number of domains, names of branches.
SENSITIVE = ("security", "auth", "data", "infra", "billing")
COUNCIL_DOMAINS, BILATERAL_DOMAINS = 3, 2
SLUG = r"[a-z][a-z0-9-]*"
PROTECTED = ("main", "staging", "development")
WORK_PREFIXES = ("work/", "feature/", "fix/", "hotfix/", "spike/")
COMPATIBLE_PREFIXES = ("issue/", "wt/", "claude/")


def _touches(surfaces: Column, sensitive) -> Column:
    return F.coalesce(F.arrays_overlap(surfaces, F.array(*map(F.lit, sensitive))), F.lit(False))


def collaboration_mode(requested: Column, profile: Column, risk: Column, effort: Column, uncertainty: Column, surfaces: Column, broad: Column | None = None, spike: Column | None = None, sensitive=SENSITIVE) -> Column:
    no = F.lit(False)
    return (
        F.when((profile == "high-assurance") | _touches(surfaces, sensitive), "human-gated")
        .when(requested != "auto-minimal", requested)
        .when(no if spike is None else spike, "spike")
        .when((no if broad is None else broad) | (effort == "high"), "parallel-discovery")
        .when((uncertainty == "high") | (risk == "high"), "council")
        .when((profile == "standard") | (risk == "medium") | (uncertainty == "medium"), "advisory")
        .otherwise("single-agent")
    )


def collaboration_class(profile: Column, risk: Column, uncertainty: Column, surfaces: Column, domains: Column, public_contract: Column, migration: Column, reversible: Column, evidence: Column, sensitive=SENSITIVE) -> Column:
    """struct<class, triggers>: the first of three tiers with a trigger, with all its triggers; else linear."""
    tier = lambda *x: F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in x)), lambda t: t.isNotNull())
    gated = tier((profile == "high-assurance", "high-assurance-profile"), (_touches(surfaces, sensitive), "sensitive-surface"), (~reversible, "irreversible-change"))
    council = tier((public_contract, "public-contract"), (migration, "migration"), (domains >= COUNCIL_DOMAINS, "cross-domain"), (risk == "high", "high-risk"), (uncertainty == "high", "high-uncertainty"))
    both = tier((risk == "medium", "medium-risk"), (uncertainty == "medium", "medium-uncertainty"), (~evidence, "incomplete-evidence"), (domains >= BILATERAL_DOMAINS, "multi-domain"))
    said = lambda c, t: F.struct(F.lit(c).alias("class"), t.alias("triggers"))
    return F.when(F.size(gated) > 0, said("human-gated", gated)).when(F.size(council) > 0, said("council", council)).when(F.size(both) > 0, said("bilateral", both)).otherwise(said("linear", F.array(F.lit("bounded-change"))))


#: Role, focus and whether it is required, of the seats that every council has.
SEATS = (
    ("architect", "architecture and system boundaries", True), ("developer", "implementation feasibility", True),
    ("tester", "testability and failure evidence", True), ("reviewer", "risk and maintainability", True),
)


def council_seats(requests: DataFrame, seats=SEATS) -> DataFrame:
    """(request_id, role, focus, required): the policy's seats without the owner's, and two that contracts and documents
    call for; a later seat of a role replaces an earlier one. requests: request_id, owner, surfaces, public_contract."""
    seat = lambda i, role, focus, need: F.struct(F.lit(i).alias("i"), F.lit(role).alias("role"), F.lit(focus).alias("focus"), F.lit(need).alias("required"))
    found = [seat(i, *s) for i, s in enumerate(seats)]
    found.append(F.when(F.col("public_contract"), seat(len(seats), "analyst", "requirements and contract semantics", True)))
    found.append(F.when(F.array_contains("surfaces", "docs"), seat(len(seats) + 1, "technical-writer", "documentation and onboarding impact", False)))
    rows = requests.select("request_id", "owner", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("s")).where("s.role <> owner")
    return rows.groupBy("request_id", "s.role").agg(F.max("s").alias("s")).select("request_id", "role", "s.focus", "s.required")


def first_available(candidates: DataFrame, agents: DataFrame) -> DataFrame:
    """(role, agent, status, tried): of each role's candidates (role, place, agent) the first that is enabled and available."""
    rows = candidates.join(agents.select("agent", F.coalesce(F.col("enabled") & F.col("available"), F.lit(False)).alias("_ok")), "agent", "left")
    picked = rows.groupBy("role").agg(F.min_by("agent", F.when(F.col("_ok"), F.col("place"))).alias("agent"), F.min(F.when(F.col("_ok"), F.col("place"))).alias("_at"), F.count("*").alias("_n"))
    return picked.select("role", "agent", F.when(F.col("agent").isNull(), "blocked").otherwise("routed").alias("status"), F.coalesce(F.col("_at") + 1, F.col("_n")).alias("tried"))


def bind_provider(intents: DataFrame, providers: DataFrame) -> DataFrame:
    """(intent_id, provider, status): bound if a provider has every required facet, else degraded if the first one lacks
    only optional ones, else manual if allowed, else blocked. intents: intent_id, kind, required, optional, manual;
    providers: provider, kind, facets, place. They meet by kind: each different request each different set of facets, for
    which its first provider stands, so the cost doesn't grow with the number of intents times that of providers."""
    as_set = lambda c: F.sort_array(F.array_distinct(c))
    none = F.array().cast("array<string>")
    asked = intents.select("intent_id", "kind", as_set("required").alias("required"), as_set(F.coalesce("optional", none)).alias("optional"), "manual")
    given = providers.where("provider IS NOT NULL").groupBy("kind", as_set(F.coalesce("facets", none)).alias("facets")).agg(F.min(F.struct("place", "provider")).alias("p"))
    lacks = F.array_except("required", "facets")
    rank = F.when(F.size(lacks) == 0, 0).when(F.size(F.array_except(lacks, "optional")) == 0, 1)
    request = ["kind", "required", "optional"]
    fits = asked.where("required IS NOT NULL").select(*request).distinct().join(given, "kind").withColumn("r", rank).where("r IS NOT NULL")
    found = fits.groupBy(*request).agg(F.min(F.struct("r", "p.place", "p.provider")).alias("b"))
    best = asked.join(found, request, "left").groupBy("intent_id").agg(F.min("b").alias("b"), F.bool_or("manual").alias("_m"))
    status = F.when(F.col("b.r") == 0, "bound").when(F.col("b.r") == 1, "degraded").when(F.col("_m"), "manual").otherwise("blocked")
    return best.select("intent_id", "b.provider", status.alias("status"))


def branch_class(branch: Column, protected=PROTECTED, prefixes=WORK_PREFIXES, slug: str = SLUG, compatible=COMPATIBLE_PREFIXES) -> Column:
    out = F.when(F.coalesce(branch, F.lit("")) == "", "detached").when(branch.isin(*protected), "protected")
    for p in prefixes:
        out = out.when(branch.startswith(p), F.when(F.substr(branch, F.lit(len(p) + 1)).rlike(f"^{slug}$"), "work").otherwise("invalid"))
    out = out.when(branch.rlike(r"^issue/[0-9]+-[a-z][a-z0-9-]+$"), "compatibility")
    for p in compatible:
        if p != "issue/":
            out = out.when(branch.startswith(p), "compatibility")
    return out.otherwise("invalid")


def release_impact(body: Column, labels: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    has = lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))
    return (
        F.when(body.rlike("(?i)no release impact|internal-only"), "none").when(body.rlike("(?i)docs-only|documentation") | has("documentation"), "docs-only")
        .when(body.rlike("(?i)breaking|major"), "major").when(body.rlike("(?i)feature|minor") | has("feature"), "minor")
        .when(body.rlike("(?i)bug|fix|patch") | has("bug"), "patch").otherwise("unknown")
    )


def release_candidate(body: Column, milestone: Column) -> Column:
    named = F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)(?:target release|release|version)\s*:?\s*(v\d+\.\d+\.\d+(?:[-+][\w.-]+)?)", 1), F.lit(""))
    return F.coalesce(named, F.when(milestone.rlike(r"(?i)^v\d+\.\d+\.\d+(?:[-+][\w.-]+)?$"), milestone))


def release_assignment(body: Column, labels: Column, state: Column, milestone: Column) -> Column:
    waits = F.coalesce(F.array_contains(labels, "awaiting-release"), F.lit(False))
    return F.when(release_impact(body, labels) == "none", "no-release-impact").when((state == "closed") & ~waits, "released").when(release_candidate(body, milestone).isNotNull(), "assigned").otherwise("needs-assignment")


def issue_path(body: Column, labels: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    named = F.lower(F.nullif(F.regexp_extract(body, r"(?i)(?:profile|workflow classification)\s*:?\s*(bounded|standard|high-assurance|exploratory)", 1), F.lit("")))
    risky = body.rlike("(?i)security|auth|remote|migration|data loss|production|high-assurance") | F.coalesce(F.exists(labels, lambda x: x.rlike("(?i)security|high-risk")), F.lit(False))
    open_ = body.rlike("(?i)exploratory|spike|research") | F.coalesce(F.array_contains(labels, "exploratory"), F.lit(False))
    return F.coalesce(named, F.when(risky, "high-assurance").when(open_, "exploratory").when(body.rlike("(?i)docs-only|typo|bounded|low-risk"), "bounded").otherwise("standard"))


def version_part(version: Column, part: int) -> Column:
    """1 to 3: the numbers of a version; 4: its pre-release name. Null for what is no version."""
    x = F.nullif(F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?$", part), F.lit(""))
    return x if part == 4 else x.cast("long")


def next_version(version: Column, bump: Column) -> Column:
    a, b, c = (version_part(version, i) for i in (1, 2, 3))
    return F.when(bump == "main", F.format_string("%d.0.0", a + 1)).when(bump == "minor", F.format_string("%d.%d.0", a, b + 1)).when(bump == "fix", F.format_string("%d.%d.%d", a, b, c + 1))


def bounded_path(path: Column, denied, exact, starts, parts) -> Column:
    """Whether a changed path may be in a bounded change: denied fragments win, then exact names, beginnings, fragments."""
    some = lambda xs, f: F.lit(False) if not xs else f
    any_of = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(path, x))
    deny = some(denied, any_of(denied) if denied else None)
    allow = path.isin(*exact) if exact else F.lit(False)
    for s in starts:
        allow = allow | path.startswith(s)
    return ~deny & (allow | some(parts, any_of(parts) if parts else None))


def rank_allows(parent: Column, child: Column, order) -> Column:
    """Whether a child's boundary is no wider than its parent's, by their places in `order`; unknown ones aren't."""
    at = lambda x: F.array_position(F.array(*map(F.lit, order)), x)
    return F.coalesce((at(child) > 0) & (at(parent) > 0) & (at(child) <= at(parent)), F.lit(False))


def transition_allowed(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows (from_state, to_state, ...) with allowed: whether the pair stands in the transition table, which is broadcast
    where it is small."""
    table = allowed.select("from_state", "to_state").distinct().withColumn("allowed", F.lit(True))
    return rows.join(table, ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def status_outcome(status: Column) -> Column:
    """What an HTTP status says of a reported link: 404 and 410 dead, 200 to 399 alive, anything else for a person."""
    return F.when(status.isin(404, 410), "dead").when(status.between(200, 399), "alive").otherwise("queued")


def registry(packs: DataFrame) -> DataFrame:
    """packs (pack_id, path, enabled, errors long) with state: duplicate where an id occurs more than once, disabled, invalid
    with errors, else valid."""
    twice = packs.groupBy("pack_id").agg((F.count("*") > 1).alias("_twice"))
    state = F.when(F.col("_twice"), "duplicate").when(~F.coalesce("enabled", F.lit(True)), "disabled").when(F.col("errors") > 0, "invalid").otherwise("valid")
    return packs.join(twice, "pack_id", "left").withColumn("state", state).drop("_twice")


def execution_target(requests: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """requests (requested, configured, current, model) with target and basis: asked for, configured, the current agent, the first
    model pattern that fits, or a question."""
    by_model = F.lit(None).cast("string")
    for pattern, target in reversed(models):
        by_model = F.when(F.col("model").rlike(pattern), target).otherwise(by_model)
    basis = F.when(F.col("requested").isNotNull(), "explicit").when(F.col("configured").isNotNull(), "configured").when(F.col("current").isNotNull(), "self").when(by_model.isNotNull(), "model").otherwise("clarification")
    return requests.select("*", F.coalesce("requested", "configured", "current", by_model).alias("target"), basis.alias("basis"))
