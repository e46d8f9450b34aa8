"""Queries of collaboration plans, policies, community issues and records of older lists on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import policy, projects
from .audits import _findings, pick, strings
from .catalogue import read
from .files import landed

_MODES = ("single-agent", "advisory", "council", "parallel-discovery", "spike", "human-gated", "mob")


def collaboration_plans(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    asked = o.select("o_orderkey", pick(_MODES, k % 7).alias("mode"), F.when(k % 3 == 0, "high-assurance").otherwise("standard").alias("profile"), F.when(k % 10 == 3, "manual").when(k % 10 != 4, "local").alias("transport"), pick(("full", "degraded"), k % 2).alias("delegated"), pick(("bound", "degraded", "manual", "blocked"), k % 4).alias("binding"))
    p = policy.collaboration_plans(asked).select("o_orderkey", "plan.*")
    said = lambda c: F.array_join(c, ",")
    helpers = said(F.transform("helpers", lambda h: F.concat_ws(":", h["role"], h["permissions"], h["max_files"].cast("string"))))
    return p.select("o_orderkey", helpers.alias("helpers"), said("requires").alias("requires"), said("controls").alias("controls"), F.concat_ws("/", "limits.delegates", "limits.depth", "limits.iterations").alias("limits"), "fallback", said("fallback_modes").alias("fallback_modes"), "environment", "strategy", "writer", "human_gate", "synthesis", said("errors").alias("errors"))


COLLABORATION_PLANS = """WITH x AS (SELECT o_orderkey AS k, (['single-agent', 'advisory', 'council', 'parallel-discovery', 'spike', 'human-gated', 'mob'])[o_orderkey % 7 + 1] AS mode FROM orders),
m(mode, helpers, requires, n) AS (VALUES ('single-agent', '', 'workflow-orchestration', 1), ('advisory', 'risk-scout:read-only', 'workflow-orchestration,delegated-work', 1),
  ('council', 'risk-scout:read-only,implementation-strategist:read-only,testability-scout:read-only,docs-impact-scout:read-only', 'workflow-orchestration,delegated-work', 4),
  ('parallel-discovery', 'requirements-scout:read-only:40,architecture-scout:read-only:40', 'workflow-orchestration,delegated-work,parallel-fanout', 2), ('spike', 'spike-implementer:writer', 'workflow-orchestration,delegated-work,isolated-workspace', 1),
  ('human-gated', 'human-reviewer:human-gate', 'workflow-orchestration', 1), ('mob', '', '', 1))
SELECT k AS o_orderkey, helpers, requires, 'single-writer,authority-may-only-narrow' || CASE WHEN k % 3 = 0 THEN ',review-independence,human-approval' ELSE '' END AS controls, n || '/1/3' AS limits, mode NOT IN ('human-gated', 'spike') AS fallback,
  CASE WHEN mode = 'single-agent' THEN 'manual' ELSE 'sequential,manual' END AS fallback_modes, CASE WHEN mode = 'spike' THEN 'worktree' WHEN mode = 'human-gated' OR k % 10 = 3 THEN 'human-handoff' WHEN k % 2 = 0 THEN 'forked-context' ELSE 'current-session' END AS environment,
  CASE WHEN k % 4 = 1 THEN 'fallback' ELSE 'provider-native-or-adapter' END AS strategy, CASE WHEN mode = 'spike' THEN 'isolated-worktree-helper' ELSE 'parent' END AS writer, mode = 'human-gated' AS human_gate, helpers <> '' AS synthesis,
  concat_ws(',', CASE WHEN mode = 'mob' THEN 'mode' END, CASE WHEN k % 4 = 3 THEN 'binding' END) AS errors FROM x JOIN m USING (mode)"""


def policy_findings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    settings = F.create_map(F.lit("contractVersion"), F.when(k % 5 == 0, "1").otherwise("2"), F.lit("highAssuranceHumanReviewPhase"), F.when(k % 7 != 0, "6").otherwise("5"), F.lit("requiredJourneyCoverage"), F.when(k % 6 == 0, "yes").when(k % 6 != 1, "true"))
    origins = F.when(k % 8 == 0, strings()).when(k % 8 == 1, strings("said", "collector-observed")).when(k % 8 != 2, strings("external-resolved"))
    maxima = F.when(k % 3 == 0, F.create_map(F.lit("usd"), (k % 11 - 1).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    budget = F.when(k % 13 != 0, F.struct(F.when(k % 2 == 0, "usd").otherwise("tokens").alias("unit"), F.when(k % 10 == 0, "advisory").otherwise("admission-enforced").alias("level"), F.lit(5.0).alias("limit")))
    return policy.policy_findings(o.select(k.alias("id"), settings.alias("settings"), origins.alias("origins"), maxima.alias("maxima"), budget.alias("budget")))


POLICY_FINDINGS = "WITH x AS (SELECT o_orderkey AS k FROM orders) " + _findings("x", "k", [
    ("blocker", "policy.contractVersion", "k % 5 = 0"), ("blocker", "policy.highAssuranceHumanReviewPhase", "k % 7 = 0"), ("high", "policy.origins", "k % 8 < 2"), ("high", "policy.journeys", "k % 6 = 0"), ("high", "policy.maximum", "k % 3 = 0 AND k % 11 = 0"),
    ("high", "policy.budget", "k % 3 = 0 AND NOT (k % 13 <> 0 AND k % 2 = 0 AND k % 10 <> 0 AND 5 <= k % 11 - 1)"),
])


def branching_findings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("id"), F.when(k % 9 == 0, " ").otherwise("main").alias("trunk"), F.when(k % 4 == 0, None).when(k % 4 == 1, "main").otherwise("staging").alias("release_candidate"), F.when(k % 11 != 0, "development").alias("integration"), F.when(k % 5 == 0, "other").otherwise("development").alias("target"),
        F.when(k % 6 == 0, strings("main", "main")).otherwise(strings("main", "staging", "development")).alias("promotion"), F.when(k % 7 == 0, strings("main")).otherwise(strings("main", "staging", "development")).alias("denied"), F.when(k % 10 == 0, strings()).when(k % 10 == 1, strings("work/", "")).otherwise(strings("work/")).alias("prefixes"), (k % 3 != 0).alias("bounded"),
    )
    return policy.branching_findings(rows)


BRANCHING_FINDINGS = """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'main' END AS t, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'main' ELSE 'staging' END AS r, CASE WHEN o_orderkey % 11 <> 0 THEN 'development' END AS i, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'development' END AS target,
  CASE WHEN o_orderkey % 6 = 0 THEN ['main', 'main'] ELSE ['main', 'staging', 'development'] END AS p, CASE WHEN o_orderkey % 7 = 0 THEN ['main'] ELSE ['main', 'staging', 'development'] END AS dn FROM orders),
x AS (SELECT *, list_filter([t, r, i], lambda z: z IS NOT NULL) AS tiers FROM a) """ + _findings("x", "k", [
    ("high", "branching.trunk", "trim(t) = ''"), ("high", "branching.integration", "i IS NULL"), ("high", "branching.promotion.entries", "len(list_distinct(p)) <> len(p)"), ("high", "branching.prefixes.entries", "k % 10 = 1"), ("high", "branching.distinct", "len(list_distinct(tiers)) <> len(tiers)"),
    ("high", "branching.target.promotion", "NOT list_contains(p, target)"), ("high", "branching.promotion.tiers", "len(list_filter(tiers, lambda z: NOT list_contains(p, z))) > 0"), ("high", "branching.denied.tiers", "len(list_filter(tiers, lambda z: NOT list_contains(dn, z))) > 0"), ("high", "branching.prefixes", "k % 3 <> 0 AND k % 10 = 0"),
])


def _proposals(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    url = F.concat(F.when(k % 6 == 0, "https://example.org/").otherwise("https://github.com/"), F.lit("o/r"), k)
    labels = F.when(k % 10 == 0, strings("bug", "resolved")).when(k % 10 != 1, strings("bug"))
    rows = o.select("o_orderkey", labels.alias("labels"), policy.proposal_decision(url, F.when(k % 9 != 4, pick(("found", "found", "missing", "limited"), k % 4)), F.when(k % 7 != 0, pick(("eligible", "excluded", "pending"), k % 3))).alias("decision"))
    return rows.where(~policy.processed(F.col("labels")))


_PROPOSALS = """x AS (SELECT o_orderkey, o_orderkey % 6 <> 0 AS fine, CASE WHEN o_orderkey % 9 <> 4 THEN (['found', 'found', 'missing', 'limited'])[o_orderkey % 4 + 1] END AS repo, CASE WHEN o_orderkey % 7 <> 0 THEN (['eligible', 'excluded', 'pending'])[o_orderkey % 3 + 1] END AS state FROM orders WHERE o_orderkey % 10 <> 0),
y AS (SELECT o_orderkey, CASE WHEN NOT fine THEN 'url' WHEN repo = 'limited' THEN 'unavailable' WHEN repo IS NULL OR repo <> 'found' THEN 'missing' WHEN state IN ('eligible', 'excluded') THEN state ELSE 'pending' END AS basis FROM x),
z AS (SELECT o_orderkey, basis, CASE WHEN basis IN ('unavailable', 'pending') THEN 'queued' WHEN basis = 'eligible' THEN 'staged' ELSE 'resolved' END AS outcome FROM y)"""


def proposal_decisions(spark, d):
    return _proposals(spark, d).select("o_orderkey", "decision.outcome", "decision.basis", "decision.closed", "decision.close_reason")


PROPOSAL_DECISIONS = f"WITH {_PROPOSALS} SELECT o_orderkey, outcome, basis, outcome <> 'queued' AS closed, CASE outcome WHEN 'staged' THEN 'completed' WHEN 'resolved' THEN 'not planned' END AS close_reason FROM z"


def intake_summary(spark, d):
    return policy.intake_summary(_proposals(spark, d))


INTAKE_SUMMARY = f"WITH {_PROPOSALS} SELECT count(*) AS issues, count(*) FILTER (outcome <> 'queued') AS closed, count(*) FILTER (outcome = 'staged') AS staged, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'queued') AS queued FROM z"


def flag_decisions(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    url = F.when(k % 8 == 0, " ").otherwise(F.concat(F.when(k % 5 == 0, "https://example.org/").otherwise("https://github.com/"), F.lit("o/r"), k))
    status = F.when(k % 7 != 0, pick((200, 404, 410, 301, 500), k % 5))
    got = policy.flag_decision(pick((*policy.FLAGS, "Rude"), k % 4), url, status, k % 3 != 0, F.array(F.lit("b"), F.lit("a")), F.when(k % 11 == 0, strings("a", "b")).otherwise(strings("c")), F.when(k % 6 != 0, k % 2 == 0), F.when(k % 10 != 0, pick(("eligible", "pending"), (k / 4).cast("long") % 2)))
    return o.select("o_orderkey", got.alias("x")).select("o_orderkey", "x.outcome", "x.basis", "x.closed", "x.close_reason")


FLAG_DECISIONS = """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 4 AS f, CASE WHEN o_orderkey % 7 <> 0 THEN ([200, 404, 410, 301, 500])[o_orderkey % 5 + 1] END AS s FROM orders),
y AS (SELECT k, CASE WHEN f = 3 THEN 'flag' WHEN k % 8 = 0 THEN 'no url' WHEN f = 0 THEN CASE WHEN s IN (404, 410) THEN 'dead' WHEN s BETWEEN 200 AND 399 THEN 'alive' ELSE 'status' END WHEN f = 1 THEN CASE WHEN k % 3 = 0 THEN 'unpublished' WHEN k % 11 = 0 THEN 'same topics' ELSE 'other topics' END
  WHEN k % 5 = 0 THEN 'url' ELSE 'fork' END AS basis, k % 6 <> 0 AND k % 2 = 0 AND k % 10 <> 0 AND (k // 4) % 2 = 0 AS own FROM x),
z AS (SELECT *, CASE WHEN basis IN ('flag', 'status', 'unpublished') OR (basis = 'fork' AND NOT own) THEN 'queued' ELSE 'resolved' END AS outcome FROM y)
SELECT k AS o_orderkey, outcome, basis, outcome = 'resolved' AS closed, CASE WHEN outcome = 'queued' THEN NULL WHEN basis IN ('dead', 'other topics', 'fork') THEN 'completed' ELSE 'not planned' END AS close_reason FROM z"""


def step_summaries(spark, d):
    """Users as runs, their events as steps."""
    e = read(spark, d, "events")
    return policy.step_summary(e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.struct("ts", "event_id").alias("place"), F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 60, "failed").otherwise("ok").alias("status"), F.floor("value").cast("long").alias("seconds")))


STEP_SUMMARIES = """SELECT user_id AS run_id, count(*) AS steps, count(*) FILTER (event_type = 'error' OR value > 60) AS failed, arg_min(event_type, (ts, event_id)) FILTER (event_type = 'error' OR value > 60) AS first_failed, CAST(sum(floor(value)) AS BIGINT) AS seconds FROM events GROUP BY 1"""


def config_rows(spark, d):
    """Regions as configuration files, their nations as roles; two slugs are the same in some files."""
    n, k = read(spark, d, "nation"), F.col("n_nationkey")
    role = F.struct(F.when(k % 7 == 3, "same").when(k % 8 == 0, "same").otherwise(F.lower("n_name")).alias("slug"), k.cast("long").alias("rank"))
    doc = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(role).alias("roles"))).alias("value"))
    return policy.config_rows(spark, landed(doc, "config", per_file=1), "roles", "slug:string,rank:bigint").select("slug", "rank", "repeated")


CONFIG_ROWS = """WITH x AS (SELECT n_regionkey AS r, CASE WHEN n_nationkey % 7 = 3 OR n_nationkey % 8 = 0 THEN 'same' ELSE lower(n_name) END AS slug, CAST(n_nationkey AS BIGINT) AS rank FROM nation)
SELECT slug, rank, count(*) OVER (PARTITION BY r, slug) > 1 AS repeated FROM x"""


def _readmes(spark, d):
    """Orders as older lists: a heading, then their lines as items, by line number and part."""
    li = read(spark, d, "lineitem")
    item = F.concat(F.lit("- ["), F.lit("Part "), F.col("l_partkey"), F.lit("](https://example.org/p/"), F.col("l_partkey"), F.lit(") - *fine* for "), F.col("l_suppkey"), F.lit("\n"))
    one = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("t")))).alias("x"))
    head = F.when(F.col("l_orderkey") % 7 == 0, "## Contributing\n").when(F.col("l_orderkey") % 3 == 0, "## Tools & *more*\n").otherwise("\n")
    return one.select(F.col("l_orderkey").cast("string").alias("source"), F.concat(head, F.array_join(F.transform("x", lambda v: v["t"]), "")).alias("markdown"))


_RECORDS = """r AS (SELECT l_orderkey AS k, l_partkey, l_suppkey, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem WHERE l_orderkey % 7 <> 0),
x AS (SELECT 'https://example.org/p/' || l_partkey AS url, CAST(k AS VARCHAR) AS source, line, 'Part ' || l_partkey AS title, 'fine for ' || l_suppkey AS description, CASE WHEN k % 3 = 0 THEN 'Tools & more' ELSE 'General' END AS category FROM r)"""


def list_records(spark, d):
    return markdown.list_records(_readmes(spark, d)).drop("seq")


LIST_RECORDS = f"WITH {_RECORDS} SELECT * FROM x"


def records_by_url(spark, d):
    """Older lists read and merged by URL."""
    got = projects.merge_records(markdown.list_records(_readmes(spark, d)))
    return got.select("id", "url", "title", "description", F.size("occurrences").cast("long").alias("occurrences"))


RECORDS_BY_URL = f"WITH {_RECORDS} SELECT substr(sha256(url), 1, 20) AS id, url, min(title) AS title, arg_min(description, (source, line)) AS description, count(*) AS occurrences FROM x GROUP BY url"

NAMES = "collaboration_plans policy_findings branching_findings proposal_decisions intake_summary flag_decisions step_summaries config_rows list_records records_by_url".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
