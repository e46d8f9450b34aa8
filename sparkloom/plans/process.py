"""Queries of the process operators on the driver tables.

A subject or run is a user, its events are rows of events in order of time; orders stand in for records of decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.markdown import form_fields, section
from ..functions.similarity import title_similarity
from ..operators import checks, decisions, process
from ..sources import artifacts
from ..streaming import runs
from .catalogue import first, read

_TYPES = {"view": "work-started", "click": "review-requested", "signup": "review-completed", "purchase": "pr-ready", "error": "validation-completed"}
AS_OF = "2024-02-15 00:00:00"


def _case(column: str, pairs: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _case_sql(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def outcome_events(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event repeats the id of the one before, with a later date."""
    e = read(spark, d, "events")
    key = F.when(F.col("event_id") % 10 == 9, F.col("event_id") - 1).otherwise(F.col("event_id"))
    return e.select(key.cast("string").alias("id"), F.col("user_id").cast("string").alias("subject"), _case("event_type", _TYPES).alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.when(F.col("value") > 30, "pass").otherwise("fail").alias("outcome"))


_OUTCOMES = f"""e AS (SELECT CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS subject, {_case_sql('event_type', _TYPES)} AS type, ts, CASE WHEN value > 30 THEN 'pass' ELSE 'fail' END AS outcome FROM events),
v AS (SELECT id, arg_min(subject, ts) AS subject, arg_min(type, ts) AS type, min(ts) AS ts, arg_min(outcome, ts) AS outcome FROM e WHERE type IS NOT NULL GROUP BY id),
m AS (SELECT subject, min(ts) FILTER (type = 'work-started') AS w, min(ts) FILTER (type = 'pr-ready') AS p, min(ts) FILTER (type = 'review-requested') AS q, min(ts) FILTER (type = 'review-completed') AS r,
        arg_min(outcome, (ts, id)) FILTER (type = 'validation-completed') AS o FROM v GROUP BY subject)"""


def outcome_metrics(spark, d):
    m = process.outcome_metrics(process.valid_outcome_events(outcome_events(spark, d)), AS_OF)
    return m.select("subject", F.round("cycle_seconds", 3).alias("cycle_seconds"), F.round("review_seconds", 3).alias("review_seconds"), "release_seconds", "follow_up_seconds", "first_pass_validation")


def _span(a: str, z: str) -> str:
    return f"CASE WHEN {z} >= {a} THEN round((epoch_us({z}) - epoch_us({a})) / 1000000.0, 3) END"


OUTCOME_METRICS = f"WITH {_OUTCOMES} SELECT subject, {_span('w', 'p')} AS cycle_seconds, {_span('q', 'r')} AS review_seconds, CAST(NULL AS DOUBLE) AS release_seconds, CAST(NULL AS DOUBLE) AS follow_up_seconds, o = 'pass' AS first_pass_validation FROM m"


def first_pass_rate(spark, d):
    m = process.outcome_metrics(process.valid_outcome_events(outcome_events(spark, d)), AS_OF)
    return process.first_pass_rate(m).withColumn("first_pass_rate", F.round("first_pass_rate", 6))


FIRST_PASS_RATE = f"WITH {_OUTCOMES} SELECT count(*) AS subjects, round(avg(CAST(o = 'pass' AS INT)), 6) AS first_pass_rate FROM m"


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """run_id, kind, to, criterion, outcome, errors, origin, state, findings, operation_kind, timestamp, event_id."""
    e = read(spark, d, "events")
    kind = {"view": "observation", "click": "observation", "signup": "advanced", "purchase": "paused", "error": "resumed"}
    return e.select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").alias("seq"), _case("event_type", kind).alias("kind"), (F.col("event_id") % 9).cast("int").alias("to"), (F.col("event_id") % 3).cast("string").alias("criterion"),
        F.when(F.col("value") > 30, "pass").otherwise("fail").alias("outcome"), F.when(F.col("value") < 15, F.array(F.lit("timeout"), F.lit("timeout"), F.lit("flaky"))).alias("errors"), F.when(F.col("event_id") % 4 > 0, "collector-observed").otherwise("claimed").alias("origin"),
        F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("findings"), F.lit(None).cast("string").alias("operation_kind"), F.col("ts").alias("timestamp"),
    )


_RUNS = """e AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'observation' WHEN 'signup' THEN 'advanced' WHEN 'purchase' THEN 'paused' ELSE 'resumed' END AS kind,
  event_id % 9 AS "to", CAST(event_id % 3 AS VARCHAR) AS criterion, CASE WHEN value > 30 THEN 'pass' ELSE 'fail' END AS outcome, value < 15 AS errs, event_id % 4 > 0 AS observed FROM events),
p AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'advanced' THEN "to" END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS phase FROM e),
a AS (SELECT *, lag(errs) OVER (PARTITION BY run_id, phase, criterion ORDER BY ts, event_id) AS before FROM p WHERE kind = 'observation')"""


def run_windows(spark, d):
    a = process.attempts(run_events(spark, d), order=("seq", "event_id"))
    return a.select("run_id", "event_id", F.col("phase").cast("long").alias("phase"), "retry", F.array_join("causes", ",").alias("causes"))


RUN_WINDOWS = f"WITH {_RUNS} SELECT run_id, event_id, phase, before IS NOT NULL AS retry, CASE WHEN before THEN 'timeout,flaky' WHEN NOT before THEN 'unclassified' END AS causes FROM a"


def retry_causes(spark, d):
    return process.retry_causes(process.attempts(run_events(spark, d), order=("seq", "event_id")))


RETRY_CAUSES = f"WITH {_RUNS}, c AS (SELECT run_id, unnest(CASE WHEN before THEN ['timeout', 'flaky'] ELSE ['unclassified'] END) AS cause FROM a WHERE before IS NOT NULL) SELECT run_id, cause, count(*) AS n FROM c GROUP BY ALL"


def run_metrics(spark, d):
    m = process.run_metrics(run_events(spark, d), order=("seq", "event_id"))
    return m.select("run_id", "attempts", "observed", "passed", F.round("evidence_seconds", 3).alias("evidence_seconds"), F.round("acceptance_seconds", 3).alias("acceptance_seconds"), F.round("setup_seconds", 3).alias("setup_seconds"), "promotions")


RUN_METRICS = f"""WITH {_RUNS}, x AS (SELECT run_id, count(*) FILTER (kind = 'observation') AS attempts, count(*) FILTER (kind = 'observation' AND observed) AS observed, count(*) FILTER (kind = 'observation' AND observed AND outcome = 'pass') AS passed,
  min(ts) AS f, min(ts) FILTER (kind = 'observation' AND observed AND outcome = 'pass') AS ev, min(ts) FILTER (kind = 'advanced') AS ac, min(ts) FILTER (kind = 'advanced' AND "to" = 4) AS su, count(*) FILTER (kind = 'advanced') AS promotions FROM e GROUP BY run_id)
SELECT run_id, attempts, observed, passed, {_span('f', 'ev')} AS evidence_seconds, {_span('f', 'ac')} AS acceptance_seconds, {_span('f', 'su')} AS setup_seconds, promotions FROM x"""


def recoveries(spark, d):
    r = process.recoveries(run_events(spark, d), order=("seq", "event_id"))
    return r.select("run_id", "event_id", F.round("seconds", 3).alias("seconds"))


RECOVERIES = f"""WITH {_RUNS}, s AS (SELECT run_id, event_id, kind, ts, last_value(CASE WHEN kind = 'paused' THEN ts END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM e)
SELECT run_id, event_id, {_span('stop', 'ts')} AS seconds FROM s WHERE kind = 'resumed'"""


def usage_deltas(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("event_type").alias("unit"), F.floor(F.col("value") * 100).alias("value"), F.when(F.col("event_id") % 3 == 0, "delta").otherwise("cumulative").alias("mode"), "ts", "event_id")
    return process.usage_deltas(e, order=("ts", "event_id")).select("event_id", "reset", "delta")


USAGE_DELTAS = """WITH e AS (SELECT event_id, floor(value * 100)::BIGINT AS v, event_id % 3 = 0 AS dl, coalesce(lag(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), event_type ORDER BY ts, event_id), 0) AS b FROM events)
SELECT event_id, NOT dl AND v < b AS reset, CASE WHEN dl THEN v WHEN v >= b THEN v - b END AS delta FROM e"""


def usage_totals(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("provider"), F.lit("1").alias("epoch"), F.col("event_type").alias("unit"), F.col("event_id").alias("value"), F.lit("cumulative").alias("mode"), "ts", "event_id")
    return process.usage_totals(process.usage_deltas(e, order=("event_id",)))


USAGE_TOTALS = "SELECT user_id AS provider, event_type AS unit, CAST(max(event_id) AS BIGINT) AS total, CAST(0 AS BIGINT) AS resets FROM events GROUP BY ALL"


def budget_admission(spark, d):
    o = read(spark, d, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "advisory").when(F.col("o_orderstatus") == "O", "admission-enforced").otherwise("provider-enforced")
    rows = o.select("o_orderkey", level.alias("level"), F.lit(300000.0).alias("limit"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("used"), F.lit(50000.0).alias("estimated_next"), (F.col("o_orderkey") % 2 == 0).alias("can_stop"))
    return process.budget_admission(rows).select("o_orderkey", "known", "exceeded", "enforceable", "admitted", "reason")


BUDGET_ADMISSION = """WITH x AS (SELECT o_orderkey, o_orderstatus AS s, o_orderkey % 6 <> 0 AS known, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice + 50000.0 > 300000.0 END AS exceeded, o_orderstatus <> 'P' OR o_orderkey % 2 = 0 AS enforceable FROM orders)
SELECT o_orderkey, known, exceeded, enforceable, s = 'F' OR (known AND NOT exceeded AND enforceable) AS admitted,
  CASE WHEN NOT known THEN 'Usage or next-attempt bound unknown' WHEN NOT enforceable THEN 'Provider cannot enforce cancellation' WHEN exceeded THEN 'Budget exhausted' ELSE 'Within budget' END AS reason FROM x"""


def journey_coverage(spark, d):
    """A customer's parts are criteria of its journey; parts that were ever returned have no passing observation."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    named = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("criteria"))
    passing = li.groupBy("l_partkey").agg(F.max(F.col("l_discount") * 100).alias("x")).where("x < 9.99").select(F.col("l_partkey").cast("string").alias("criterion"))
    return process.journey_coverage(named.withColumn("required", F.col("id") % 2 == 0), passing)


JOURNEY_COVERAGE = """WITH c AS (SELECT DISTINCT o_custkey AS id, l_partkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING max(l_discount * 100) < 9.99)
SELECT id, bool_and(id % 2 = 0) AS required, count(*) AS criteria, count(*) FILTER (p.l_partkey IS NULL) AS missing, count(*) FILTER (p.l_partkey IS NULL) = 0 AS verified FROM c LEFT JOIN p ON p.l_partkey = k GROUP BY id"""


def lifecycle(spark, d):
    o = read(spark, d, "orders")
    kinds = F.element_at(F.array(*map(F.lit, ("merge", "tag", "release"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    seen = o.select(kinds.alias("kind"), F.col("o_custkey").cast("string").alias("target"), (F.col("o_orderkey") % 4 != 0).alias("verified"), F.when(F.col("o_orderstatus") != "F", "pass").otherwise("fail").alias("outcome"), (F.col("o_orderkey") % 5 == 0).alias("prerelease"), F.lit(None).cast("boolean").alias("exercised"), F.col("o_orderkey").alias("age_ms"), (F.col("o_orderkey") % 50 == 0).alias("unresolved"))
    asked = read(spark, d, "customer").select(F.lit("release").alias("kind"), F.col("c_custkey").cast("string").alias("target"), F.when(F.col("c_custkey") % 2 == 0, "stable").otherwise("any").alias("channel"), F.lit(False).alias("exercised"), F.when(F.col("c_custkey") % 3 == 0, 9000).cast("long").alias("max_age_ms"))
    return process.lifecycle(asked, seen).select("target", "channel", "valid", "status")


LIFECYCLE = """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'stable' ELSE 'any' END AS channel, CASE WHEN c_custkey % 3 = 0 THEN 9000 END AS age FROM customer),
r AS (SELECT c_custkey, channel, count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderstatus <> 'F' AND (channel = 'any' OR o_orderkey % 5 <> 0) AND (age IS NULL OR o_orderkey <= age)) AS valid, coalesce(bool_or(o_orderkey % 50 = 0), false) AS open
      FROM q LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = 2 GROUP BY ALL)
SELECT CAST(c_custkey AS VARCHAR) AS target, channel, valid, CASE WHEN valid > 0 AND NOT open THEN 'pass' ELSE 'blocked' END AS status FROM r"""


def platform_rates(spark, d):
    s = read(spark, d, "events").select(F.col("event_type").alias("platform"), (F.col("value") > 40).alias("high_assurance"), (F.col("event_id") % 4).alias("findings"))
    return process.platform_rates(s)


PLATFORM_RATES = "SELECT event_type AS platform, count(*) AS sessions, round(avg(CAST(value > 40 AS INT)), 4) AS high_assurance_rate, round(sum(event_id % 4) / count(*), 4) AS findings_rate FROM events GROUP BY 1"


def rate_rows(spark, d):
    return process.unpivot_rates(platform_rates(spark, d))


RATE_ROWS = f"UNPIVOT (SELECT platform, high_assurance_rate, findings_rate FROM ({PLATFORM_RATES})) ON high_assurance_rate, findings_rate INTO NAME metric VALUE rate"


def common_values(spark, d):
    return process.common_values(read(spark, d, "orders"), "o_orderpriority", "o_orderkey")


COMMON_VALUES = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"


def kind_counts(spark, d):
    s = read(spark, d, "conversations").select(_case("role", {"user": "pr", "assistant": "rollup"}).alias("kind"))
    return process.kind_counts(s)


KIND_COUNTS = "SELECT count(*) AS sessions, count(*) FILTER (role = 'user') AS pr, count(*) FILTER (role = 'assistant') AS rollup, CAST(0 AS BIGINT) AS release FROM conversations"


def evals_score(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    rows = docs.join(labels, "doc_id")
    kinds = F.array(F.struct(F.lit("contains").alias("kind"), F.lit(".").alias("value")), F.struct(F.lit("not-contains").alias("kind"), F.lit("!!").alias("value")), F.struct(F.lit("regex").alias("kind"), F.lit("[a-z]{3} [a-z]").alias("value")))
    cases = rows.select(F.col("doc_id").alias("case_id"), "text", F.explode(kinds).alias("k")).select("case_id", "text", "k.kind", "k.value")
    return process.eval_score(process.assertions(cases), 0.8).withColumn("score", F.round("score", 6))


EVALS_SCORE = """WITH x AS (SELECT contains(text, '.') AND NOT contains(text, '!!') AND regexp_matches(text, '[a-z]{3} [a-z]') AS ok FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(CAST(ok AS INT)), 6) AS score, avg(CAST(ok AS INT)) >= 0.8 AS ok FROM x"""


def authoritative_dups(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("kind"), F.when(F.col("lang") != "en", F.col("lang")).alias("scope"), (F.col("doc_id") % 17 == 0).alias("authoritative"))
    return process.duplicate_authority(docs)


AUTHORITATIVE_DUPS = "SELECT source AS kind, CASE WHEN lang <> 'en' THEN lang ELSE 'default' END AS scope, count(*) AS n FROM documents WHERE doc_id % 17 = 0 GROUP BY ALL HAVING count(*) > 1"


def text_findings(spark, d):
    return process.text_findings(read(spark, d, "documents"), "doc_id", "text")


TEXT_FINDINGS = r"""SELECT doc_id, 'blocker' AS severity, 'evidence.secrets' AS code FROM documents WHERE regexp_matches(text, '(?i)BEGIN (RSA|OPENSSH|PRIVATE) KEY|api[_-]?key\s*=|secret\s*=|token\s*=')
UNION ALL SELECT doc_id, 'high', 'evidence.raw-log' FROM documents WHERE regexp_matches(text, '(?i)(^|\n)(User|Assistant|Tool|System):') AND length(text) > 2000"""


def decision_modes(spark, d):
    o = read(spark, d, "orders")
    level = lambda i: F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("o_orderkey") / i).cast("int") % 3 + 1)
    profile = F.when(F.col("o_orderstatus") == "P", "high-assurance").when(F.col("o_orderstatus") == "O", "standard").otherwise("bounded")
    surfaces = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("docs"), F.lit("auth"))).otherwise(F.array(F.lit("docs")))
    asked = F.when(F.col("o_orderkey") % 10 == 3, "council").otherwise("auto-minimal")
    k = F.col("o_orderkey")
    mode = decisions.collaboration_mode(asked, profile, level(1), level(3), level(9), surfaces)
    cls = decisions.collaboration_class(profile, level(1), level(9), surfaces, k % 4, k % 25 == 1, k % 29 == 1, k % 31 != 1, k % 2 == 0)
    return o.select("o_orderkey", mode.alias("mode"), cls["class"].alias("class"), F.array_join(cls["triggers"], ",").alias("triggers"))


DECISION_MODES = """WITH x AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'high-assurance' WHEN 'O' THEN 'standard' ELSE 'bounded' END AS profile, o_orderkey % 7 = 0 AS hot, o_orderkey % 10 = 3 AS asked,
  o_orderkey % 3 AS risk, (o_orderkey // 3) % 3 AS effort, (o_orderkey // 9) % 3 AS unc FROM orders),
y AS (SELECT *, list_filter([CASE WHEN profile = 'high-assurance' THEN 'high-assurance-profile' END, CASE WHEN hot THEN 'sensitive-surface' END, CASE WHEN k % 31 = 1 THEN 'irreversible-change' END], lambda t: t IS NOT NULL) AS g,
  list_filter([CASE WHEN k % 25 = 1 THEN 'public-contract' END, CASE WHEN k % 29 = 1 THEN 'migration' END, CASE WHEN k % 4 >= 3 THEN 'cross-domain' END, CASE WHEN risk = 2 THEN 'high-risk' END, CASE WHEN unc = 2 THEN 'high-uncertainty' END], lambda t: t IS NOT NULL) AS c,
  list_filter([CASE WHEN risk = 1 THEN 'medium-risk' END, CASE WHEN unc = 1 THEN 'medium-uncertainty' END, CASE WHEN k % 2 <> 0 THEN 'incomplete-evidence' END, CASE WHEN k % 4 >= 2 THEN 'multi-domain' END], lambda t: t IS NOT NULL) AS b FROM x)
SELECT k AS o_orderkey, CASE WHEN profile = 'high-assurance' OR hot THEN 'human-gated' WHEN asked THEN 'council' WHEN effort = 2 THEN 'parallel-discovery' WHEN unc = 2 OR risk = 2 THEN 'council' WHEN profile = 'standard' OR risk = 1 OR unc = 1 THEN 'advisory' ELSE 'single-agent' END AS mode,
  CASE WHEN len(g) > 0 THEN 'human-gated' WHEN len(c) > 0 THEN 'council' WHEN len(b) > 0 THEN 'bilateral' ELSE 'linear' END AS class,
  array_to_string(CASE WHEN len(g) > 0 THEN g WHEN len(c) > 0 THEN c WHEN len(b) > 0 THEN b ELSE ['bounded-change'] END, ',') AS triggers FROM y"""


def branch_classes(spark, d):
    """Branches made of the columns of customers: a beginning by the key, then the segment or the name."""
    k = F.col("c_custkey")
    begin = F.element_at(F.array(*map(F.lit, ("fix/", "work/", "wt/", "issue/", "x/", "main", "feature/", ""))), (k % 8 + 1).cast("int"))
    rest = F.when(k % 8 == 5, F.when(k % 3 == 0, "-2").otherwise("")).when(k % 5 == 0, F.lower("c_name")).when(k % 5 == 1, F.concat_ws("-", "c_nationkey", F.lower("c_mktsegment"))).when(k % 5 == 2, F.col("c_mktsegment")).when((k % 8 == 7) & (k % 5 == 3), "").otherwise(F.lower("c_mktsegment"))
    c = read(spark, d, "customer").withColumn("branch", F.concat(begin, rest))
    return c.select("c_custkey", "branch", decisions.branch_class(F.col("branch")).alias("class"))


BRANCH_CLASSES = r"""WITH b AS (SELECT c_custkey, (['fix/', 'work/', 'wt/', 'issue/', 'x/', 'main', 'feature/', ''])[c_custkey % 8 + 1] || CASE WHEN c_custkey % 8 = 5 THEN CASE WHEN c_custkey % 3 = 0 THEN '-2' ELSE '' END
  WHEN c_custkey % 5 = 0 THEN lower(c_name) WHEN c_custkey % 5 = 1 THEN c_nationkey || '-' || lower(c_mktsegment) WHEN c_custkey % 5 = 2 THEN c_mktsegment WHEN c_custkey % 8 = 7 AND c_custkey % 5 = 3 THEN '' ELSE lower(c_mktsegment) END AS branch FROM customer)
SELECT c_custkey, branch, CASE WHEN branch = '' THEN 'detached' WHEN branch IN ('main', 'staging', 'development') THEN 'protected' WHEN regexp_full_match(branch, '(work|feature|fix|hotfix|spike)/[a-z][a-z0-9-]*') THEN 'work' WHEN regexp_matches(branch, '^(work|feature|fix|hotfix|spike)/') THEN 'invalid'
  WHEN regexp_full_match(branch, 'issue/[0-9]+-[a-z][a-z0-9-]+') OR regexp_matches(branch, '^(wt|claude)/') THEN 'compatibility' ELSE 'invalid' END AS class FROM b"""


def _issues(spark, d):
    """Documents as issues: the whole text with a beginning by the key."""
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    labels = F.when(k % 5 == 0, F.array(F.lit("documentation"))).when(k % 5 == 1, F.array(F.lit("bug"), F.lit("awaiting-release"))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.when(k % 7 == 0, "A new feature for version v1.2.3. ").when(k % 7 == 1, "Profile: bounded. ").when(k % 7 == 2, "A spike, internal-only. ").when(k % 7 == 3, "A breaking change of auth. ").otherwise(""), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", body.alias("body"), labels.alias("labels"), F.when(k % 2 == 0, "closed").otherwise("open").alias("state"), F.when(k % 11 == 0, "v2.0.0").alias("milestone"))


def issue_decisions(spark, d):
    body, labels = F.col("body"), F.col("labels")
    return _issues(spark, d).select("doc_id", decisions.release_impact(body, labels).alias("impact"), decisions.release_assignment(body, labels, F.col("state"), F.col("milestone")).alias("assignment"), decisions.issue_path(body, labels).alias("path"))


ISSUE_DECISIONS = r"""WITH a AS (SELECT doc_id AS k, CASE doc_id % 7 WHEN 0 THEN 'A new feature for version v1.2.3. ' WHEN 1 THEN 'Profile: bounded. ' WHEN 2 THEN 'A spike, internal-only. ' WHEN 3 THEN 'A breaking change of auth. ' ELSE '' END || coalesce(text, '') AS body,
  CASE doc_id % 5 WHEN 0 THEN ['documentation'] WHEN 1 THEN ['bug', 'awaiting-release'] ELSE [] END AS labels, CASE WHEN doc_id % 11 = 0 THEN 'v2.0.0' END AS milestone FROM documents),
b AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)no release impact|internal-only') THEN 'none' WHEN regexp_matches(body, '(?i)docs-only|documentation') OR list_contains(labels, 'documentation') THEN 'docs-only' WHEN regexp_matches(body, '(?i)breaking|major') THEN 'major'
  WHEN regexp_matches(body, '(?i)feature|minor') THEN 'minor' WHEN regexp_matches(body, '(?i)bug|fix|patch') OR list_contains(labels, 'bug') THEN 'patch' ELSE 'unknown' END AS impact,
  coalesce(nullif(regexp_extract(body, '(?i)(?:target release|release|version)\s*:?\s*(v\d+\.\d+\.\d+(?:[-+][\w.-]+)?)', 1), ''), milestone) AS candidate, lower(nullif(regexp_extract(body, '(?i)(?:profile|workflow classification)\s*:?\s*(bounded|standard|high-assurance|exploratory)', 1), '')) AS named FROM a)
SELECT k AS doc_id, impact, CASE WHEN impact = 'none' THEN 'no-release-impact' WHEN k % 2 = 0 AND k % 5 <> 1 THEN 'released' WHEN candidate IS NOT NULL THEN 'assigned' ELSE 'needs-assignment' END AS assignment,
  coalesce(named, CASE WHEN regexp_matches(body, '(?i)security|auth|remote|migration|data loss|production|high-assurance') THEN 'high-assurance' WHEN regexp_matches(body, '(?i)exploratory|spike|research') THEN 'exploratory' WHEN regexp_matches(body, '(?i)docs-only|typo|bounded|low-risk') THEN 'bounded' ELSE 'standard' END) AS path FROM b"""


def next_versions(spark, d):
    p = read(spark, d, "part").withColumn("v", F.concat_ws(".", F.concat(F.lit("v"), F.col("p_size")), F.col("p_partkey") % 10, F.col("p_partkey") % 7))
    bump = F.element_at(F.array(*map(F.lit, ("main", "minor", "fix"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", "v", decisions.next_version(F.col("v"), bump).alias("next"))


NEXT_VERSIONS = """SELECT p_partkey, 'v' || p_size || '.' || p_partkey % 10 || '.' || p_partkey % 7 AS v,
CASE p_partkey % 3 WHEN 0 THEN (p_size + 1) || '.0.0' WHEN 1 THEN p_size || '.' || (p_partkey % 10 + 1) || '.0' ELSE p_size || '.' || p_partkey % 10 || '.' || (p_partkey % 7 + 1) END AS next FROM part"""


def role_routes(spark, d):
    """Suppliers are candidates for parts, in order of their keys; those with a negative balance aren't available."""
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("role"), F.col("l_suppkey").alias("agent")).distinct().withColumn("place", F.col("agent"))
    agents = read(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), (F.col("s_suppkey") % 3 != 0).alias("enabled"), (F.col("s_acctbal") > 3000).alias("available"))
    return decisions.first_available(li, agents).select("role", "agent", "status")


ROLE_ROUTES = """WITH c AS (SELECT DISTINCT l_partkey AS role, l_suppkey AS agent FROM lineitem), a AS (SELECT s_suppkey AS agent, s_suppkey % 3 <> 0 AND s_acctbal > 3000 AS ok FROM supplier)
SELECT role, min(agent) FILTER (ok) AS agent, CASE WHEN min(agent) FILTER (ok) IS NULL THEN 'blocked' ELSE 'routed' END AS status FROM c LEFT JOIN a USING (agent) GROUP BY role"""


def transitions(spark, d):
    """Status and priority of orders as states; four pairs are allowed."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("from_state"), F.col("o_orderpriority").alias("to_state"))
    allowed = spark.createDataFrame([("F", "1-URGENT"), ("O", "2-HIGH"), ("P", "5-LOW"), ("O", "5-LOW")], "from_state string, to_state string")
    return decisions.transition_allowed(o, allowed).select("o_orderkey", "allowed")


TRANSITIONS = "SELECT o_orderkey, (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '2-HIGH'), ('P', '5-LOW'), ('O', '5-LOW')) AS allowed FROM orders"


def constraint_findings(spark, d):
    """Constraints on orders, of which some are broken: keys are unique, customers exist, prices and dates are in range."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    rules = {"price": F.col("o_totalprice").between(2000, 490000), "date": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz")}
    named = c.where("c_custkey % 50 <> 3")
    found = checks.together(checks.breaks(o, "orders", "o_orderkey", rules), checks.repeated(o, "orders", "o_orderkey"), checks.dangling(o, "orders", "o_custkey", named, "c_custkey"))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("least"))


CONSTRAINT_FINDINGS = """SELECT 'price' AS rule, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS least FROM orders WHERE o_totalprice NOT BETWEEN 2000 AND 490000 HAVING count(*) > 0
UNION ALL SELECT 'date', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01' HAVING count(*) > 0
UNION ALL SELECT 'unique:o_orderkey', count(*), min(k) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'refers:o_custkey', count(*), min(CAST(o_custkey AS VARCHAR)) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 3) HAVING count(*) > 0"""


def order_findings(spark, d):
    """Places of an order, by key, at which the total falls against the next."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return checks.ordered(o, "orders", "o_orderkey", "o_totalprice").select("key")


ORDER_FINDINGS = "SELECT CAST(a.o_orderkey AS VARCHAR) AS key FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_totalprice > b.o_totalprice"


def receipts(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("idempotency_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    return artifacts.receipts(e)


RECEIPTS = "SELECT user_id AS idempotency_key, min(event_id) AS seq, arg_min(event_type, event_id) AS body, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1"


def shard_counts(spark, d):
    from ..functions.digests import project_id

    p = read(spark, d, "part").select(project_id(F.col("p_partkey").cast("string")).alias("id"), "p_name")
    return artifacts.shard_index(p).select("prefix", "records")


SHARD_COUNTS = "SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 2) AS prefix, count(*) AS records FROM part GROUP BY 1"


def form_bodies(spark, d):
    body = F.concat(F.lit("### Repository URL\n\n"), F.col("url"), F.lit("\n\n### Why it fits\n\n_No response_\n"))
    m = form_fields(body)
    return read(spark, d, "pages").select("page_id", m["repository_url"].alias("url"), m["why_it_fits"].alias("why"))


FORM_BODIES = "SELECT page_id, url, '' AS why FROM pages"


def text_sections(spark, d):
    """Whole documents as the body of a section between two others."""
    t = F.concat(F.lit("# Top\n\n## Summary\n"), F.col("text"), F.lit("\n### Inner\nx\n## Next\ny"))
    return read(spark, d, "documents").select("doc_id", F.md5(section(t, "Summary")).alias("md5"))


# a heading in a document itself would end the section: what is before the first one counts
TEXT_SECTIONS = r"""WITH x AS (SELECT doc_id, text || chr(10) || '### Inner' || chr(10) || 'x' AS t FROM documents)
SELECT doc_id, md5(trim(regexp_extract(t, '(?s)^(.*?)(?:\n#{1,2}[ \t]|\z)', 1), ' ' || chr(9) || chr(10) || chr(13))) AS md5 FROM x"""


def closest_titles(spark, d):
    """Best similarity between the title of a part in the list that cites it first and in others."""
    own = first(spark, d)
    one = own.groupBy("url").agg(F.min_by("title", "place").alias("t0"))
    titles = own.select("url", "title").distinct().join(one, "url")
    return titles.withColumn("s", title_similarity(F.col("t0"), F.col("title"), 0.6)).groupBy("url").agg(F.round(F.min("s"), 4).alias("least"), F.count("*").alias("titles"))


def run_fold(spark, d):
    """Users as runs of four kinds of events: started by the first, then candidates, pauses and resumptions as they come.
    A run is rejected at the first event that its state doesn't allow."""
    from pyspark.sql import Window as W

    e = read(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    sha = lambda x: F.sha2(x.cast("string"), 256)
    n = F.row_number().over(w)
    kind = F.when(n == 1, "started").when(F.col("event_type") == "purchase", "paused").when(F.col("event_type") == "error", "resumed").when(F.col("event_type") == "signup", "candidate").otherwise("checkpoint")
    start = F.to_json(F.struct(F.lit("standard").alias("profile"), F.lit("open-pr").alias("boundary"), F.lit("g").alias("goalRef"), F.lit("o").alias("owner")))
    go = F.to_json(F.struct(F.lit(True).alias("previousOwnerStopped"), F.lit("propose").alias("boundary"), F.lit("o2").alias("owner")))
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), n.alias("seq"), F.col("event_id").cast("string").alias("id"), F.lag(sha(F.col("event_id"))).over(w).alias("previous_digest"), sha(F.col("event_id")).alias("digest"), kind.alias("kind"), F.col("ts").cast("string").alias("timestamp"))
    gen = F.coalesce(F.sum(F.when(F.col("kind") == "resumed", 1).otherwise(0)).over(W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = F.when(F.col("kind") == "started", start).when(F.col("kind") == "resumed", go).when(F.col("kind") == "paused", '{"reason": "r"}').when(F.col("kind") == "candidate", F.to_json(F.struct(F.col("digest")))).otherwise("{}")
    rows = rows.withColumn("generation", gen.cast("long")).withColumn("payload", body)
    out = runs.next_action(runs.fold_runs(rows.withColumn("seq", F.col("seq").cast("long"))))
    return out.select("run_id", "status", "generation", "events", F.regexp_replace("rejected", "^[0-9]+: ", "").alias("rejected"), "next_action")


RUN_FOLD = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, n, CASE WHEN n = 1 THEN 's' WHEN event_type = 'purchase' THEN 'p' WHEN event_type = 'error' THEN 'r' WHEN event_type = 'signup' THEN 'c' ELSE 'k' END AS kind FROM o),
-- paused before an event: the last pause or resumption before it was a pause; then only checkpoints and resumptions are taken
q AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('p', 'r') THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'r') = 'p' AS stopped FROM k),
b AS (SELECT user_id, min(n) FILTER (stopped AND kind IN ('p', 'c')) AS bad, max(n) AS last FROM q GROUP BY user_id),
t AS (SELECT user_id, bad, count(*) FILTER (bad IS NULL OR n < bad) AS events, count(*) FILTER (kind = 'r' AND (bad IS NULL OR n < bad)) AS generation,
        arg_max(kind, n) FILTER (kind IN ('p', 'r') AND (bad IS NULL OR n < bad)) AS was FROM q JOIN b USING (user_id) GROUP BY user_id, bad)
SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN was = 'p' THEN 'paused' ELSE 'active' END AS status, generation, events,
  CASE WHEN bad IS NOT NULL THEN 'paused or blocked run requires recovery' END AS rejected, CASE WHEN bad IS NOT NULL THEN 'inspect-rejected-event' WHEN was = 'p' THEN 'inspect-recovery' ELSE 'freeze-contract' END AS next_action FROM t"""

NAMES = """outcome_metrics first_pass_rate run_windows retry_causes run_metrics recoveries usage_deltas usage_totals budget_admission journey_coverage lifecycle platform_rates rate_rows common_values kind_counts
evals_score authoritative_dups text_findings decision_modes branch_classes issue_decisions next_versions role_routes transitions constraint_findings order_findings receipts shard_counts form_bodies text_sections closest_titles run_fold""".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
