"""Queries of the validators and decision tables on the driver tables. Rows are broken on purpose, by their keys, so that
every rule has findings; SQL works the rules out again from the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, text, urls
from ..functions.digests import entries_digest, project_id
from ..operators import activity, checks, decisions, explore, governance, lists, network, process, projects
from .catalogue import _CITATIONS, NEAR, _PAIRS, citations, first, pairs, read


def pick(values, i: Column) -> Column:
    """The i-th of some values, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def found(df: DataFrame) -> DataFrame:
    return df.select("artifact", "rule", "key", "detail")


def _breaks(table: str, artifact: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{artifact}' AS artifact, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM {table} WHERE NOT coalesce({fine}, false)" for rule, fine in rules.items())


def _repeated(table: str, artifact: str, *columns: str) -> str:
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"SELECT '{artifact}' AS artifact, 'unique:{','.join(columns)}' AS rule, {key} AS key, CAST(count(*) AS VARCHAR) AS detail FROM {table} GROUP BY {', '.join(columns)} HAVING count(*) > 1"


def _dangling(table: str, artifact: str, column: str, others: str, other: str) -> str:
    return f"SELECT '{artifact}' AS artifact, 'refers:{column}' AS rule, CAST({column} AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {other} FROM {others})"


def _findings(table: str, key: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS key, '{severity}' AS severity, '{code}' AS code FROM {table} WHERE {bad}" for severity, code, bad in rules)


# --- artifacts of the catalogue -------------------------------------------------------------------------------------


def index_rows(spark, d) -> DataFrame:
    """Customers as rows of the index; every fortieth has the id of the one before."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        F.when(k % 40 == 7, k - 1).otherwise(k).cast("string").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("https://Example.org/"), F.col("c_name"), F.when(k % 2 == 0, "/").otherwise("")).alias("url"),
        pick(("eligible", "pending", "excluded", "new"), k % 4).alias("state"), (k % 3 != 0).alias("public"), F.floor(F.col("c_acctbal") / 10).cast("long").alias("stars"), (k % 9).alias("unique_links"),
        F.when(k % 5 != 0, F.col("c_nationkey") - 1).cast("long").alias("entry_count"), F.when(k % 2 == 0, F.concat(F.lit("lists/"), k)).alias("detail"),
        F.when(k % 8 == 0, "x").otherwise(F.substring(F.sha2("c_name", 256), 1, 40)).alias("revision"), F.sha2("c_name", 256).alias("readme_sha256"), F.lower("c_mktsegment").alias("description"),
    )


_INDEX = """x AS (SELECT CAST(CASE WHEN c_custkey % 40 = 7 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS id, c_name AS name, 'https://Example.org/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS url,
  (['eligible', 'pending', 'excluded', 'new'])[c_custkey % 4 + 1] AS state, c_custkey % 3 <> 0 AS public, CAST(floor(c_acctbal / 10) AS BIGINT) AS stars, c_custkey % 9 AS unique_links,
  CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey - 1 END AS entry_count, CASE WHEN c_custkey % 2 = 0 THEN 'lists/' || c_custkey END AS detail,
  CASE WHEN c_custkey % 8 = 0 THEN 'x' ELSE substr(sha256(c_name), 1, 40) END AS revision, sha256(c_name) AS readme_sha256, lower(c_mktsegment) AS description FROM customer)"""


def check_lists(spark, d):
    return found(checks.check_lists(index_rows(spark, d)))


CHECK_LISTS = f"WITH {_INDEX} " + _breaks("x", "lists", "id", {
    "state": "state IN ('eligible', 'pending', 'excluded')", "stars": "stars IS NULL OR stars >= 0", "entries": "entry_count IS NULL OR entry_count >= 0", "eligible": "state <> 'eligible' OR (public AND stars >= 100 AND unique_links >= 3)",
    "pinned": "detail IS NULL OR regexp_full_match(revision, '[a-f0-9]{40}')", "private": "public OR (detail IS NULL AND entry_count IS NULL)",
}) + " UNION ALL " + _repeated("x", "lists", "id")


def detail_rows(spark, d) -> DataFrame:
    """Orders as details of lists, their lines as entries; counts are wrong for some, and a few titles are empty."""
    li = read(spark, d, "lineitem").select("l_orderkey", F.struct(F.when(F.col("l_linenumber") % 50 == 6, "").otherwise(F.concat(F.lit("t"), F.col("l_partkey"))).alias("title"), F.col("l_suppkey").cast("string").alias("url")).alias("e"))
    k, rows = F.col("l_orderkey"), li.groupBy("l_orderkey").agg(F.collect_list("e").alias("entries"))
    n = F.size("entries").cast("long")
    distinct = F.size(F.array_distinct(F.transform("entries", lambda e: e["url"]))).cast("long")
    return rows.select(k.cast("string").alias("repository_id"), "entries", (n + F.when(k % 10 == 3, 1).otherwise(0)).alias("entry_count"), F.when(k % 7 == 1, n).otherwise(distinct).alias("unique_links"))


def check_details(spark, d):
    return found(checks.check_details(detail_rows(spark, d)))


CHECK_DETAILS = "WITH x AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_suppkey) AS u, bool_or(l_linenumber % 50 = 6) AS gap FROM lineitem GROUP BY 1) " + _breaks("x", "details", "k", {"entry_count": "k % 10 <> 3", "unique_links": "k % 7 <> 1 OR n = u", "titles": "NOT gap"})


def gathered(spark, d) -> DataFrame:
    return projects.projects(citations(spark, d).withColumn("url", F.col("url").cast("string")).withColumn("list_url", F.concat(F.lit("l"), F.col("list_id"))))


def project_rows(spark, d) -> DataFrame:
    own = gathered(spark, d)
    k = F.col("url").cast("long")
    return own.select(
        F.when(k % 20 == 1, project_id(F.lit("0"))).otherwise(F.col("id")).alias("id"), "url", "title", F.when(k % 25 == 2, "zz").otherwise(F.col("prefix")).alias("prefix"),
        (F.col("list_count") + F.when(k % 30 == 2, 1).otherwise(0)).alias("list_count"), (F.col("occurrence_count") - F.when(k % 35 == 2, 1).otherwise(0)).alias("occurrence_count"), "occurrences",
    )


_PROJECTS = f"""{_CITATIONS}, g AS (SELECT url AS k, CAST(url AS VARCHAR) AS url, count(*) AS n, count(DISTINCT list_id) AS u FROM c GROUP BY ALL),
x AS (SELECT k, url, n, u, CASE WHEN k % 20 = 1 THEN substr(sha256('0'), 1, 20) ELSE substr(sha256(url), 1, 20) END AS id, CASE WHEN k % 25 = 2 THEN 'zz' ELSE substr(sha256(url), 1, 2) END AS prefix FROM g),
r AS (SELECT x.id, c.list_id FROM x JOIN c ON c.url = x.k), e AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 2)"""


def check_projects(spark, d):
    known = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("public"), F.when(F.col("s_suppkey") % 5 == 2, "pending").otherwise("eligible").alias("state"))
    return found(checks.check_projects(project_rows(spark, d), known))


CHECK_PROJECTS = f"WITH {_PROJECTS} " + _breaks("x", "projects", "id", {"id": "id = substr(sha256(url), 1, 20)", "prefix": "prefix = substr(id, 1, 2)", "list_count": "k % 30 <> 2", "occurrence_count": "k % 35 <> 2"}) + " UNION ALL " + _repeated("x", "projects", "id") + " UNION ALL " + _repeated("x", "projects", "url") + " UNION ALL " + _dangling("r", "projects", "list_id", "e", "id")


def search_rows(spark, d) -> DataFrame:
    """Search records of projects: topics are those of the headings, independent counts the number of different titles."""
    own = gathered(spark, d)
    alone = first(spark, d).groupBy("url").agg(F.count_distinct(text.fast_title(F.col("title"))).alias("independent_list_count"))
    return projects.search_records(own, alone.select(project_id(F.col("url").cast("string")).alias("id"), (F.col("independent_list_count") * F.when(F.col("url") % 15 == 4, 9).otherwise(1)).alias("independent_list_count")), {"brand 12": "twelve", "brand 13": "none"})


def search_records(spark, d):
    return search_rows(spark, d).select("id", "url", "title", "list_count", "independent_list_count", F.array_join("topics", ",").alias("topics"))


_SEARCH = f"""{_CITATIONS}, t AS (SELECT url, count(DISTINCT lower(title)) * CASE WHEN url % 15 = 4 THEN 9 ELSE 1 END AS own FROM f GROUP BY url),
s AS (SELECT CAST(c.url AS VARCHAR) AS url, c.url AS k, arg_min(title, seq) AS title, count(DISTINCT list_id) AS list_count, any_value(category) AS category, any_value(own) AS own FROM c JOIN t ON t.url = c.url GROUP BY c.url),
x AS (SELECT substr(sha256(url), 1, 20) AS id, k, url, title, list_count, own, CASE WHEN category = 'Brand#12' THEN 'twelve' ELSE replace(lower(category), '#', '-') END AS topics FROM s)"""
SEARCH_RECORDS = f"WITH {_SEARCH} SELECT id, url, title, list_count, own AS independent_list_count, topics FROM x"


def check_search(spark, d):
    rows = search_rows(spark, d)
    known = rows.where(F.col("url").cast("long") % 11 != 5).select("id")
    k = F.col("url").cast("long")
    return found(checks.check_search(rows.withColumn("topics", F.when(k % 13 == 1, F.concat("topics", "topics")).otherwise(F.col("topics"))), known))


CHECK_SEARCH = f"WITH {_SEARCH}, z AS (SELECT id FROM x WHERE k % 11 <> 5) " + _breaks("x", "search", "id", {"independent": "own BETWEEN 1 AND list_count", "distinct": "k % 13 <> 1"}) + " UNION ALL " + _dangling("x", "search", "id", "z", "id")


def check_pairs(spark, d):
    rows = pairs(spark, d)
    broken = rows.select(F.when(F.col("b") % 6 == 1, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("b") % 6 == 1, F.col("a")).otherwise(F.col("b")).alias("b"), "shared", (F.col("jaccard") + F.when(F.col("a") % 7 == 3, 2).otherwise(0)).alias("jaccard"), "copy_fraction", "near_duplicate")
    return found(checks.check_pairs(broken, 6, **NEAR))


CHECK_PAIRS = f"""WITH {_PAIRS}, x AS (SELECT CASE WHEN b % 6 = 1 THEN b ELSE a END AS a, CASE WHEN b % 6 = 1 THEN a ELSE b END AS b, shared, jaccard + CASE WHEN a % 7 = 3 THEN 2 ELSE 0 END AS jaccard, copy_fraction, near_duplicate FROM q),
y AS (SELECT *, a || '|' || b AS k FROM x) """ + _breaks("y", "network", "k", {"order": "a < b", "shared": "shared >= 6", "range": "jaccard BETWEEN 0 AND 1 AND copy_fraction BETWEEN 0 AND 1", "near": "near_duplicate = (jaccard >= 0.15 AND copy_fraction >= 0.35)"})


def check_hubs(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    return found(checks.check_hubs(p.select(k.alias("id"), (k % 8).alias("list_count"), (k % 3).alias("independent_list_count"), F.when(k % 10 == 1, 0).otherwise(k % 8 - k % 3).alias("hub_discount"))))


CHECK_HUBS = "WITH x AS (SELECT p_partkey AS id, p_partkey % 8 AS l, p_partkey % 3 AS i, CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 8 - p_partkey % 3 END AS h FROM part) " + _breaks("x", "hubs", "id", {"discount": "h = l - i", "cited": "l >= 2"})


def check_alternatives(spark, d):
    """Lines of an order as alternatives of its first."""
    li = read(spark, d, "lineitem")
    own = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("url"), F.count("*").alias("total"))
    rows = li.join(own, "l_orderkey").select(F.col("l_orderkey").alias("list_id"), F.lit("c").alias("category"), F.col("url").cast("string").alias("url"), F.col("l_partkey").cast("string").alias("alternative"), F.col("total").alias("total_alternatives"), (F.col("l_orderkey") % 3 == 0).alias("truncated"))
    return found(checks.check_alternatives(rows))


CHECK_ALTERNATIVES = """WITH o AS (SELECT l_orderkey AS k, min(l_partkey) AS u, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT k || '|c|' || u AS id, k, n FROM o)
""" + _breaks("x", "alternatives", "id", {"cap": "n <= 3", "truncated": "(k % 3 = 0) = (n > n)"}) + " UNION ALL SELECT 'alternatives', 'itself', CAST(u AS VARCHAR), NULL FROM o JOIN lineitem ON l_orderkey = k AND l_partkey = u"  # fmt: skip


def _liveness(spark, d) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    url = F.concat(F.lit("https://github.com/"), F.lower("c_mktsegment"), F.lit("/r"), k)
    seen = F.when(k % 9 != 4, F.lit("2024-01-01T00:00:00Z"))
    n = (k % 8 - 1).alias("observed_count")
    return c.select(
        F.when(k % 12 == 5, "0").otherwise(project_id(url)).alias("id"), url.alias("url"), F.when(k % 10 == 3, "other").otherwise(F.lower("c_mktsegment")).alias("owner"), F.concat(F.lit("r"), k).alias("repo"), F.when(k % 11 != 2, k % 2 == 0).alias("archived"),
        F.struct(n, F.when(k % 3 == 0, F.lit("2024-01-01")).alias("latest_at"), F.when(k % 4 == 0, F.lit(2.5)).alias("median_interval_days")).alias("releases"), seen.alias("observed_at"), k.alias("k"),
    )


def check_liveness(spark, d):
    rows = _liveness(spark, d)
    return found(checks.check_liveness(rows, rows.where("k % 14 <> 6").select("id")))


CHECK_LIVENESS = """WITH x AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, 'https://github.com/' || lower(c_mktsegment) || '/r' || c_custkey AS url FROM customer),
y AS (SELECT *, CASE WHEN k % 12 = 5 THEN '0' ELSE substr(sha256(url), 1, 20) END AS id, k % 8 - 1 AS n FROM x), z AS (SELECT id FROM y WHERE k % 14 <> 6) """ + _breaks("y", "liveness", "id", {
    "repository": "k % 10 <> 3", "id": "id = substr(sha256(url), 1, 20)", "archived": "k % 11 <> 2", "count": "n BETWEEN 0 AND 5", "latest": "n > 0 OR k % 3 <> 0", "cadence": "n > 1 OR k % 4 <> 0", "observed": "k % 9 <> 4",
}) + " UNION ALL " + _repeated("y", "liveness", "id") + " UNION ALL " + _dangling("y", "liveness", "id", "z", "id")


def check_usage(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    one = lambda r, n: F.struct(r.alias("registry"), n.alias("count"))
    sources = F.when(k % 9 == 1, F.array().cast("array<struct<registry:string,count:bigint>>")).otherwise(F.array(one(pick(("npm", "pypi", "docker", "gem"), k % 4), k - 20), one(F.when(k % 6 == 0, "npm").otherwise("pypi"), F.when(k % 10 != 7, F.lit(5).cast("long")))))
    url = F.concat(F.lit("u"), k)
    return found(checks.check_usage(p.select(F.when(k % 15 == 2, "0").otherwise(project_id(url)).alias("id"), url.alias("url"), sources.alias("sources"))))


CHECK_USAGE = """WITH x AS (SELECT p_partkey AS k, 'u' || p_partkey AS url, p_partkey % 9 = 1 AS none, (['npm', 'pypi', 'docker', 'gem'])[p_partkey % 4 + 1] AS a, CASE WHEN p_partkey % 6 = 0 THEN 'npm' ELSE 'pypi' END AS b FROM part),
y AS (SELECT *, CASE WHEN k % 15 = 2 THEN '0' ELSE substr(sha256(url), 1, 20) END AS id FROM x) """ + _breaks("y", "usage", "id", {"id": "id = substr(sha256(url), 1, 20)", "registry": "none OR a <> 'gem'", "once": "none OR a <> b", "count": "none OR (k >= 20 AND k % 10 <> 7)", "sources": "NOT none"}) + " UNION ALL " + _repeated("y", "usage", "id")


def session_rows(spark, d) -> DataFrame:
    """Orders as sessions."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("id"), F.when(k % 21 == 4, "x").otherwise(k.cast("string")).alias("key"), pick(("pr", "rollup", "release", "other"), k % 4).alias("kind"), F.concat(F.lit("Order "), k).alias("title"), F.col("o_orderpriority").alias("summary"),
        F.when(k % 10 == 6, "").when(k % 10 == 5, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mergedAt"), F.lit("w1").alias("wave"), F.struct(F.when(k % 13 != 1, F.col("o_orderstatus")).alias("platform"), F.lit("e").alias("executor")).alias("harness"),
        F.struct(F.lit("standard").alias("workflowProfile"), F.lit("council").alias("mode"), F.when(k % 2 == 0, k % 3 == 0).alias("humanReviewRequired")).alias("sdlc"), F.struct(k.alias("prNumber"), F.lit("u").alias("prUrl"), F.when(k % 3 == 0, F.array(k)).alias("issues")).alias("repository"),
        F.struct(F.when(k % 4 != 0, k % 100).alias("testsPassed")).alias("verification"), F.when(k % 17 == 0, F.array((k + 1).cast("string"), F.lit("gone"))).alias("children"), F.col("o_custkey").alias("number"),
    )


_SESSIONS = """x AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, (['pr', 'rollup', 'release', 'other'])[o_orderkey % 4 + 1] AS kind, 'Order ' || o_orderkey AS title, o_orderpriority AS summary,
  CASE WHEN o_orderkey % 10 = 6 THEN '' WHEN o_orderkey % 10 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS merged, CASE WHEN o_orderkey % 13 <> 1 THEN o_orderstatus END AS platform FROM orders)"""


def check_sessions(spark, d):
    return found(checks.check_sessions(session_rows(spark, d)))


CHECK_SESSIONS = f"WITH {_SESSIONS}, h AS (SELECT unnest([CAST(k + 1 AS VARCHAR), 'gone']) AS child FROM x WHERE k % 17 = 0) " + _breaks("x", "sessions", "id", {"kind": "kind <> 'other'", "merged": "merged <> ''", "platform": "platform IS NOT NULL", "key": "k % 21 <> 4"}) + " UNION ALL " + _repeated("x", "sessions", "id") + " UNION ALL " + _dangling("h", "sessions", "child", "x", "id")


def session_timeline(spark, d):
    rows = process.timeline(session_rows(spark, d))
    return rows.select("id", "kind", "title", "summary", "mergedAt", "platform", "workflowProfile", "mode", "humanReviewRequired", "prNumber", F.size("issues").cast("long").alias("issues"), F.size("children").cast("long").alias("children"))


SESSION_TIMELINE = f"""WITH {_SESSIONS} SELECT id, kind, title, summary, merged AS "mergedAt", platform, 'standard' AS "workflowProfile", 'council' AS mode, k % 2 = 0 AND k % 3 = 0 AS "humanReviewRequired", k AS "prNumber", CAST(k % 3 = 0 AS BIGINT) AS issues, CAST(k % 17 = 0 AS BIGINT) * 2 AS children FROM x"""


def tests_over_time(spark, d):
    return process.tests_over_time(session_rows(spark, d))


TESTS_OVER_TIME = f"""WITH {_SESSIONS} SELECT merged AS date, id, title, k % 100 AS "testsPassed" FROM x WHERE k % 4 <> 0"""


def rollup_sessions(spark, d):
    one = governance.rollup_record(session_rows(spark, d).where("mergedAt <> ''"), "r-1", "Release", "2030-01-01")
    return one.select("id", "kind", "title", "mergedAt", F.md5(F.array_join("children", ",")).alias("children"), F.size("phasesRun").cast("long").alias("phases"))


ROLLUP_SESSIONS = f"""WITH {_SESSIONS} SELECT 'r-1' AS id, 'rollup' AS kind, 'Release' AS title, '2030-01-01' AS "mergedAt", md5(string_agg(id, ',' ORDER BY merged, id)) AS children, CAST(9 AS BIGINT) AS phases FROM x WHERE merged <> ''"""


def check_interpretations(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(F.when(k % 30 == 8, k - 1).otherwise(k).cast("string").alias("list_id"), pick(("high", "medium", "low", "sure"), k % 4).alias("confidence"), F.when(k % 3 == 0, "none").otherwise(F.lower("c_mktsegment")).alias("tag"), F.when(k % 10 != 9, "m").alias("model"))
    return found(checks.check_interpretations(rows, c.where("c_custkey % 5 <> 1").select(k.cast("string").alias("id")), ["building", "machinery", "furniture"]))


CHECK_INTERPRETATIONS = """WITH x AS (SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 30 = 8 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS list_id, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE lower(c_mktsegment) END AS tag FROM customer),
p AS (SELECT CAST(k AS VARCHAR) AS id FROM x WHERE k % 5 <> 1) """ + _breaks("x", "interpretations", "list_id", {"confidence": "k % 4 <> 3", "tag": "tag IN ('building', 'machinery', 'furniture', 'none')", "model": "k % 10 <> 9"}) + " UNION ALL " + _repeated("x", "interpretations", "list_id") + " UNION ALL " + _dangling("x", "interpretations", "list_id", "p", "id")


# --- lists and projects ---------------------------------------------------------------------------------------------


def repository_rows(spark, d):
    """Lines of orders as search hits of parts."""
    li, k = read(spark, d, "lineitem"), F.col("l_partkey")
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    hits = li.select(k.cast("string").alias("id"), F.concat(F.lit("o/"), k).alias("name"), F.concat(F.lit("u"), F.col("l_suppkey")).alias("url"), F.col("l_returnflag").alias("description"), (F.col("l_quantity") - 10).cast("long").alias("stars"), F.col("l_suppkey").alias("forks"), F.lit(None).cast("boolean").alias("archived"), order.alias("observed_at"))
    return lists.repository_rows(hits).select("id", "name", "url", "description", "stars", "forks", "archived", "public")


REPOSITORY_ROWS = """WITH x AS (SELECT CAST(l_partkey AS VARCHAR) AS id, 'o/' || l_partkey AS name, 'u' || l_suppkey AS url, l_returnflag AS description, CAST(l_quantity - 10 AS BIGINT) AS s, l_suppkey AS forks, l_orderkey * 10 + l_linenumber AS seen FROM lineitem),
y AS (SELECT *, CASE WHEN s >= 0 THEN s END AS stars FROM x)
SELECT id, name, url, description, stars, forks, CAST(NULL AS BOOLEAN) AS archived, true AS public FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen, name, url, description, stars NULLS FIRST, forks) = 1"""


def candidate_fields(spark, d):
    rows = index_rows(spark, d).withColumn("topics", F.array("description", F.lit("a")))
    details = detail_rows(spark, d).withColumn("entries", F.transform(F.array_sort(F.transform("entries", lambda e: e["title"])), lambda t: F.struct(t.alias("title"))))
    got = lists.candidate_fields(rows, details, 3)
    return got.select("id", "name", "description", F.array_join("topics", ",").alias("topics"), "stars", "entry_count", "unique_links", F.array_join("sample", ",").alias("sample"))


CANDIDATE_FIELDS = f"""WITH {_INDEX}, t AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, list_sort(list(CASE WHEN l_linenumber % 50 = 6 THEN '' ELSE 't' || l_partkey END))[1:3] AS s FROM lineitem GROUP BY 1)
SELECT id, name, description, 'a,' || description AS topics, stars, CAST(entry_count AS BIGINT) AS entry_count, unique_links, coalesce(array_to_string(s, ','), '') AS sample FROM x LEFT JOIN t USING (id) WHERE state = 'pending'"""


def published_repositories(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_custkey")
    name = F.format_string("Customer#%09d", k)
    asked = o.select("o_orderkey", F.concat(F.lit("HTTPS://example.org/"), F.when(F.col("o_orderkey") % 3 == 0, name).otherwise("none"), F.lit("//")).alias("url"), F.concat(F.lit("https://EXAMPLE.org/"), F.lower(name)).alias("parent_url"))
    return activity.published_repository(asked, index_rows(spark, d).dropDuplicates(["url"])).select("o_orderkey", "list_id")


PUBLISHED_REPOSITORIES = f"""WITH {_INDEX}, p AS (SELECT id, lower(rtrim(url, '/')) AS u FROM x WHERE public AND state = 'eligible'),
o AS (SELECT o_orderkey, 'https://example.org/customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS u FROM orders)
SELECT o_orderkey, id AS list_id FROM o LEFT JOIN p ON p.u = o.u"""


def entries_found(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("properties"))
    return explore.entries_where(rows, " Widget  #1", "ECONOMY").select("p_partkey")


ENTRIES_FOUND = "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name || ' ' || p_brand || ' ' || p_size), 'widget') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_size), '#1')"


def _resources(spark, d) -> DataFrame:
    one = lambda s, c: F.struct(s.alias("source"), c.alias("category"), F.concat(F.lit("T "), s).alias("title"), F.concat(F.lit("D "), c).alias("description"))
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.concat(F.lit("u/"), k).alias("url"), F.array(one(F.concat(F.lit("s"), k % 5), F.lower("p_type")), one(F.concat(F.lit("s"), k % 3), F.lit("other"))).alias("occurrences"))


def catalogue_search(spark, d):
    return explore.catalogue_search(_resources(spark, d), "Economy 1", "s1").select("p_partkey")


_TEXT = "lower(p_name || ' ' || p_brand || ' u/' || p_partkey || ' ' || lower(p_type) || ' other')"
CATALOGUE_SEARCH = f"SELECT p_partkey FROM part WHERE (p_partkey % 5 = 1 OR p_partkey % 3 = 1) AND contains({_TEXT}, 'economy') AND contains({_TEXT}, '1')"


def first_occurrences(spark, d):
    return explore.first_occurrence(_resources(spark, d), "s1", "All topics").select("p_partkey", "title", "description")


FIRST_OCCURRENCES = "SELECT p_partkey, 'T s1' AS title, CASE WHEN p_partkey % 5 = 1 THEN 'D ' || lower(p_type) ELSE 'D other' END AS description FROM part WHERE p_partkey % 5 = 1 OR p_partkey % 3 = 1"


def occurrences_by_list(spark, d):
    """Entries of details of eligible lists, numbered in index order by list."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    own = s.select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("u"), k).alias("url"), F.col("s_acctbal").alias("stars"), F.when(k % 4 == 1, "pending").otherwise("eligible").alias("state"), F.when(k % 6 != 5, F.concat(F.lit("d"), k)).alias("detail"))
    entry = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), F.col("l_partkey")).alias("title"), F.col("l_partkey").cast("string").alias("url"), F.col("l_returnflag").alias("category"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_url"))
    details = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(entry)).alias("entries")).select(F.concat(F.lit("d"), F.col("l_suppkey")).alias("detail"), "entries")
    got = projects.occurrences(own, details)
    return got.select("list_id", "list_name", "list_url", "title", "url", "category", "source_url", F.col("seq._i").cast("long").alias("place"))


OCCURRENCES_BY_LIST = """SELECT s_suppkey AS list_id, s_name AS list_name, 'u' || s_suppkey AS list_url, 'p' || l_partkey AS title, CAST(l_partkey AS VARCHAR) AS url, l_returnflag AS category, l_orderkey || '-' || l_linenumber AS source_url,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey, l_linenumber, 'p' || l_partkey, CAST(l_partkey AS VARCHAR), l_returnflag) - 1 AS place
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 4 <> 1 AND s_suppkey % 6 <> 5"""


def merged_records(spark, d):
    """Lines as older records of parts."""
    li = read(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").cast("string").alias("url"), F.concat(F.lit("t"), F.col("l_suppkey")).alias("title"), F.col("l_returnflag").alias("description"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), (F.col("l_orderkey") % 7).alias("line"), F.col("l_linestatus").alias("category"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").alias("seq"))
    return projects.merge_records(rows).select("id", "url", "title", "description", F.size("occurrences").cast("long").alias("occurrences"))


MERGED_RECORDS = """WITH x AS (SELECT CAST(l_partkey AS VARCHAR) AS url, 't' || l_suppkey AS title, l_returnflag AS description, l_suppkey AS s, l_orderkey % 7 AS line, l_linestatus AS category, (l_orderkey, l_linenumber, l_suppkey, l_returnflag) AS seq FROM lineitem)
SELECT substr(sha256(url), 1, 20) AS id, url, arg_min(title, seq) AS title, arg_min(description, seq) AS description, count(DISTINCT (s, line, title, description, category)) AS occurrences FROM x GROUP BY url"""


def best_evidence(spark, d):
    """The pair of citations behind each part's evidence; titles are of one name and three flags, so two similarities occur."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    links = s.select(k.alias("list_id"), F.concat(F.lit("l"), k).alias("list_url"), F.array(F.concat(F.lit("l"), k + 1)).alias("sources"))
    return network.best_evidence(first(spark, d), links).select("url", "similarity", "explicit", "list_a", "list_b", "category_match")


# pairs in their order, one after the other; titles are equal or differ in the last letter
BEST_EVIDENCE = f"""WITH {_CITATIONS}, o AS (SELECT url, list_id, 'Supplier ' || list_id AS name, arg_min(lower(title), (source_url, title)) AS t, arg_min(category, (source_url, title)) AS cat, min(source_url) AS src FROM c GROUP BY url, list_id),
p AS (SELECT a.url, (lower(a.name), a.src, a.list_id) AS pa, (lower(b.name), b.src, b.list_id) AS pb, CASE WHEN a.t = b.t THEN 1.0 ELSE 2.0 * (length(a.t) - 1) / (2.0 * length(a.t)) END AS s, abs(a.list_id - b.list_id) = 1 AS e, a.name AS la, b.name AS lb, a.cat = b.cat AS m
  FROM o a JOIN o b ON a.url = b.url AND (lower(a.name), a.src, a.list_id) < (lower(b.name), b.src, b.list_id)),
g AS (SELECT url, list({{'s': s, 'e': e, 'la': la, 'lb': lb, 'm': m}} ORDER BY pa, pb) AS ps FROM p GROUP BY url),
r AS (SELECT url, list_reduce(list_prepend({{'s': CAST(0 AS DOUBLE), 'e': false, 'la': '', 'lb': '', 'm': false}}, ps), lambda x, y: CASE WHEN y.e OR y.s > x.s THEN {{'s': round(y.s, 3), 'e': y.e, 'la': y.la, 'lb': y.lb, 'm': y.m}} ELSE x END) AS z FROM g)
SELECT url, z.s AS similarity, z.e AS explicit, z.la AS list_a, z.lb AS list_b, z.m AS category_match FROM r"""


# --- process records ------------------------------------------------------------------------------------------------


def council_seats(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("request_id"), pick(("architect", "developer", "tester", "analyst", "owner"), k % 5).alias("owner"), F.when(k % 3 == 0, strings("docs", "api")).otherwise(strings("api")).alias("surfaces"), (k % 4 == 0).alias("public_contract"))
    return decisions.council_seats(rows)


COUNCIL_SEATS = """WITH o AS (SELECT o_orderkey AS k, (['architect', 'developer', 'tester', 'analyst', 'owner'])[o_orderkey % 5 + 1] AS owner FROM orders),
s(role, focus, required, need) AS (VALUES ('architect', 'architecture and system boundaries', true, 'all'), ('developer', 'implementation feasibility', true, 'all'), ('tester', 'testability and failure evidence', true, 'all'), ('reviewer', 'risk and maintainability', true, 'all'),
  ('analyst', 'requirements and contract semantics', true, 'contract'), ('technical-writer', 'documentation and onboarding impact', false, 'docs'))
SELECT k AS request_id, role, focus, required FROM o, s WHERE role <> owner AND (need = 'all' OR (need = 'contract' AND k % 4 = 0) OR (need = 'docs' AND k % 3 = 0))"""


def provider_bindings(spark, d):
    """Orders ask suppliers of their kind (key modulo 6) for facets."""
    k = F.col("o_orderkey")
    facets = lambda x: F.filter(F.array(F.when(x % 2 == 0, "read"), F.when(x % 3 == 0, "write"), F.when(x % 5 == 0, "run")), lambda f: f.isNotNull())
    asked = read(spark, d, "orders").select(k.alias("intent_id"), (k % 6).alias("kind"), facets(k).alias("required"), F.when(k % 7 == 0, strings("write", "run")).otherwise(strings()).alias("optional"), (k % 11 == 0).alias("manual"))
    s = read(spark, d, "supplier").where("s_suppkey % 6 <> 4")
    given = s.select(F.col("s_name").alias("provider"), (F.col("s_suppkey") % 6).alias("kind"), facets(F.col("s_suppkey") + 3).alias("facets"), F.col("s_suppkey").alias("place"))
    return decisions.bind_provider(asked, given)


_FACETS = "list_filter([CASE WHEN {0} % 2 = 0 THEN 'read' END, CASE WHEN {0} % 3 = 0 THEN 'write' END, CASE WHEN {0} % 5 = 0 THEN 'run' END], lambda f: f IS NOT NULL)"
PROVIDER_BINDINGS = f"""WITH i AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind, {_FACETS.format('o_orderkey')} AS req, CASE WHEN o_orderkey % 7 = 0 THEN ['write', 'run'] ELSE [] END AS opt FROM orders),
p AS (SELECT s_name, s_suppkey AS place, s_suppkey % 6 AS kind, {_FACETS.format('(s_suppkey + 3)')} AS f FROM supplier WHERE s_suppkey % 6 <> 4),
m AS (SELECT k, s_name, place, list_filter(req, lambda r: NOT list_contains(f, r)) AS lacks, opt FROM i JOIN p USING (kind)),
r AS (SELECT k, s_name, place, CASE WHEN len(lacks) = 0 THEN 0 WHEN len(list_filter(lacks, lambda l: NOT list_contains(opt, l))) = 0 THEN 1 END AS rank FROM m),
b AS (SELECT k, min(rank) AS rank, arg_min(s_name, (rank, place)) FILTER (rank IS NOT NULL) AS s FROM r GROUP BY k)
SELECT i.k AS intent_id, s AS provider, CASE rank WHEN 0 THEN 'bound' WHEN 1 THEN 'degraded' ELSE CASE WHEN i.k % 11 = 0 THEN 'manual' ELSE 'blocked' END END AS status FROM i LEFT JOIN b USING (k)"""


def execution_targets(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    asked = o.select("o_orderkey", F.when(k % 10 == 1, "a").alias("requested"), F.when(k % 5 == 2, "b").alias("configured"), F.when(k % 4 == 3, "c").alias("current"), F.col("o_orderpriority").alias("model"))
    return decisions.execution_target(asked, [("URGENT$", "fast"), ("^[123]-", "usual")]).select("o_orderkey", "target", "basis")


EXECUTION_TARGETS = """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'a' END AS r, CASE WHEN o_orderkey % 5 = 2 THEN 'b' END AS f, CASE WHEN o_orderkey % 4 = 3 THEN 'c' END AS c,
  CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'fast' WHEN o_orderpriority SIMILAR TO '[123]-.*' THEN 'usual' END AS m FROM orders)
SELECT o_orderkey, coalesce(r, f, c, m) AS target, CASE WHEN r IS NOT NULL THEN 'explicit' WHEN f IS NOT NULL THEN 'configured' WHEN c IS NOT NULL THEN 'self' WHEN m IS NOT NULL THEN 'model' ELSE 'clarification' END AS basis FROM x"""


def pack_states(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    return decisions.registry(p.select((k - F.when(k % 9 == 1, 1).otherwise(0)).cast("string").alias("pack_id"), F.col("p_name").alias("path"), F.when(k % 4 != 0, k % 3 != 0).alias("enabled"), (k % 5).alias("errors"))).select("pack_id", "path", "state")


PACK_STATES = """WITH x AS (SELECT CAST(p_partkey - CASE WHEN p_partkey % 9 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS pack_id, p_name AS path, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 <> 0 ELSE true END AS enabled, p_partkey % 5 AS errors FROM part)
SELECT pack_id, path, CASE WHEN count(*) OVER (PARTITION BY pack_id) > 1 THEN 'duplicate' WHEN NOT enabled THEN 'disabled' WHEN errors > 0 THEN 'invalid' ELSE 'valid' END AS state FROM x"""


def boundary_ranks(spark, d):
    o = read(spark, d, "orders")
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    other = read(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderpriority").alias("child"))
    return o.join(other, "o_orderkey").select("o_orderkey", decisions.rank_allows(F.col("o_orderpriority"), F.col("child"), order).alias("allowed"))


BOUNDARY_RANKS = "SELECT a.o_orderkey, a.o_orderpriority <> '5-LOW' AND b.o_orderpriority <> '5-LOW' AND b.o_orderpriority <= a.o_orderpriority AS allowed FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"


def bounded_paths(spark, d):
    path = F.concat_ws("/", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("f.py"))
    return read(spark, d, "part").select("p_partkey", decisions.bounded_path(path, ["gizmo", "promo/"], ["small/old/bolt/f.py"], ["economy/"], ["/red/", "/cold/"]).alias("bounded"))


BOUNDED_PATHS = """WITH x AS (SELECT p_partkey, lower(p_type) || '/' || replace(p_name, ' ', '/') || '/f.py' AS p FROM part)
SELECT p_partkey, NOT (contains(p, 'gizmo') OR contains(p, 'promo/')) AND (p = 'small/old/bolt/f.py' OR starts_with(p, 'economy/') OR contains(p, '/red/') OR contains(p, '/cold/')) AS bounded FROM x"""


def link_outcomes(spark, d):
    return read(spark, d, "part").select("p_partkey", decisions.status_outcome(F.when(F.col("p_partkey") % 10 != 0, 196 + 8 * (F.col("p_partkey") % 30))).alias("outcome"))


LINK_OUTCOMES = "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN 196 + 8 * (p_partkey % 30) END AS s FROM part) SELECT p_partkey, CASE WHEN s IN (404, 410) THEN 'dead' WHEN s BETWEEN 200 AND 399 THEN 'alive' ELSE 'queued' END AS outcome FROM x"


def attribution_findings(spark, d):
    """Orders as claims, their lines as rows of attribution."""
    li, k, n = read(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    claims = read(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % 3 != 0).alias("multi_agent"), F.when(F.col("o_orderstatus") == "P", "high-assurance").otherwise("standard").alias("profile"), F.when(F.col("o_orderkey") % 2 == 0, "said").otherwise(" ").alias("disclosure"))
    rows = li.select(
        k.alias("claim_id"), pick(("developer", "review", "tester", "cook"), n % 4).alias("role"), F.col("l_returnflag").alias("planned"), F.when(n % 5 == 4, "").otherwise(F.col("l_linestatus")).alias("actual"), pick(("worktree", "moon"), F.col("l_partkey") % 2).alias("context"),
        pick(("independent", "self-review", "maybe"), F.col("l_partkey") % 3).alias("independence"), pick(("pass", "blocked: why", "open"), F.col("l_suppkey") % 3).alias("status"),
    )
    return governance.attribution(rows, claims, ["A", "N", "O", "F"])


ATTRIBUTION_FINDINGS = """WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'high-assurance' ELSE 'standard' END AS profile, o_orderkey % 2 = 0 AS said FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT l_orderkey AS id, (['developer', 'review', 'tester', 'cook'])[l_linenumber % 4 + 1] AS role, l_returnflag AS planned, CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE l_linestatus END AS actual, l_partkey % 2 = 1 AS moon,
  (['independent', 'self-review', 'maybe'])[l_partkey % 3 + 1] AS ind, l_suppkey % 3 AS st FROM lineitem WHERE l_orderkey IN (SELECT id FROM k)),
g AS (SELECT id, count(*) AS n, count(DISTINCT nullif(actual, '')) AS agents, min(actual) FILTER (role = 'developer') AS dev, min(actual) FILTER (role = 'review') AS rev, min(ind) FILTER (role = 'review') AS ri FROM r GROUP BY id),
c AS (SELECT k.id, profile, said, n, agents, dev = rev AS same, ri = 'self-review' AND said AS disclosed, ri FROM k LEFT JOIN g USING (id)) """ + _findings("r", "id", [
    ("low", "attribution.role", "role = 'cook'"), ("high", "attribution.planned", "planned NOT IN ('A', 'N', 'O', 'F')"), ("high", "attribution.actual", "actual = ''"), ("high", "attribution.context", "moon"), ("high", "attribution.independence", "ind = 'maybe'"), ("high", "attribution.status", "st = 2"),
]) + " UNION ALL " + _findings("c", "id", [
    ("high", "attribution.rows", "n IS NULL"), ("high", "attribution.agents", "agents < 2"), ("high", "attribution.self-review", "same AND NOT coalesce(disclosed, false)"), ("high", "attribution.high-assurance", "same AND disclosed AND profile = 'high-assurance'"), ("high", "attribution.not-self-review", "NOT same AND ri = 'self-review'"),
])


def evidence_findings(spark, d):
    """Orders as records of collaboration, with up to three helpers and a loop."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    helper = lambda i: F.struct(F.when((k + i) % 6 != 0, "r").alias("role"), pick(("advisor", "writer", "human-gate"), (k + i) % 3).alias("permissions"), F.when((k + i) % 5 != 0, "e").alias("executor"), F.lit("t").alias("transport"), ((k + i) % 4 == 0).alias("single_writer"))
    helpers = F.when(k % 4 != 0, F.slice(F.array(helper(0), helper(1), helper(2)), F.lit(1), (k % 4).cast("int")))
    loop = F.array(F.struct((k % 3).alias("max_iterations"), F.when(k % 5 != 1, strings("s")).otherwise(strings()).alias("stop_conditions"), F.when(k % 7 != 2, "done").otherwise(" ").alias("exit_reason")))
    rows = o.select(k.alias("id"), pick(("single-agent", "council", "spike", "parallel-discovery", "mob"), k % 5).alias("mode"), F.when(k % 8 != 3, "why").alias("reason"), F.when(k % 9 != 4, "all").alias("synthesis"), F.when(k % 10 != 5, k % 2 == 0).alias("local_only"), helpers.alias("helpers"), F.when(k % 6 != 1, loop).alias("loops"))
    return governance.collaboration_evidence(rows, ("single-agent", "council", "spike", "parallel-discovery"))


EVIDENCE_FINDINGS = """WITH a AS (SELECT o_orderkey AS k, (['single-agent', 'council', 'spike', 'parallel-discovery', 'mob'])[o_orderkey % 5 + 1] AS mode, o_orderkey % 4 AS n, [o_orderkey + i for i in range(0, o_orderkey % 4)] AS h FROM orders),
x AS (SELECT *, len(list_filter(h, lambda j: j % 3 = 1)) AS writers FROM a) """ + _findings("x", "k", [
    ("high", "evidence.mode", "mode = 'mob'"), ("high", "evidence.reason", "k % 8 = 3"), ("high", "evidence.helpers", "mode <> 'single-agent' AND n = 0"), ("high", "evidence.two-helpers", "mode IN ('council', 'parallel-discovery') AND n < 2"), ("high", "evidence.writers", "writers > 1"),
    ("high", "evidence.writer-mode", "writers = 1 AND mode <> 'spike'"), ("high", "evidence.role", "len(list_filter(h, lambda j: j % 6 = 0)) > 0"), ("low", "evidence.executor", "len(list_filter(h, lambda j: j % 3 <> 2 AND j % 5 = 0)) > 0"),
    ("high", "evidence.single-writer", "len(list_filter(h, lambda j: j % 3 = 1 AND j % 4 <> 0)) > 0"), ("high", "evidence.synthesis", "n > 0 AND k % 9 = 4"), ("low", "evidence.local", "n > 0 AND (k % 10 = 5 OR k % 2 = 1)"),
    ("high", "evidence.iterations", "k % 6 <> 1 AND k % 3 = 0"), ("high", "evidence.stop", "k % 6 <> 1 AND k % 5 = 1"), ("high", "evidence.exit", "k % 6 <> 1 AND k % 7 = 2"),
])


def signal_findings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    states = ("observed", "proposed", "triaged", "accepted", "rejected", "lost")
    return governance.signals(o.select(k.alias("id"), pick(states, k % 6).alias("state"), pick(states, (k / 6).cast("long") % 6).alias("previous"), F.when(k % 5 != 0, "s").otherwise(" ").alias("summary"), pick(("analyst", "developer"), k % 2).alias("triage_role"), F.when(k % 7 != 0, "g").alias("goal_ref"), pick(("analyst", "developer", "tester"), k % 3).alias("next_role")))


SIGNAL_FINDINGS = """WITH x AS (SELECT o_orderkey AS k, (['observed', 'proposed', 'triaged', 'accepted', 'rejected', 'lost'])[o_orderkey % 6 + 1] AS s, (['observed', 'proposed', 'triaged', 'accepted', 'rejected', 'lost'])[(o_orderkey // 6) % 6 + 1] AS p FROM orders) """ + _findings("x", "k", [
    ("high", "signal.state", "s = 'lost'"), ("high", "signal.summary", "k % 5 = 0"), ("high", "signal.transition", "s <> 'observed' AND (p, s) NOT IN (('observed', 'proposed'), ('proposed', 'triaged'), ('triaged', 'accepted'), ('triaged', 'rejected'))"),
    ("high", "signal.triage", "s IN ('triaged', 'accepted', 'rejected') AND k % 2 = 1"), ("high", "signal.goal", "s = 'accepted' AND k % 7 = 0"), ("high", "signal.route", "k % 3 = 1"),
])


def handoff_findings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    states = ("proposed", "ready", "accepted", "completed", "blocked", "lost")
    some = lambda m: F.when(k % m == 0, strings()).when(k % m != 1, strings("x"))
    return governance.handoffs(o.select(k.alias("id"), pick(states, k % 6).alias("state"), pick(states, (k / 6).cast("long") % 6).alias("previous"), pick(("pr-readiness", "technical-writer", "developer"), k % 3).alias("source_role"), F.when(k % 5 != 0, "o").alias("external_owner"), F.when(k % 4 == 0, "r").alias("rollback_ref"), F.when(k % 7 == 0, "why").alias("rollback_reason"), some(8).alias("artifacts"), some(9).alias("validations")))


HANDOFF_FINDINGS = """WITH a AS (SELECT o_orderkey AS k, (['proposed', 'ready', 'accepted', 'completed', 'blocked', 'lost'])[o_orderkey % 6 + 1] AS s, (['proposed', 'ready', 'accepted', 'completed', 'blocked', 'lost'])[(o_orderkey // 6) % 6 + 1] AS p FROM orders),
x AS (SELECT *, s IN ('ready', 'accepted', 'completed') AS r FROM a) """ + _findings("x", "k", [
    ("high", "handoff.state", "s = 'lost'"), ("high", "handoff.transition", "s <> 'proposed' AND (p, s) NOT IN (('proposed', 'ready'), ('ready', 'accepted'), ('accepted', 'completed'), ('proposed', 'blocked'), ('ready', 'blocked'), ('accepted', 'blocked'))"), ("high", "handoff.owner", "r AND k % 5 = 0"),
    ("high", "handoff.source", "r AND k % 3 = 2"), ("high", "handoff.rollback", "r AND k % 4 <> 0 AND k % 7 <> 0"), ("high", "handoff.artifacts", "r AND k % 8 < 2"), ("high", "handoff.validations", "r AND k % 9 < 2"),
])


def issue_findings(spark, d):
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    body = F.concat(F.when(k % 2 == 0, "## acceptance  criteria\n").otherwise(""), F.coalesce("text", F.lit("")))
    labels = F.filter(F.array(F.when(k % 3 == 0, "bug"), F.when(k % 5 == 0, "status:done"), F.when(k % 7 == 0, "documentation")), lambda x: x.isNotNull())
    b, own = F.col("body"), F.col("labels")
    return governance.issues(docs.select(k.alias("id"), body.alias("body"), labels.alias("labels")), ["bug", "feature"], ["status:", "phase:"], decisions.release_impact(b, own), decisions.release_assignment(b, own, F.lit("open"), F.lit(None).cast("string")))


_IMPACT = """CASE WHEN regexp_matches(body, '(?i)no release impact|internal-only') THEN 'none' WHEN regexp_matches(body, '(?i)docs-only|documentation') OR list_contains(labels, 'documentation') THEN 'docs-only'
  WHEN regexp_matches(body, '(?i)breaking|major') THEN 'major' WHEN regexp_matches(body, '(?i)feature|minor') OR list_contains(labels, 'feature') THEN 'minor' WHEN regexp_matches(body, '(?i)bug|fix|patch') OR list_contains(labels, 'bug') THEN 'patch' ELSE 'unknown' END"""
_CANDIDATE = r"nullif(regexp_extract(body, '(?i)(?:target release|release|version)\s*:?\s*(v\d+\.\d+\.\d+(?:[-+][\w.-]+)?)', 1), '')"
ISSUE_FINDINGS = f"""WITH a AS (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN '## acceptance  criteria' || chr(10) ELSE '' END || coalesce(text, '') AS body, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'bug' END, CASE WHEN doc_id % 5 = 0 THEN 'status:done' END, CASE WHEN doc_id % 7 = 0 THEN 'documentation' END], lambda l: l IS NOT NULL) AS labels FROM documents),
x AS (SELECT *, {_IMPACT} AS impact, {_CANDIDATE} AS candidate FROM a) """ + _findings("x", "k", [
    ("high", "issue.labels.type", "k % 3 <> 0"), ("blocker", "issue.labels.forbidden", "k % 5 = 0"), ("medium", "issue.acceptance", r"NOT regexp_matches(body, '(?i)##\s+Acceptance criteria')"), ("medium", "issue.release.assignment", "impact NOT IN ('none', 'unknown') AND candidate IS NULL"),
])


def manifest_findings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    case = lambda i, n: F.struct(F.lit(i).alias("id"), F.array(F.lit("contains"), n).alias("kinds"))
    cases = F.when(k % 6 == 0, F.array().cast("array<struct<id:string,kinds:array<string>>>")).when(k % 6 != 1, F.array(case("a", F.lit("regex")), case("b", F.when(k % 4 == 0, "magic").otherwise("json-valid"))))
    cases = F.when(k % 5 == 2, F.concat(cases, F.array(case("a", F.lit("regex"))))).otherwise(cases)
    return governance.manifests(o.select(k.alias("id"), F.when(k % 9 != 4, (k % 13) / 10).alias("threshold"), cases.alias("cases")))


MANIFEST_FINDINGS = "WITH x AS (SELECT o_orderkey AS k, o_orderkey % 6 > 1 AS own FROM orders) " + _findings("x", "k", [("high", "eval.threshold", "k % 9 = 4 OR k % 13 > 10"), ("high", "eval.cases", "k % 6 = 1 OR (k % 6 = 0 AND k % 5 <> 2)"), ("high", "eval.unique", "own AND k % 5 = 2"), ("high", "eval.kinds", "own AND k % 4 = 0")])


def observation_findings(spark, d):
    e, k = read(spark, d, "events"), F.col("event_id")
    one = lambda i, m: F.struct(F.lit(i).alias("id"), F.when(k % m == 0, "fail").otherwise("pass").alias("outcome"))
    rows = e.select(
        k.alias("id"), F.col("user_id").alias("candidate"), F.when(k % 6 != 0, F.col("user_id")).alias("wanted_candidate"), F.lit("d").alias("definition"), F.when(k % 8 == 0, "e").otherwise("d").alias("wanted_definition"), pick(("collector-observed", "external-resolved", "said"), k % 3).alias("origin"),
        F.when(F.col("value") > 20, "pass").otherwise("fail").alias("outcome"), F.when(k % 4 != 1, k % 5 != 1).alias("source_verified"), F.when(k % 20 != 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("completed_at"),
        F.when(k % 9 != 2, F.array(one("a", 7), one("b", 11))).alias("assertions"), F.when(k % 10 == 0, strings()).otherwise(strings("a", "b")).alias("required"),
    )
    return governance.observations(rows, "2024-01-20 00:00:00", 10 * 86_400_000)


OBSERVATION_FINDINGS = """WITH x AS (SELECT event_id AS k, value, CASE WHEN event_id % 20 <> 3 THEN date_trunc('second', ts) END AS seen FROM events) """ + _findings("x", "k", [
    ("high", "observation.required", "k % 10 = 0"), ("high", "observation.source", "k % 4 = 1 OR k % 5 = 1"), ("high", "observation.candidate", "k % 6 = 0"), ("high", "observation.definition", "k % 8 = 0"), ("high", "observation.origin", "k % 3 = 2"), ("high", "observation.outcome", "NOT value > 20"),
    ("high", "observation.assertions", "k % 10 <> 0 AND (k % 9 = 2 OR k % 7 = 0 OR k % 11 = 0)"), ("high", "observation.age", "seen IS NULL OR seen > TIMESTAMP '2024-01-20' OR seen < TIMESTAMP '2024-01-10'"),
])


def council_findings(spark, d):
    """Orders as councils of three seats, their lines as advice."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    sha = lambda x: F.sha2(x.cast("string"), 256)
    seat = lambda r, q: F.struct(F.lit(r).alias("role"), F.lit(q).alias("required"))
    requests = read(spark, d, "orders").select(k.alias("request_id"), sha(k).alias("digest"), pick(("r1", "r9"), k % 2).alias("owner"), F.array(seat("r1", True), seat("r2", True), seat("r3", False)).alias("seats"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("digest"), sha(F.col("l_orderkey") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)).alias("request_digest"), F.concat(F.lit("r"), n).alias("role"), F.array(F.struct(F.lit("o1").alias("id"), (F.col("l_suppkey") % 3 == 0).alias("blocking"))).alias("objections"))
    given = li.groupBy("request_id").agg(F.sort_array(F.collect_list("digest")).alias("all"))
    one = lambda x: F.struct(x.alias("advice_digest"), F.lit("o1").alias("objection_id"), F.when(F.col("request_id") % 4 == 0, "ignored").otherwise("accepted").alias("disposition"), F.lit("why").alias("reason"))
    r = F.col("request_id")
    synthesis = given.where(r % 7 != 0).select("request_id", sha(r + F.when(r % 8 == 0, 1).otherwise(0)).alias("request_digest"), F.when(r % 9 == 0, "open").otherwise("complete").alias("status"), F.when(r % 5 == 0, F.slice("all", 1, 1)).otherwise(F.col("all")).alias("advice_digests"), F.transform(F.when(r % 6 == 0, F.slice("all", 1, 1)).otherwise(F.col("all")), one).alias("dispositions"))
    return governance.council(requests, li, synthesis)


COUNCIL_FINDINGS = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r9' END AS owner FROM orders),
a AS (SELECT l_orderkey AS k, 'r' || l_linenumber AS role, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS digest, l_partkey % 10 = 0 AS stale, l_suppkey % 3 = 0 AS blocking FROM lineitem),
g AS (SELECT k, list_sort(list(digest)) AS every FROM a GROUP BY k),
w AS (SELECT o.k, every, CASE WHEN o.k % 5 = 0 THEN every[1:1] ELSE every END AS named, every IS NOT NULL AND o.k % 7 <> 0 AS has FROM o LEFT JOIN g USING (k)),
s(role, required) AS (VALUES ('r1', true), ('r2', true), ('r3', false)),
p AS (SELECT k, CASE WHEN k % 6 = 0 THEN every[1:1] ELSE every END AS settled FROM g WHERE k % 7 <> 0),
q AS (SELECT k, unnest(settled) AS digest FROM p),
n AS (SELECT k, digest, count(*) AS n FROM q GROUP BY ALL)
SELECT o.k AS key, 'high' AS severity, 'council.missing' AS code FROM o, s WHERE required AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = o.k AND a.role = s.role)
UNION ALL SELECT a.k, 'high', 'council.uninvited' FROM a JOIN o USING (k) WHERE a.role NOT IN ('r1', 'r2', 'r3') OR a.role = o.owner
UNION ALL SELECT k, 'high', 'council.twice' FROM a GROUP BY k, role HAVING count(*) > 1
UNION ALL SELECT k, 'high', 'council.stale-advice' FROM a WHERE stale
UNION ALL SELECT a.k, 'high', 'council.objection' FROM a LEFT JOIN n USING (k, digest) WHERE blocking AND (n IS NULL OR n <> 1 OR a.k % 4 = 0)
UNION ALL SELECT k, 'high', 'council.incomplete' FROM w WHERE NOT has OR k % 9 = 0
UNION ALL SELECT k, 'high', 'council.stale-synthesis' FROM w WHERE NOT has OR k % 8 = 0
UNION ALL SELECT k, 'high', 'council.digests' FROM w WHERE coalesce(CASE WHEN has THEN named END, []) <> coalesce(every, [])"""


def delivery_checks(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    need = lambda i, m: F.struct(F.lit(i).alias("id"), (k % m != 0).alias("required"), F.when(k % 10 == 7, "judged").otherwise("deterministic").alias("verification"))
    got = lambda i, m: F.struct(F.lit(i).alias("id"), F.when(k % m == 1, "fail").otherwise("pass").alias("status"), (k % 17).alias("evidence"))
    rows = o.select(
        k.alias("delivery_id"), F.when(k % 31 == 1, "draft").otherwise("issued").alias("handoff_state"), F.lit("h").alias("handoff_digest"), F.lit("c").alias("handoff_contract"), F.when(k % 29 == 2, "x").otherwise("h").alias("bound_handoff"), F.when(k % 23 != 3, "c").alias("contract_digest"), F.lit("c").alias("bound_contract"),
        F.lit("dev").alias("delivery_role"), F.when(k % 19 == 4, "qa").otherwise("dev").alias("producer_role"), F.lit("s").alias("candidate"), F.lit("s").alias("bound_candidate"), F.lit("submitted").alias("delivery_status"), F.array(need("a", 3), need("b", 4)).alias("criteria"), F.array(got("a", 5), got("b", 6)).alias("results"),
    )
    got_ = governance.deliveries(rows)
    return got_.select("delivery_id", "status", F.array_join(F.transform(F.filter("checks", lambda c: ~c["pass"]), lambda c: c["id"]), ",").alias("failed"))


DELIVERY_CHECKS = """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 10 = 7 AS judged FROM orders),
y AS (SELECT *, list_filter([CASE WHEN k % 31 = 1 THEN 'handoff-valid' END, CASE WHEN k % 23 = 3 THEN 'handoff-contract' END, CASE WHEN k % 29 = 2 THEN 'handoff-binding' END, CASE WHEN k % 23 = 3 THEN 'contract-binding' END, CASE WHEN k % 19 = 4 THEN 'role-binding' END,
  CASE WHEN NOT judged AND k % 3 <> 0 AND (k % 5 = 1 OR k % 17 = 0) THEN 'criterion:a' END, CASE WHEN NOT judged AND k % 4 <> 0 AND (k % 6 = 1 OR k % 17 = 0) THEN 'criterion:b' END], lambda f: f IS NOT NULL) AS f FROM x)
SELECT k AS delivery_id, CASE WHEN len(f) > 0 THEN 'fail' WHEN judged AND (k % 3 <> 0 OR k % 4 <> 0) THEN 'semantic-review-required' ELSE 'pass' END AS status, array_to_string(f, ',') AS failed FROM y"""


def acceptance_pairs(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("platform"), F.when(F.col("event_id") % 2 == 0, "qa").otherwise("dev").alias("from_role"), F.when(F.col("event_id") % 3 == 0, "qa").otherwise("dev").alias("to_role"), F.when(F.col("value") > 10, "pass").otherwise("fail").alias("status"))
    return governance.acceptance_pairs(rows, "signup", "error")


ACCEPTANCE_PAIRS = """WITH x AS (SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'qa' ELSE 'dev' END AS f, CASE WHEN event_id % 3 = 0 THEN 'qa' ELSE 'dev' END AS t, value > 10 AS ok FROM events WHERE event_type IN ('signup', 'error')),
g AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'error') AS b, min(t) FILTER (event_type = 'signup') AS t, min(f) FILTER (event_type = 'error') AS f, bool_and(ok) AS ok FROM x GROUP BY user_id)
SELECT user_id AS subject, a = 1 AND b = 1 AND t = f AND ok AS ok FROM g"""


def evidence_latest(spark, d):
    """Users' last event of each type as evidence of a criterion."""
    e = read(spark, d, "events")
    criteria = e.select(F.col("user_id").alias("run_id")).distinct().crossJoin(spark.createDataFrame([("purchase",), ("error",), ("none",)], "criterion string")).withColumn("definition", F.lit("d")).withColumn("candidate", F.lit("c"))
    seen = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("criterion"), F.when(F.col("event_id") % 10 == 0, "old").otherwise("d").alias("definition"), F.lit("c").alias("candidate"), F.when(F.col("value") > 30, "pass").otherwise("fail").alias("outcome"), F.md5("props").alias("digest"), F.col("ts"), F.col("event_id"))
    return process.latest_evidence(criteria, seen, ("ts", "event_id")).select("run_id", "criterion", "outcome", "digest")


EVIDENCE_LATEST = """WITH l AS (SELECT user_id, event_type, arg_max(CASE WHEN value > 30 THEN 'pass' ELSE 'fail' END, (ts, event_id)) AS outcome, arg_max(md5(props), (ts, event_id)) AS digest FROM events WHERE event_id % 10 <> 0 GROUP BY ALL),
c AS (SELECT DISTINCT user_id, unnest(['purchase', 'error', 'none']) AS criterion FROM events)
SELECT c.user_id AS run_id, criterion, coalesce(outcome, 'missing') AS outcome, digest FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.event_type = criterion"""


def latency_stats(spark, d):
    got = process.latency_stats(read(spark, d, "events").withColumn("bad", F.col("event_type") == "error"), "value", "bad")
    return got.select("calls", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "largest", "failure_rate")


LATENCY_STATS = """SELECT count(*) AS calls, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, round(median(value) FILTER (event_type <> 'error'), 6) AS median, min(value) FILTER (event_type <> 'error') AS least, max(value) FILTER (event_type <> 'error') AS largest,
  round(avg(CAST(event_type = 'error' AS INTEGER)), 4) AS failure_rate FROM events"""


def status_tally(spark, d):
    return process.tally(read(spark, d, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


STATUS_TALLY = """SELECT count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders"""


def sealed_records(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("body"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("extra"))
    return process.seal(e, "note").select("event_id", "type", "version", "digest")


SEALED_RECORDS = """SELECT event_id, 'note' AS type, 1 AS version, sha256('{"body":"' || event_type || '","event_id":' || event_id || CASE WHEN event_id % 3 = 0 THEN ',"extra":' || user_id ELSE '' END || ',"type":"note","version":1}') AS digest FROM events"""


def broken_seals(spark, d):
    sealed = process.seal(read(spark, d, "events").select("event_id", F.col("event_type").alias("body")), "note")
    late = F.col("event_id") % 5 == 0
    return process.broken_seals(sealed.withColumn("body", F.when(late, F.concat("body", F.lit("!"))).otherwise(F.col("body"))).withColumn("digest", F.when(F.col("event_id") % 7 != 0, F.col("digest")))).select("event_id")


BROKEN_SEALS = "SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0"


def conforming_records(spark, d):
    e, k = read(spark, d, "events"), F.col("event_id")
    json = F.when(k % 10 == 3, "{bad").when(k % 10 == 4, F.to_json(F.struct(F.lit("x").alias("n"), F.col("event_type").alias("kind")))).otherwise(F.to_json(F.struct(k.alias("n"), F.col("event_type").alias("kind"))))
    got = process.conforms(e.select("event_id", json.alias("json")), "json", "n bigint, kind string", {"kind": ["view", "click", "error"]})
    return got.select("event_id", F.col("parsed.n").alias("n"), F.col("parsed.kind").alias("kind"))


CONFORMING_RECORDS = "WITH x AS (SELECT event_id, event_type, event_id % 10 NOT IN (3, 4) AND event_type IN ('view', 'click', 'error') AS ok FROM events) SELECT event_id, CASE WHEN ok THEN event_id END AS n, CASE WHEN ok THEN event_type END AS kind FROM x"


def merged_settings(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    base = F.create_map(F.lit("a"), F.array(F.col("o_orderstatus"), F.lit("z")), F.lit("b"), strings("q"))
    patch = F.create_map(F.lit("a"), F.array(F.lit("z"), F.col("o_orderpriority")), F.lit("c"), F.array(k.cast("string")))
    m = governance.merged_maps(base, patch)
    return o.select("o_orderkey", *(F.array_join(m[x], ",").alias(x) for x in "abc"))


MERGED_SETTINGS = "SELECT o_orderkey, o_orderstatus || ',z,' || o_orderpriority AS a, 'q' AS b, CAST(o_orderkey AS VARCHAR) AS c FROM orders"


def usage_mentions(spark, d):
    """Metadata of packages against repositories named in several ways."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("R"), k)
    said = F.when(k % 5 == 0, F.concat(F.lit("git+ssh://git@github.com/Own/"), name, F.lit(".git"))).when(k % 5 == 1, F.concat(F.lit("github:own/"), F.lower(name))).when(k % 5 == 2, F.concat(F.lit("https://GitHub.com/OWN/"), name, F.lit("/tree/x"))).when(k % 5 == 3, F.concat(F.lit("https://gitlab.com/own/"), name)).otherwise(F.lit("github.com/own/none"))
    return p.select("p_partkey", urls.refers_to(said, F.lit("own"), F.when(k % 7 == 0, "other").otherwise(name)).alias("same"))


USAGE_MENTIONS = "SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) AND p_partkey % 7 <> 0 AS same FROM part"


def usage_sources(spark, d):
    """Lines as packages of three registries that name the repository of their part."""
    li = read(spark, d, "lineitem")
    own = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("o").alias("owner"), F.concat(F.lit("r"), F.col("p_partkey")).alias("repo"))
    packages = li.select(pick(("npm", "pypi", "docker"), F.col("l_suppkey") % 3).alias("registry"), F.concat_ws("-", F.lit("k"), "l_orderkey", "l_linenumber").alias("package"), F.col("l_quantity").cast("long").alias("count"), F.lit("downloads").alias("metric"), F.concat(F.lit("https://github.com/O/"), F.when(F.col("l_linenumber") == 1, "none").otherwise(F.concat(F.lit("R"), F.col("l_partkey")))).alias("repository"))
    got = activity.usage_records(own, packages).select("id", F.explode("sources").alias("s"))
    return got.select("id", "s.registry", "s.package", "s.count")


USAGE_SOURCES = """WITH x AS (SELECT CAST(l_partkey AS VARCHAR) AS id, (['npm', 'pypi', 'docker'])[l_suppkey % 3 + 1] AS registry, 'k-' || l_orderkey || '-' || l_linenumber AS package, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_linenumber <> 1)
SELECT id, registry, arg_max(package, (n, package)) AS package, max(n) AS count FROM x GROUP BY id, registry"""


def normal_titles(spark, d):
    p = read(spark, d, "part").withColumn("raw", F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t \n"), F.col("p_type"), F.lit(" ")))
    return p.select("p_partkey", text.normalize_title(F.col("raw")).alias("folded"), text.fast_title(F.col("raw")).alias("fast"), text.number(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 1009)).alias("said"))


NORMAL_TITLES = "SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS folded, lower(p_name) || ' ' || lower(p_type) AS fast, CASE WHEN p_partkey % 3 <> 0 THEN format('{:,}', p_partkey * 1009) ELSE 'Unknown' END AS said FROM part"


def qualifying_sources(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", classify.qualifies(F.when(k % 9 != 0, F.col("o_totalprice")), k % 4 != 0, F.when(k % 7 != 0, k % 3 != 0)).alias("ok"))


QUALIFYING_SOURCES = "SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_totalprice >= 50000 AND o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS ok FROM orders"


def distinct_topics(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))).alias("x"))
    return own.select("l_orderkey", F.array_join(text.distinct_topics(F.transform("x", lambda v: F.concat(F.lit("The "), v["p_type"])), 2), ",").alias("topics"))


DISTINCT_TOPICS = """WITH x AS (SELECT l_orderkey, lower(p_type) AS t, min((l_linenumber, l_partkey, p_type)) AS place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS r FROM x) SELECT l_orderkey, string_agg(t, ',' ORDER BY r) AS topics FROM y WHERE r <= 2 GROUP BY 1"""


def folder_digests(spark, d):
    """Lines of an order as files: their digest whatever the order they come in."""
    li = read(spark, d, "lineitem").select("l_orderkey", F.struct(F.format_string("f%03d-%06d-%06d", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("path"), F.col("l_returnflag").alias("content")).alias("e"))
    return li.groupBy("l_orderkey").agg(entries_digest(F.collect_list("e")).alias("digest"))


FOLDER_DIGESTS = r"""WITH x AS (SELECT l_orderkey, format('f{:03}-{:06}-{:06}', l_linenumber, l_partkey, l_suppkey) AS p, l_returnflag AS c FROM lineitem)
SELECT l_orderkey, sha256(string_agg(p || chr(0) || c || chr(0), '' ORDER BY p, c)) AS digest FROM x GROUP BY 1"""

NAMES = """check_lists check_details check_projects search_records check_search check_pairs check_hubs check_alternatives check_liveness check_usage check_sessions session_timeline tests_over_time rollup_sessions check_interpretations
repository_rows candidate_fields published_repositories entries_found catalogue_search first_occurrences occurrences_by_list merged_records best_evidence council_seats provider_bindings execution_targets pack_states boundary_ranks bounded_paths
link_outcomes attribution_findings evidence_findings signal_findings handoff_findings issue_findings manifest_findings observation_findings council_findings delivery_checks acceptance_pairs evidence_latest latency_stats status_tally
sealed_records broken_seals conforming_records merged_settings usage_mentions usage_sources normal_titles qualifying_sources distinct_topics folder_digests""".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
