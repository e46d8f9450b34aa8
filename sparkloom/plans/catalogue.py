"""Queries of the catalogue operators on the driver tables.

One analogy throughout: a list is a supplier, a project a part, a citation a row of lineitem, a heading a brand, a title
the part's name with the return flag, stars the account balance in whole units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classify, dates, digests, text, urls
from ..functions.similarity import ratio_of
from ..operators import activity, alternatives, explore, insights, network, projects

AS_OF = "2001-08-01 00:00:00"
NEAR = {"near_jaccard": 0.15, "near_copy": 0.35}  # so that the tables have both kinds of pairs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences: url, list_id, list_name, title, category, source_url, seq."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), "p_name", F.col("p_brand").alias("category"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("list_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    seq = F.struct("l_orderkey", "l_linenumber", "url", "list_id", "l_quantity", "l_extendedprice", "l_shipdate")
    return rows.join(part, "url").select(
        "url", "list_id", F.concat(F.lit("Supplier "), F.col("list_id")).alias("list_name"), F.concat_ws(" ", "p_name", "l_returnflag").alias("title"), "category",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_url"), seq.alias("seq"),
    )


_CITATIONS = """c AS (SELECT l_partkey AS url, l_suppkey AS list_id, p_name || ' ' || l_returnflag AS title, p_brand AS category, l_orderkey || '-' || l_linenumber AS source_url,
  (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT url, list_id, arg_min(title, (source_url, title)) AS title FROM c GROUP BY url, list_id)"""


def same_title(a, b):
    return a == b


def project_dedup(spark, d):
    return projects.project_counts(citations(spark, d))


PROJECT_DEDUP = f"WITH {_CITATIONS} SELECT url, arg_min(title, seq) AS title, count(DISTINCT list_id) AS list_count, count(*) AS occurrence_count FROM c GROUP BY url"


def first(spark, d):
    return projects.first_by_list(citations(spark, d))


def pairs(spark, d):
    return network.list_pairs(first(spark, d), same=same_title, **NEAR)


def list_pair_overlap(spark, d):
    return pairs(spark, d)


_PAIRS = f"""{_CITATIONS},
n AS (SELECT list_id, count(*) AS n FROM f GROUP BY list_id),
o AS (SELECT a.list_id AS a, b.list_id AS b, count(*) AS shared, count(*) FILTER (lower(a.title) = lower(b.title)) AS m FROM f a JOIN f b ON a.url = b.url AND a.list_id < b.list_id GROUP BY ALL HAVING count(*) >= 5),
p AS (SELECT a, b, shared, round(shared / (x.n + y.n - shared), 4) AS jaccard, round(m / shared, 4) AS copy_fraction FROM o JOIN n x ON x.list_id = a JOIN n y ON y.list_id = b),
q AS (SELECT *, jaccard >= 0.15 AND copy_fraction >= 0.35 AS near_duplicate FROM p)"""
LIST_PAIR_OVERLAP = f"WITH {_PAIRS} SELECT * FROM q"


def _with_text_ids(rows):
    return rows.withColumn("a", F.col("a").cast("string")).withColumn("b", F.col("b").cast("string"))


def neighbours(spark, d):
    return network.neighbours(_with_text_ids(pairs(spark, d)), "1").select("neighbor", "shared", "jaccard", "copy_fraction", "near_duplicate")


_NEAR = """v AS (SELECT CASE WHEN a = 1 THEN CAST(b AS VARCHAR) WHEN b = 1 THEN CAST(a AS VARCHAR) END AS neighbor, shared, jaccard, copy_fraction, near_duplicate FROM q),
w AS (SELECT * FROM v WHERE neighbor IS NOT NULL ORDER BY jaccard DESC, shared DESC, neighbor LIMIT 15)"""
NEIGHBOURS = f"WITH {_PAIRS}, {_NEAR} SELECT * FROM w"


def ego_network(spark, d):
    return network.ego_network(_with_text_ids(pairs(spark, d)), "1")


EGO_NETWORK = f"""WITH {_PAIRS}, {_NEAR},
z AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, shared, jaccard, copy_fraction, near_duplicate FROM q)
SELECT '1' AS a, neighbor AS b, shared, jaccard, copy_fraction, near_duplicate FROM w
UNION ALL SELECT * FROM z WHERE a IN (SELECT neighbor FROM w) AND b IN (SELECT neighbor FROM w)"""


def counts(spark, d):
    """Independent citations where copies are equal titles: their components are the different titles."""
    own = first(spark, d).groupBy("url").agg(F.count("*").alias("list_count"), F.count_distinct(text.fast_title(F.col("title"))).alias("independent_list_count"))
    return own.join(read(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title")), "url").withColumn("id", digests.project_id(F.col("url").cast("string")))


_COUNTS = f"{_CITATIONS}, k AS (SELECT url, count(*) AS list_count, count(DISTINCT lower(title)) AS independent_list_count, substr(sha256(CAST(url AS VARCHAR)), 1, 20) AS id FROM f GROUP BY url)"


def hub_topk(spark, d):
    return network.hubs(counts(spark, d)).select("id", "url", "list_count", "independent_list_count", "hub_discount")


HUB_TOPK = f"WITH {_COUNTS} SELECT id, url, list_count, independent_list_count, list_count - independent_list_count AS hub_discount FROM k WHERE list_count >= 2 ORDER BY independent_list_count DESC, list_count DESC, id DESC LIMIT 100"


def independent_citations(spark, d):
    """By components, as for titles that are merely similar; edges join each title's lists to the smallest of them."""
    own = first(spark, d).withColumn("t", text.fast_title(F.col("title")))
    least = own.groupBy("url", "t").agg(F.min("list_id").alias("b"))
    edges = own.join(least, ["url", "t"]).where("list_id <> b").select("url", F.col("list_id").alias("a"), "b")
    return network.independent_counts(own, edges)


INDEPENDENT_CITATIONS = f"WITH {_COUNTS} SELECT url, list_count, independent_list_count FROM k"


def citation_labels(spark, d):
    lists, own = F.col("list_count"), F.col("independent_list_count")
    return counts(spark, d).select("url", classify.citation_kind(lists, own).alias("kind"), F.length(classify.citation_text(lists, own)).alias("n_text"))


CITATION_LABELS = f"""WITH {_COUNTS}, x AS (SELECT *, CASE WHEN list_count <= 1 THEN 'single' WHEN independent_list_count >= 2 THEN 'independent' ELSE 'raw-only' END AS kind FROM k)
SELECT url, kind, CAST(length(CASE kind WHEN 'single' THEN 'Listed in 1 source.'
  WHEN 'independent' THEN 'Cited independently by ' || independent_list_count || ' of ' || list_count || ' listed sources (sibling/copy-lineage citations discounted; see methodology).'
  ELSE 'Listed in ' || list_count || ' sources (citation text is shared/copy-lineage across them; not shown as an independence signal -- see methodology).' END) AS INTEGER) AS n_text FROM x"""


def alternatives_topk(spark, d):
    return alternatives.alternatives(citations(spark, d)).drop("alternative_title")


ALTERNATIVES_TOPK = f"""WITH {_CITATIONS},
m AS (SELECT list_id, category, url, arg_min(title, seq) AS t FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY list_id, category ORDER BY lower(t), url) AS r, count(*) OVER (PARTITION BY list_id, category) AS n FROM m),
x AS (SELECT m.list_id, m.category, m.url, m.n, o.url AS alternative, row_number() OVER (PARTITION BY m.list_id, m.category, m.url ORDER BY o.r) AS rank
      FROM r m LEFT JOIN r o ON o.list_id = m.list_id AND o.category = m.category AND o.r <= 4 AND o.url <> m.url)
SELECT list_id, category, url, alternative, CASE WHEN alternative IS NOT NULL THEN rank END AS rank, n - 1 AS total_alternatives,
       n - 1 > least(3, count(alternative) OVER (PARTITION BY list_id, category, url)) AS truncated FROM x WHERE rank <= 3"""


def alternative_counts(spark, d):
    return alternatives.alternative_counts(alternatives.alternatives(citations(spark, d)))


ALTERNATIVE_COUNTS = f"SELECT url, count(DISTINCT alternative) AS alternative_count FROM ({ALTERNATIVES_TOPK}) GROUP BY url"


def search_records(spark, d):
    part = read(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.lower("p_type"), F.lower("p_brand")).alias("topics"))


def search_projects(spark, d):
    return projects.search(search_records(spark, d), "Small ri conomy").select("id", "title", "score")


SEARCH_PROJECTS = """WITH r AS (SELECT p_partkey AS id, p_name AS title, lower(p_name) AS n, lower(p_type || ' ' || p_brand) AS t FROM part),
s AS (SELECT id, title, 10 * contains(n, 'small ri conomy')::INT + 3 * (contains(n, 'small')::INT + contains(n, 'ri')::INT + contains(n, 'conomy')::INT) + contains(t, 'small')::INT + contains(t, 'ri')::INT + contains(t, 'conomy')::INT AS score
      FROM r WHERE contains(n || ' ' || t, 'small') AND contains(n || ' ' || t, 'ri') AND contains(n || ' ' || t, 'conomy'))
SELECT id, title, CAST(score AS BIGINT) AS score FROM s ORDER BY score DESC, lower(title), id LIMIT 50"""


def lists(spark, d):
    """Suppliers as lists: entry_count is unknown for those with a balance below zero, freshness that of the last order."""
    supplier, nation = read(spark, d, "supplier"), read(spark, d, "nation")
    li = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    fresh = dates.freshness(F.col("last"), F.lit("2001-11-20 00:00:00"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(li, "s_suppkey", "left").withColumn("f", fresh)
    stars = F.floor("s_acctbal")
    return rows.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("scope"), F.col("n_name").alias("description"), F.array("n_name").alias("topics"), F.array().cast("array<string>").alias("github_topics"),
        (F.col("s_suppkey") % 7 != 0).alias("public"), F.when(stars >= 100, "eligible").otherwise("pending").alias("state"), stars.alias("stars"), (F.col("s_suppkey") % 5 == 0).alias("archived"), F.lit(False).alias("is_fork"),
        F.when(stars >= 0, F.col("n")).alias("entry_count"), F.col("f.range").alias("fresh_range"), F.col("f.days").alias("fresh_days"), F.col("f.index").alias("fresh_index"),
    )


_LISTS = """i AS (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY ALL),
g AS (SELECT s_suppkey AS id, s_name AS name, n_name AS topic, s_suppkey % 7 <> 0 AS public, CAST(floor(s_acctbal) AS BIGINT) AS stars, s_suppkey % 5 = 0 AS archived, CASE WHEN floor(s_acctbal) >= 0 THEN n END AS entry_count,
        CASE WHEN last IS NOT NULL THEN greatest(0.0, (epoch_us(TIMESTAMP '2001-11-20') - epoch_us(last)) / 86400000000.0) END AS age FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN i ON l_suppkey = s_suppkey),
l AS (SELECT *, CASE WHEN stars >= 100 THEN 'eligible' ELSE 'pending' END AS state, CAST(floor(age) AS INTEGER) AS fresh_days,
        CASE WHEN age IS NULL THEN 'Unknown' WHEN age <= 30 THEN 'Within 30 days' WHEN age <= 90 THEN 'Within 90 days' WHEN age <= 180 THEN 'Within 180 days' WHEN age <= 365 THEN 'Within 365 days' ELSE 'Older than a year' END AS fresh_range FROM g)"""


def freshness(spark, d):
    at = dates.freshness(F.col("o_orderdate"), F.lit("2000-06-01 12:00:00"))
    return read(spark, d, "orders").select("o_orderkey", at.alias("f")).select("o_orderkey", "f.days", "f.range", "f.index")


FRESHNESS = """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN greatest(0.0, (epoch_us(TIMESTAMP '2000-06-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0) END AS age FROM orders)
SELECT o_orderkey, CAST(floor(age) AS INTEGER) AS days, round(100 * pow(2.0, -age / 180), 1) AS index,
  CASE WHEN age IS NULL THEN 'Unknown' WHEN age <= 30 THEN 'Within 30 days' WHEN age <= 90 THEN 'Within 90 days' WHEN age <= 180 THEN 'Within 180 days' WHEN age <= 365 THEN 'Within 365 days' ELSE 'Older than a year' END AS range FROM a"""


def discover_filter(spark, d):
    state = {"q": "supplier nation", "min_stars": 500, "archived": "Active only", "freshness": "Within 180 days", "sort": "Most indexed entries"}
    return explore.page(explore.discover(lists(spark, d), explore.bind(state)), 2).select("id", "name", "stars", "entry_count")


DISCOVER_FILTER = f"""WITH {_LISTS} SELECT id, name, stars, entry_count FROM l
WHERE public AND stars >= 500 AND state = 'eligible' AND NOT archived AND fresh_range IN ('Within 30 days', 'Within 90 days', 'Within 180 days') AND contains(lower(name || ' ' || topic), 'supplier') AND contains(lower(name || ' ' || topic), 'nation')
ORDER BY entry_count DESC NULLS LAST, lower(name), id LIMIT 12 OFFSET 12"""


def dashboard_kpis(spark, d):
    return insights.dashboard(lists(spark, d).where("public"))


DASHBOARD_KPIS = f"""WITH {_LISTS} SELECT count(*) AS population, CAST(coalesce(sum(entry_count), 0) AS BIGINT) AS total_entries, count(entry_count) AS entries_known, count(*) - count(entry_count) AS entries_unknown,
CAST(round_even(median(stars), 0) AS BIGINT) AS median_stars, count(*) FILTER (fresh_range = 'Within 30 days') AS fresh_30, count(fresh_days) AS freshness_known, count(*) - count(fresh_days) AS freshness_unknown FROM l WHERE public"""


def topic_counts(spark, d):
    return insights.topic_counts(lists(spark, d))


TOPIC_COUNTS = f"WITH {_LISTS} SELECT topic, count(*) AS lists FROM l WHERE topic IS NOT NULL GROUP BY topic"


def freshness_counts(spark, d):
    return insights.freshness_counts(lists(spark, d))


FRESHNESS_COUNTS = f"WITH {_LISTS} SELECT fresh_range AS label, count(*) AS lists FROM l GROUP BY ALL"


def histogram_stars(spark, d):
    return insights.histogram(lists(spark, d), "stars", classify.STAR_BUCKETS, unknown=False)


def _bucket_sql(value: str, buckets) -> str:
    cases = " ".join(f"WHEN {value} >= {low} THEN '{label}'" for label, low in reversed(buckets))
    ranks = " ".join(f"WHEN '{label}' THEN {i}" for i, (label, _) in enumerate(buckets))
    return f"WITH {_LISTS}, h AS (SELECT CASE {cases} ELSE 'Unknown' END AS label FROM l) SELECT label, count(*) AS n, CAST(CASE label {ranks} ELSE {len(buckets)} END AS BIGINT) AS rank FROM h"


HISTOGRAM_STARS = _bucket_sql("stars", classify.STAR_BUCKETS) + " WHERE label <> 'Unknown' GROUP BY label"


def histogram_entries(spark, d):
    return insights.histogram(lists(spark, d), "entry_count", classify.ENTRY_BUCKETS, unknown=True)


HISTOGRAM_ENTRIES = _bucket_sql("entry_count", classify.ENTRY_BUCKETS) + " GROUP BY label"


def compare_lists(spark, d):
    return insights.compare(lists(spark, d), [3, 3, 7, 2, 5, 4, 1]).select("place", "id", "name", "stars", "entry_count")


COMPARE_LISTS = f"WITH {_LISTS}, w(place, id) AS (VALUES (0, 3), (1, 7), (2, 2), (3, 5)) SELECT CAST(place AS BIGINT) AS place, l.id, name, stars, entry_count FROM w JOIN l ON l.id = w.id WHERE public AND state = 'eligible'"


def liveness_bucket(spark, d):
    o = read(spark, d, "orders")
    b = dates.liveness_bucket(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")), F.lit("2000-01-01 06:00:00"))
    return o.select("o_orderkey", b.alias("b")).select("o_orderkey", "b.bucket", "b.label", "b.days")


LIVENESS_BUCKET = """WITH a AS (SELECT o_orderkey, o_orderpriority <> '5-LOW' AS known, o_orderstatus = 'P' AS arch, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor((epoch_us(TIMESTAMP '2000-01-01 06:00:00') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) END AS dd FROM orders),
b AS (SELECT *, CASE WHEN NOT known THEN 'none' WHEN arch THEN 'archived' WHEN dd IS NULL THEN 'quiet' WHEN dd <= 90 THEN 'active' WHEN dd <= 365 THEN 'slowing' ELSE 'stale' END AS k FROM a)
SELECT o_orderkey, CASE k WHEN 'none' THEN 'unknown' WHEN 'quiet' THEN 'unknown' ELSE k END AS bucket,
  CASE k WHEN 'none' THEN 'Not yet observed' WHEN 'archived' THEN 'Archived by its owner' WHEN 'quiet' THEN 'No push activity observed' WHEN 'active' THEN 'Active' WHEN 'slowing' THEN 'Slowing down' ELSE 'Inactive' END AS label,
  CASE WHEN k IN ('active', 'slowing', 'stale') THEN dd END AS days FROM b"""


def release_cadence(spark, d):
    return activity.release_cadence(read(spark, d, "orders"), "o_custkey", "o_orderdate")


RELEASE_CADENCE = """WITH g AS (SELECT o_custkey, o_orderdate, floor((epoch_us(o_orderdate) - epoch_us(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC))) / 86400000000.0) AS gap FROM orders)
SELECT o_custkey, count(*) AS observed_count, max(o_orderdate) AS latest_at, median(gap) AS median_interval_days FROM g GROUP BY o_custkey"""


def project_360(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    li = read(spark, d, "lineitem")
    live = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("last"))
    used = li.where("l_linestatus = 'O' AND l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("n"))
    other = li.where("l_discount > 0.09").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    p = projects.profile(part, live, used, other)
    return p.select("id", "title", F.col("liveness.last").alias("last"), F.col("usage.n").alias("used"), F.col("alternatives.n").alias("alternatives"))


PROJECT_360 = """SELECT p_partkey AS id, p_name AS title, last, used, alternatives FROM part
LEFT JOIN (SELECT l_partkey AS k, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity) AS used FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45 GROUP BY 1) b ON b.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, count(*) AS alternatives FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) c ON c.k = p_partkey"""


def snapshot_diff(spark, d):
    """Two generations of orders: some are missing from either, some have another status in the second."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 13 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "F").otherwise(F.col("o_orderstatus")))
    return insights.snapshot_diff(o.where("o_orderkey % 13 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


SNAPSHOT_DIFF = """WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 13 <> 0),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'F' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 13 <> 1)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
  b.s AS o_orderstatus_before, a.s AS o_orderstatus_after, b.p AS o_orderpriority_before, a.p AS o_orderpriority_after
FROM b FULL JOIN a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p"""


def upsert_merge(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return projects.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0 OR event_id % 5 = 0").withColumn("value", F.col("value") + 1), "event_id")


UPSERT_MERGE = """SELECT event_id, user_id, event_type, value + 1 AS value FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0
UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0"""


def candidate_topn(spark, d):
    had = read(spark, d, "lineitem").where("l_discount = 0.1").select(F.col("l_partkey").alias("url")).distinct()
    return projects.candidates(project_dedup(spark, d), had, 40, key="url", by="occurrence_count", tie="url").select("url", "occurrence_count")


CANDIDATE_TOPN = """SELECT l_partkey AS url, count(*) AS occurrence_count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"""


def stale_records(spark, d):
    """Documents whose digest isn't that of the record made from them; every fourth record is of another text."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    had = docs.where("id % 3 <> 0").withColumn("digest", F.when(F.col("id") % 4 == 0, F.lit("old")).otherwise(F.col("digest")))
    return projects.stale(docs, had, "id", "digest")


STALE_RECORDS = "SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0"


def stride_sample(spark, d):
    return projects.stride_sample(read(spark, d, "customer").select("c_custkey", "c_name"), 30, "c_custkey")


STRIDE_SAMPLE = """WITH n AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
SELECT c_custkey, c_name FROM n WHERE i % greatest(1, n // 30) = 0 ORDER BY i LIMIT 30"""


def work_queue(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("stars"))
    done = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return projects.work_queue(o, done, 50).select("id", F.col("batch").cast("long").alias("batch"))


WORK_QUEUE = "SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 50 AS batch FROM orders WHERE o_orderstatus <> 'F'"


def merged_candidates(spark, d):
    li = read(spark, d, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    hits = li.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("query"), seq.alias("seq"), "l_orderkey")
    m = activity.merged_candidates(hits, columns=("l_orderkey",))
    return m.select("id", F.col("first.l_orderkey").alias("l_orderkey"), F.array_join("queries", ",").alias("queries"))


MERGED_CANDIDATES = "SELECT l_partkey AS id, min(l_orderkey) AS l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS queries FROM lineitem GROUP BY 1"


def reconcile_partitions(spark, d):
    """Pages of a search by month of shipping: totals are reported right except in every fifth month."""
    li = read(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_orderkey")
    n = li.groupBy("month").agg(F.count_distinct("id").alias("n"))
    hits = li.join(n, "month").withColumn("total", F.col("n") + F.when((F.substring("month", 6, 2).cast("int") % 5 == 0) & (F.col("l_orderkey") % 2 == 0), 1).otherwise(0))
    return activity.reconcile(hits, "month", "id", "total")


RECONCILE_PARTITIONS = """WITH l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey FROM lineitem),
n AS (SELECT month, count(DISTINCT id) AS n FROM l GROUP BY 1),
h AS (SELECT month, id, n + CASE WHEN CAST(substr(month, 6, 2) AS INT) % 5 = 0 AND l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS total FROM l JOIN n USING (month))
SELECT month, count(*) AS received, count(DISTINCT id) AS unique_ids, count(DISTINCT total) AS totals, CASE WHEN count(DISTINCT total) = 1 AND count(DISTINCT id) = max(total) THEN 'reconciled' ELSE 'unresolved' END AS state FROM h GROUP BY month"""


def top_contributors(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return activity.top_contributors(o, "c_mktsegment", "c_name").select("c_mktsegment", "c_name", "contributions", F.col("rank").cast("long").alias("rank"), "public_contributors")


TOP_CONTRIBUTORS = """WITH n AS (SELECT c_mktsegment, c_name, count(*) AS contributions FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY contributions DESC, lower(c_name), c_name) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS public_contributors FROM n) SELECT * FROM r WHERE rank <= 10"""


def url_parts(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", *(urls.url_part(u, i).alias(n) for i, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)))


URL_PARTS = "SELECT page_id, " + ", ".join(f"regexp_extract(url, '{urls.URL_PATTERN}', {i}) AS {n}" for i, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)) + " FROM pages"


def url_canonical(spark, d):
    return urls.with_safe_url(read(spark, d, "pages").select("page_id", "url"), "url", "canonical")


def html_links(spark, d):
    found = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)
    return read(spark, d, "pages").select("page_id", F.posexplode(found).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


HTML_LINKS = """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(len(h))) AS place, unnest(h) AS href FROM a"""


def project_ids(spark, d):
    return read(spark, d, "pages").select("page_id", digests.project_id(F.col("url")).alias("id"), F.substring(digests.project_id(F.col("url")), 1, 2).alias("prefix"))


PROJECT_IDS = "SELECT page_id, substr(sha256(url), 1, 20) AS id, substr(sha256(url), 1, 2) AS prefix FROM pages"


def canonical_digest(spark, d):
    """Of each event as a JSON object whose fields are out of order."""
    e = read(spark, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type", F.from_json("props", "map<string,long>").alias("props"))).alias("j"))
    return e.select("event_id", digests.json_digest("j").alias("digest"))


CANONICAL_DIGEST = """SELECT event_id, sha256('{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || '}') AS digest FROM events"""


def topic_tags(spark, d):
    p = read(spark, d, "part")
    label = F.concat_ws(" / ", F.element_at(F.split("p_name", " "), -1), F.when(F.col("p_partkey") % 3 == 0, "Machine Learning").when(F.col("p_partkey") % 3 == 1, "the Docker"))
    return p.select("p_partkey", text.normalize_topic(label).alias("tag"), text.normalize_topic(F.when(F.col("p_partkey") % 3 == 0, "Machine_Learning").otherwise(F.col("p_type"))).alias("kind"))


TOPIC_TAGS = """SELECT p_partkey, lower(split_part(p_name, ' ', -1)) || CASE p_partkey % 3 WHEN 0 THEN '-machine-learning' WHEN 1 THEN '-docker' ELSE '' END AS tag, CASE WHEN p_partkey % 3 = 0 THEN 'machine-learning' ELSE lower(p_type) END AS kind FROM part"""


def list_topics(spark, d):
    """Topics of parts by name and type, and words of topics by several keys."""
    k = F.col("p_partkey")
    t = F.concat_ws(" ", "p_name", F.when(k % 4 == 0, "self-hosted docker").when(k % 4 == 1, "Video games"), F.when(k % 3 == 0, "and SQL databases, SQL"), F.when(k % 5 == 0, "privacy"), F.when(k % 7 == 0, "a list of awesome lists"), F.when(k % 6 == 0, "fonts"), "p_type")
    return read(spark, d, "part").select("p_partkey", F.array_join(classify.topics_of(t), "; ").alias("topics"))


_TOPICS = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{t}' END" for t, p in classify.TOPICS.items())
LIST_TOPICS = f"""WITH x AS (SELECT p_partkey, concat_ws(' ', p_name, CASE p_partkey % 4 WHEN 0 THEN 'self-hosted docker' WHEN 1 THEN 'Video games' END, CASE WHEN p_partkey % 3 = 0 THEN 'and SQL databases, SQL' END, CASE WHEN p_partkey % 5 = 0 THEN 'privacy' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'a list of awesome lists' END, CASE WHEN p_partkey % 6 = 0 THEN 'fonts' END, p_type) AS t FROM part), y AS (SELECT p_partkey, list_filter([{_TOPICS}], lambda z: z IS NOT NULL) AS l FROM x)
SELECT p_partkey, CASE WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE 'Other topics' END AS topics FROM y"""


def classify_documents(spark, d):
    """Documents as lists: stars are characters, links are lines, unknown for every fifth document."""
    docs = read(spark, d, "documents")
    lines = F.when(F.col("doc_id") % 5 != 0, F.size(F.split("text", "\n")))
    about = F.when(F.col("doc_id") % 3 == 0, "A curated list of things").when(F.col("doc_id") % 3 == 1, "a framework for lists").otherwise(F.lit(None))
    e = classify.eligibility(F.col("lang") != "es", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")), lines, F.concat(F.lit("x/"), F.when(F.col("doc_id") % 2 == 0, "awesome-y").otherwise("y")), about, F.array().cast("array<string>"), F.lit(""))
    return docs.select("doc_id", e.alias("e")).select("doc_id", "e.state", "e.reason")


CLASSIFY_DOCUMENTS = """WITH x AS (SELECT doc_id, lang <> 'es' AS pub, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS stars, CASE WHEN doc_id % 5 <> 0 THEN len(string_split(text, chr(10))) END AS links,
  doc_id % 3 = 0 OR (doc_id % 3 = 2 AND doc_id % 2 = 0) AS intent FROM documents)
SELECT doc_id, CASE WHEN NOT pub THEN 'excluded' WHEN stars IS NULL THEN 'pending' WHEN stars < 100 THEN 'excluded' WHEN links IS NULL THEN 'pending' WHEN intent AND links >= 3 THEN 'eligible' WHEN links >= 5 OR intent THEN 'pending' ELSE 'excluded' END AS state,
  CASE WHEN NOT pub THEN 'Repository is not public.' WHEN stars IS NULL THEN 'Star count is unavailable.' WHEN stars < 100 THEN 'Observed stars are below 100.' WHEN links IS NULL THEN 'README has not been parsed or its format is unsupported.'
  WHEN intent AND links >= 3 THEN 'Curated-list intent and at least three distinct supported content links observed.' WHEN links >= 5 THEN 'Links found, but curated-list intent is uncertain; not silently excluded.'
  WHEN intent THEN 'List intent found; insufficient supported README content (may use other files).' ELSE 'No curated-list intent and insufficient supported list content in inspected README.' END AS reason FROM x"""


def title_evidence(spark, d):
    """Similarity of the names of a part and of the next one, and what it says of a pair of citations."""
    p = read(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    rows = p.join(q, "p_partkey").withColumn("similarity", F.round(ratio_of("p_name", "next"), 3))
    return rows.select("p_partkey", "similarity", classify.evidence(F.lit(False), F.col("similarity")).alias("evidence"))


def sections_from_text(spark, d):
    """Lines of documents as sections: their anchors, numbered where a document repeats one."""
    from pyspark.sql import Window as W

    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("slug", text.slug(F.col("line")))
    n = F.row_number().over(W.partitionBy("doc_id", "slug").orderBy("i")) - 1
    return rows.withColumn("n", n).select("doc_id", F.col("i").cast("long").alias("place"), F.concat("slug", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n"))).otherwise("")).alias("anchor"))


SECTIONS_FROM_TEXT = r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS place, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, place, replace(regexp_replace(lower(line), '[^\pL\pM\p{Nd}_\- ]', '', 'g'), ' ', '-') AS slug FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY place) - 1 AS n FROM s)
SELECT doc_id, place, slug || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS anchor FROM n"""

NAMES = """project_dedup list_pair_overlap neighbours ego_network hub_topk independent_citations citation_labels alternatives_topk alternative_counts search_projects freshness discover_filter dashboard_kpis
topic_counts freshness_counts histogram_stars histogram_entries compare_lists liveness_bucket release_cadence project_360 snapshot_diff upsert_merge candidate_topn stale_records stride_sample work_queue
merged_candidates reconcile_partitions top_contributors url_parts url_canonical html_links project_ids canonical_digest topic_tags list_topics classify_documents title_evidence sections_from_text""".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
