"""Queries that go through files: tables are landed as the documents that readers expect, or staged and published as
artifacts, and read back. Each run has a folder of its own in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import classify, dates, markdown
from ..functions.digests import project_id
from ..operators import lists, projects
from ..session import shared_dir
from ..sources import artifacts, documents
from ..streaming import runs
from .audits import index_rows
from .catalogue import read


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str, column: str = "value", per_file: int | None = None) -> str:
    """rows' text column as files in a folder of its own; per_file rows in each."""
    path = folder(rows.sparkSession, name)
    w = rows.select(F.col(column).alias("value")).write
    (w.option("maxRecordsPerFile", per_file) if per_file else w).text(path)
    return path


def index_from_file(spark, d):
    """Customers as a whole-file index: one JSON document, as the artifact is."""
    row = index_rows(spark, d).withColumn("topics", F.array("description"))
    doc = row.agg(F.to_json(F.struct(F.lit(1).alias("format_version"), F.lit("2024-01-01").alias("generated_at"), F.collect_list(F.struct(*row.columns)).alias("lists"))).alias("value"))
    return documents.index(spark, landed(doc, "index")).select("id", "name", "url", "state", "public", "stars", "unique_links", "entry_count", "detail", "revision", F.get("topics", F.lit(0)).alias("topic"))


_INDEX = """x AS (SELECT CAST(CASE WHEN c_custkey % 40 = 7 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS id, c_name AS name, 'https://Example.org/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS url,
  (['eligible', 'pending', 'excluded', 'new'])[c_custkey % 4 + 1] AS state, c_custkey % 3 <> 0 AS public, CAST(floor(c_acctbal / 10) AS BIGINT) AS stars, c_custkey % 9 AS unique_links,
  CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey - 1 END AS BIGINT) AS entry_count, CASE WHEN c_custkey % 2 = 0 THEN 'lists/' || c_custkey END AS detail,
  CASE WHEN c_custkey % 8 = 0 THEN 'x' ELSE substr(sha256(c_name), 1, 40) END AS revision, lower(c_mktsegment) AS topic FROM customer)"""
INDEX_FROM_FILE = f"WITH {_INDEX} SELECT * FROM x"


def details_from_files(spark, d):
    """Suppliers as details, a file each, their lines as entries."""
    li = read(spark, d, "lineitem")
    entry = F.struct(F.col("l_partkey").cast("string").alias("title"), F.concat(F.lit("u"), F.col("l_partkey")).alias("url"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").cast("long").alias("line"), F.create_map(F.lit("q"), F.col("l_quantity").cast("string")).alias("properties"))
    one = li.groupBy("l_suppkey").agg(F.collect_list(entry).alias("entries"))
    doc = one.select(F.to_json(F.struct(F.col("l_suppkey").cast("string").alias("repository_id"), F.size("entries").alias("entry_count"), "entries")).alias("value"))
    got = documents.details(spark, landed(doc, "details", per_file=1))
    return got.select("repository_id", "entry_count", F.explode("entries").alias("e")).groupBy("repository_id", "entry_count", "e.category").agg(F.count("*").alias("entries"), F.sum("e.line").alias("lines"), F.sum(F.col("e.properties")["q"].cast("double")).cast("long").alias("quantity"))


DETAILS_FROM_FILES = """WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS repository_id, n AS entry_count, l_returnflag AS category, count(*) AS entries, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN n USING (l_suppkey) GROUP BY ALL"""


def _shards(spark, d) -> DataFrame:
    p = read(spark, d, "part").select(project_id(F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("size"))
    doc = p.groupBy(F.substring("id", 1, 2).alias("prefix")).agg(F.to_json(F.struct(F.lit(1).alias("format_version"), F.first(F.substring("id", 1, 2)).alias("prefix"), F.collect_list(F.struct("id", "title", "size")).alias("projects"))).alias("value"))
    return documents.shards(spark, landed(doc, "shards", per_file=1), "id string, title string, size long")


def shards_from_files(spark, d):
    return _shards(spark, d)


SHARDS_FROM_FILES = "SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 2) AS prefix, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 20) AS id, p_name AS title, CAST(p_size AS BIGINT) AS size FROM part"


def records_by_id(spark, d):
    """Two records of an artifact that is partitioned by prefix, by their ids."""
    import hashlib

    ids = [hashlib.sha256(str(i).encode()).hexdigest()[:20] for i in (3, 77)]
    return documents.by_id(_shards(spark, d), [*ids, "none"])


RECORDS_BY_ID = f"WITH x AS ({SHARDS_FROM_FILES}) SELECT * FROM x WHERE id IN (substr(sha256('3'), 1, 20), substr(sha256('77'), 1, 20))"


def sessions_from_files(spark, d):
    """Nations as session records, a file each."""
    n = read(spark, d, "nation")
    doc = n.select(F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("pr").alias("kind"), F.col("n_name").alias("title"), F.struct(F.col("n_regionkey").cast("string").alias("platform")).alias("harness"), F.struct(F.col("n_nationkey").cast("long").alias("testsPassed")).alias("verification"))).alias("value"))
    got = documents.sessions(spark, landed(doc, "sessions", per_file=1))
    return got.select("id", "kind", F.col("harness.platform").alias("platform"), F.col("verification.testsPassed").alias("tests"))


SESSIONS_FROM_FILES = "SELECT n_name AS id, 'pr' AS kind, CAST(n_regionkey AS VARCHAR) AS platform, CAST(n_nationkey AS BIGINT) AS tests FROM nation"


def junit_outcomes(spark, d):
    """Regions as reports, their nations as test cases."""
    n, k = read(spark, d, "nation"), F.col("n_nationkey")
    case = F.concat(F.lit('<testcase classname="r'), F.col("n_regionkey"), F.lit('" name="'), F.col("n_name"), F.when(k % 3 == 0, F.lit('"><failure message="x">no</failure></testcase>')).when(k % 5 == 1, F.lit('"><skipped/></testcase>')).otherwise(F.lit('"/>')))
    doc = n.groupBy("n_regionkey").agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(case), ""), F.lit("</testsuite>")).alias("value"))
    return documents.junit(spark, landed(doc, "junit", per_file=1) + "/part-*").select("id", "outcome")


JUNIT_OUTCOMES = "SELECT 'r' || n_regionkey || '.' || n_name AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'fail' WHEN n_nationkey % 5 = 1 THEN 'skipped' ELSE 'pass' END AS outcome FROM nation"


def change_sizes(spark, d):
    """Parts as lines of a numeric diff, among lines that are none."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    line = F.when(k % 10 == 9, F.lit("not a change")).otherwise(F.concat_ws("\t", F.when(k % 4 == 0, "-").otherwise(F.col("p_size").cast("string")), F.when(k % 4 == 0, "-").otherwise((k % 7).cast("string")), F.concat(F.lit("a/"), k, F.lit(".py"))))
    return documents.change_sizes(spark, landed(p.select(line.alias("value")), "diff"))


CHANGE_SIZES = "SELECT 'a/' || p_partkey || '.py' AS path, CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS BIGINT) AS added, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 7 END AS deleted FROM part WHERE p_partkey % 10 <> 9"


def landed_hits(spark, d):
    """Orders as landed pages of a search, their lines as items, as the candidates that they are."""
    li = read(spark, d, "lineitem")
    item = F.struct(F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")).otherwise(-F.col("l_partkey") - 1).alias("id"), F.concat(F.lit("o/r"), F.col("l_partkey")).alias("full_name"), F.lit("u").alias("html_url"), F.col("l_quantity").cast("long").alias("stargazers_count"), F.lit(False).alias("archived"))
    body = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.count("*").alias("total_count"), F.lit(False).alias("incomplete_results"), F.collect_list(item).alias("items"))).alias("body"))
    pages = body.select(F.col("l_orderkey").alias("query"), F.lit(1).alias("page"), F.lit("2024-01-01").alias("observed_at"), "body")
    return documents.search_hits(pages).select("query", "total", "incomplete", "id", "name", "stars", "archived")


LANDED_HITS = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS query, n AS total, false AS incomplete, CAST(l_partkey AS VARCHAR) AS id, 'o/r' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS stars, false AS archived FROM lineitem JOIN n USING (l_orderkey) WHERE l_partkey % 9 <> 0"""


def landed_batches(spark, d):
    """Customers as answers of batches by market segment and nation; some have an error, some no value."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    alias = F.concat(F.lit("r"), k)
    data = F.map_from_entries(F.collect_list(F.struct(alias, F.when(k % 8 != 3, F.col("c_name")))))
    errors = F.filter(F.collect_list(F.when(k % 5 == 1, F.struct(F.array(alias).alias("path")))), lambda x: x.isNotNull())
    doc = c.groupBy(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("batch")).agg(data.alias("data"), errors.alias("errors"))
    body = F.to_json(F.struct("data", "errors"), {"ignoreNullFields": "false"})
    return documents.batch_answers(doc.select("batch", body.alias("body")))


LANDED_BATCHES = "SELECT c_mktsegment || '-' || c_nationkey AS batch, 'r' || c_custkey AS alias, c_name AS value FROM customer WHERE c_custkey % 8 <> 3 AND c_custkey % 5 <> 1"


def published_parts(spark, d):
    """Parts staged, checked, published and read back; an older generation is pruned, and the digest stays the same when
    the same rows are staged again in another order."""
    store = artifacts.Store(spark, folder(spark, "store"))
    rows = read(spark, d, "part").select(project_id(F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_size")
    old = store.stage("parts", rows.where("p_size < 20"))
    store.publish("parts", old)
    new = store.stage("parts", rows)
    if store.stage("parts", rows.repartition(3, "p_name")) != new:
        raise ValueError("the digest depends on the order of rows")
    store.publish("parts", new)
    store.prune("parts", new)
    return store.read("parts").select("id", "p_name", "p_size", "prefix")


PUBLISHED_PARTS = "SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 20) AS id, p_name, p_size, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 2) AS prefix FROM part"


def older_generation(spark, d):
    """An index at an earlier digest, after a newer one is published."""
    store = artifacts.Store(spark, folder(spark, "store"))
    rows = read(spark, d, "nation").select(F.col("n_name").alias("id"), "n_regionkey")
    old = store.stage("nations", rows.where("n_regionkey < 3"))
    store.publish("nations", old)
    store.publish("nations", store.stage("nations", rows))
    return store.at("nations", old).select("id", "n_regionkey")


OLDER_GENERATION = "SELECT n_name AS id, n_regionkey FROM nation WHERE n_regionkey < 3"


def appended_once(spark, d):
    """Events in three batches that overlap: each is stored once."""
    path = folder(spark, "events")
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", "user_id")
    for i in range(3):
        runs.append_once(e.where(F.col("id").cast("long") % 4 >= i).where(F.col("id").cast("long") % 4 <= i + 1), path)
    return spark.read.schema(e.schema).parquet(path)


APPENDED_ONCE = "SELECT CAST(event_id AS VARCHAR) AS id, event_type, user_id FROM events"


def expected_revisions(spark, d):
    """Events appended by writers that name the revision that they saw; one that is late is refused."""
    path = folder(spark, "log")
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", "user_id")
    k = F.col("id").cast("long") % 3
    for i in range(3):
        if runs.append_expected(e.where((k == i) | (k == 0)), path, i) != i + 1:
            raise ValueError("revisions are counted by appends")
    try:
        runs.append_expected(e, path, 2)
        raise ValueError("a late writer wasn't refused")
    except runs.Conflict:
        pass
    return runs.read_log(spark, path, e.schema, 2).select("id", "event_type", "user_id")


EXPECTED_REVISIONS = "SELECT CAST(event_id AS VARCHAR) AS id, event_type, user_id FROM events WHERE event_id % 3 < 2"


def parsed_lists(spark, d):
    """Orders as READMEs that are parsed: a heading a return flag, an item a line; nested headings give paths."""
    li = read(spark, d, "lineitem")
    item = F.concat(F.lit("- [Part "), F.col("l_partkey"), F.lit("](https://example.org/p/"), F.col("l_partkey"), F.lit(") - text\n"))
    flags = li.groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    text = flags.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("## "), F.col("l_returnflag"), F.lit("\n\n"), F.col("items")))), "\n").alias("body"))
    rows = text.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("o/r").alias("name"), F.lit("a" * 40).alias("revision"), F.lit("README.md").alias("path"), F.concat(F.lit("# Orders\n\n"), F.col("body")).alias("markdown"))
    got = markdown.parse_readmes(rows)
    return got.select("id", "entry_count", "unique_links", "category_count", F.explode("sections").alias("s")).select("id", "entry_count", "unique_links", "category_count", F.col("s.id").alias("section"), F.array_join("s.path", "/").alias("path"), "s.level", "s.entries")


PARSED_LISTS = """WITH n AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS u, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS m FROM lineitem GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS id, n AS entry_count, u AS unique_links, c AS category_count, lower(f) AS section, 'Orders/' || f AS path, 2 AS level, m AS entries FROM n JOIN s USING (k)
UNION ALL SELECT CAST(k AS VARCHAR), n, u, c, 'orders', 'Orders', 1, 0 FROM n"""


def list_profiles(spark, d):
    """Customers as repositories with READMEs: state, topics, scope, freshness and counts."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    meta = c.select(
        k.cast("string").alias("id"), F.concat(F.lit("o/"), F.when(k % 2 == 0, "awesome-").otherwise(""), F.lower("c_mktsegment")).alias("name"), F.when(k % 4 == 0, "A curated list of data tools").when(k % 4 == 1, "A small framework").alias("description"), F.lit(None).cast("array<string>").alias("github_topics"),
        (k % 7 != 0).alias("public"), F.when(k % 9 != 2, (k % 50) * 10).alias("stars"), F.lit("2024-01-01 00:00:00").alias("content_updated_at"), F.lit("2024-03-01 12:00:00").alias("observed_at"),
    )
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 8).cast("int"))), lambda i: F.concat(F.lit("- [a"), i, F.lit("](https://example.org/"), i, F.lit(")"))), "\n")
    readmes = c.where(k % 5 != 3).select(k.cast("string").alias("id"), F.lit("o/r").alias("name"), F.lit("b" * 40).alias("revision"), F.lit("README.md").alias("path"), F.concat(F.lit("# Top\n\n"), links).alias("markdown"))
    got = lists.list_profiles(meta, markdown.parse_readmes(readmes), readmes.select("id", "markdown"))
    return got.select("id", "state", "reason", F.array_join("topics", "; ").alias("topics"), "scope", F.col("freshness.days").alias("days"), F.col("freshness.range").alias("fresh"), "entry_count", "unique_links")


LIST_PROFILES = f"""WITH x AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, c_custkey % 7 <> 0 AS pub, CASE WHEN c_custkey % 9 <> 2 THEN (c_custkey % 50) * 10 END AS stars,
  CASE WHEN c_custkey % 5 <> 3 AND c_custkey % 7 <> 0 THEN greatest(1, c_custkey % 8) END AS links, c_custkey % 4 = 0 OR (c_custkey % 4 <> 1 AND c_custkey % 2 = 0) AS intent FROM customer),
r AS (SELECT *, CASE WHEN NOT pub THEN 1 WHEN stars IS NULL THEN 2 WHEN stars < {classify.MIN_STARS} THEN 3 WHEN links IS NULL THEN 4 WHEN intent AND links >= 3 THEN 5 WHEN links >= 5 THEN 6 WHEN intent THEN 7 ELSE 8 END AS rule FROM x)
SELECT CAST(k AS VARCHAR) AS id, (['excluded', 'pending', 'excluded', 'pending', 'eligible', 'pending', 'pending', 'excluded'])[rule] AS state,
  (['Repository is not public.', 'Star count is unavailable.', 'Observed stars are below 100.', 'README has not been parsed or its format is unsupported.', 'Curated-list intent and at least three distinct supported content links observed.',
    'Links found, but curated-list intent is uncertain; not silently excluded.', 'List intent found; insufficient supported README content (may use other files).', 'No curated-list intent and insufficient supported list content in inspected README.'])[rule] AS reason,
  CASE WHEN k % 4 = 0 THEN 'Data & analytics' ELSE 'Other topics' END AS topics, CASE k % 4 WHEN 0 THEN 'A curated list of data tools' WHEN 1 THEN 'A small framework' ELSE 'Explore the upstream list for its stated scope.' END AS scope,
  60 AS days, 'Within 90 days' AS fresh, CAST(links AS BIGINT) AS entry_count, CAST(links AS BIGINT) AS unique_links FROM r"""


def session_envelopes(spark, d):
    """Customers' remarks with one or two blocks between markers; some aren't JSON."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    block = lambda body: F.concat(F.lit("<!-- [sdlc-handoff-v1] -->\nx\n```json\n"), body, F.lit("\n```\n<!-- [/sdlc-handoff-v1] -->\n"))
    text = F.concat(F.lit("hello\n"), block(F.when(k % 7 == 2, "{oops").otherwise(F.concat(F.lit('{"a":'), k, F.lit("}")))), F.when(k % 3 == 0, block(F.lit("[1]"))).otherwise(F.lit("")))
    return markdown.envelopes(c.select("c_custkey", text.alias("t")), "t", "handoff", "sdlc").select("c_custkey", F.btrim("body", F.lit("\n ")).alias("body"), "malformed")


SESSION_ENVELOPES = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 2 THEN '{oops' ELSE '{"a":' || c_custkey || '}' END AS body, c_custkey % 7 = 2 AS malformed FROM customer UNION ALL SELECT c_custkey, '[1]', false FROM customer WHERE c_custkey % 3 = 0"""


def file_digests(spark, d):
    n = read(spark, d, "nation")
    path = landed(n.select(F.col("n_name").alias("value")), "files", per_file=1)
    return documents.file_digests(spark, path + "/part-*").select("digest")


FILE_DIGESTS = "SELECT sha256(n_name || chr(10)) AS digest FROM nation"


def top_and_rest(spark, d):
    """All parts that two lists or more cite: the first ten by citations, the others as the random part."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 13).alias("list_count"))
    return projects.top_and_random(rows, 10, 10_000_000, 7).select("id", "kind")


TOP_AND_REST = "WITH x AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey % 13 DESC, p_partkey) AS r FROM part WHERE p_partkey % 13 >= 2) SELECT id, CASE WHEN r <= 10 THEN 'top' ELSE 'random' END AS kind FROM x"


def range_ranks(spark, d):
    e = read(spark, d, "events").select("event_id", dates.freshness(F.col("ts"), F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")).alias("f"))
    return e.select("event_id", F.col("f.days").alias("days"), dates.range_rank(F.col("f.range")).alias("rank"))


RANGE_RANKS = """WITH x AS (SELECT event_id, epoch_us(TIMESTAMP '2024-04-20') - epoch_us(ts) AS us FROM events), y AS (SELECT event_id, greatest(us, 0) / 86400000000.0 AS d FROM x)
SELECT event_id, CAST(floor(d) AS INTEGER) AS days, CASE WHEN d <= 30 THEN 0 WHEN d <= 90 THEN 1 WHEN d <= 180 THEN 2 WHEN d <= 365 THEN 3 ELSE 4 END AS rank FROM y"""

NAMES = """index_from_file details_from_files shards_from_files records_by_id sessions_from_files junit_outcomes change_sizes landed_hits landed_batches published_parts older_generation appended_once expected_revisions parsed_lists list_profiles
session_envelopes file_digests top_and_rest range_ranks""".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
