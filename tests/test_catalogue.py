"""Catalogue operators on small fixtures built against their thresholds."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import classify
from sparkloom.operators import activity, alternatives, checks, explore, insights, network, projects

CITED = "url string, list_id string, list_name string, list_url string, title string, category string, source_url string, seq long"


def citations(spark):
    rows = []

    def add(list_id, urls, title="Tool {}", own=0):
        for u in urls:
            rows.append((f"https://example.org/tool/{u}", list_id, f"list {list_id}", f"url {list_id}", title.format(u), "tools", f"src{len(rows):03}", len(rows)))
        for k in range(own):
            rows.append((f"https://example.org/{list_id}/{k}", list_id, f"list {list_id}", f"url {list_id}", f"Own {k}", "own", f"src{len(rows):03}", len(rows)))

    add("111", range(6), own=2)
    add("222", range(6), own=2)
    add("333", range(5), "Different wording {} altogether", own=3)
    add("444", range(2), "Shared with D {}", own=3)
    return spark.createDataFrame(rows, CITED)


@pytest.fixture(scope="module")
def cited(spark):
    return citations(spark).cache()


def test_pairs(cited):
    got = {(r.a, r.b): r for r in network.list_pairs(projects.first_by_list(cited)).collect()}
    r = got["111", "222"]
    assert (r.shared, r.jaccard, r.copy_fraction, r.near_duplicate) == (6, 0.6, 1.0, True)
    r = got["111", "333"]
    assert (r.shared, r.jaccard, r.copy_fraction, r.near_duplicate) == (5, 0.4545, 0.0, False)
    assert ("111", "444") not in got
    salted = network.list_pairs(projects.first_by_list(cited), salts=3).collect()
    assert sorted(map(tuple, salted)) == sorted(map(tuple, got.values()))
    assert checks.check_pairs(network.list_pairs(projects.first_by_list(cited))).isEmpty()
    bad = network.list_pairs(projects.first_by_list(cited)).withColumn("near_duplicate", ~F.col("near_duplicate"))
    assert {x.rule for x in checks.check_pairs(bad).collect()} == {"near"}


def test_pairs_do_not_depend_on_partitions(cited):
    a, b = (sorted(map(tuple, network.list_pairs(projects.first_by_list(cited.repartition(n))).collect())) for n in (1, 17))
    assert a == b


def test_hubs_and_neighbours(cited):
    first = projects.first_by_list(cited)
    counts = network.independent_counts(first).join(projects.project_counts(cited).select("url", "title"), "url").withColumn("id", F.col("url"))
    top = network.hubs(counts).first()
    assert (top.url, top.list_count, top.independent_list_count, top.hub_discount) == ("https://example.org/tool/0", 4, 3, 1)
    assert checks.check_hubs(network.hubs(counts)).isEmpty()
    pairs = network.list_pairs(first)
    near = [r.neighbor for r in network.neighbours(pairs, "111").collect()]
    assert near[0] == "222" and "444" not in near
    edges = {(r.a, r.b) for r in network.ego_network(pairs, "111").collect()}
    assert edges == {("111", "222"), ("111", "333"), ("222", "333")}
    places = network.layout(["111", "222", "333"], [("111", "222", 0.6)], "111")
    assert places["111"] == (360, 240) and len(places) == 3


def test_projects(spark, cited):
    got = {r.url: r for r in projects.projects(cited).collect()}
    assert got["https://example.org/tool/0"].list_count == 4 and got["https://example.org/111/0"].list_count == 1
    assert got["https://example.org/tool/0"].title == "Tool 0"
    twice = spark.createDataFrame([("u", "1", "l", "lu", "A", "c", "s1", 1), ("u", "1", "l", "lu", "B", "c", "s0", 2), (None, "1", "l", "lu", "C", "c", "s2", 3)], CITED)
    r = projects.projects(twice).first()
    assert (r.list_count, r.occurrence_count, r.title) == (1, 2, "A") and [o.title for o in r.occurrences] == ["B", "A"]
    assert projects.projects(twice.limit(0)).count() == 0
    lists = spark.createDataFrame([(x, True, "eligible") for x in ("111", "222", "333", "444")], "id string, public boolean, state string")
    found = projects.projects(cited)
    assert checks.check_projects(found, lists).isEmpty()
    assert {r.rule for r in checks.check_projects(found.withColumn("list_count", F.col("list_count") + 1), lists).collect()} == {"list_count"}
    assert {r.rule for r in checks.check_projects(found, lists.where("id <> '444'")).collect()} == {"refers:list_id"}


def test_occurrences(spark):
    entry = "array<struct<title:string,url:string,category:string,source_url:string>>"
    lists = spark.createDataFrame([("1", "b/b", "u1", 10, "eligible", "d1"), ("2", "a/a", "u2", 50, "eligible", "d2"), ("3", "c/c", "u3", 99, "pending", "d3")], "id string, name string, url string, stars long, state string, detail string")
    details = spark.createDataFrame([("d1", [("late", "x", "c", "s")]), ("d2", [("early", "x", "c", "s")]), ("d3", [("never", "x", "c", "s")])], f"detail string, entries {entry}")
    r = projects.projects(projects.occurrences(lists, details)).first()
    assert (r.title, r.list_count) == ("early", 2)


def fold(pairs):
    best = (0.0, False, None)
    for names, explicit, ratio in pairs:
        if explicit or ratio > best[0]:
            best = (round(ratio, 3), explicit, names)
    return best


def test_evidence_follows_the_fold(spark):
    import random

    r = random.Random(5)
    rows, links = [], []
    for u in range(25):
        for k in range(5):
            rows.append((f"u{u}", f"{u}-{k}", f"n{k}", "lu", r.choice(["Tool", "Tool box", "Toolbox one", "Other thing", "Else"]), "c", f"s{k}", k))
            links.append((f"{u}-{k}", f"url{u}-{k}", [f"url{u}-{r.randrange(5)}"] if r.random() < 0.15 else []))
    df = spark.createDataFrame(rows, CITED)
    own = spark.createDataFrame(links, "list_id string, list_url string, sources array<string>")
    got = {x.url: x for x in network.best_evidence(projects.first_by_list(df), own).collect()}
    sources = {a: (b, c) for a, b, c in links}
    for u in range(25):
        mine = [x for x in rows if x[0] == f"u{u}"]
        pairs = []
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                (ua, sa), (ub, sb) = sources[a[1]], sources[b[1]]
                pairs.append(((a[2], b[2]), ua in sb or ub in sa, SequenceMatcher(None, a[4].lower(), b[4].lower()).ratio()))
        similarity, explicit, names = fold(pairs)
        x = got.get(f"u{u}")
        assert (x is None and names is None) or (x.explicit, (x.list_a, x.list_b)) == (explicit, names)
        assert x is None or x.similarity == pytest.approx(similarity, abs=1e-9)


def test_evidence_of_many_citations(spark):
    import random
    import threading

    r = random.Random(11)
    rows, links, long = [], [], "x" * 2500
    words = [["ab", "abc", "abd", "b", "", "zz"], ["ab"], ["aab", "aba", "cab", "abcabd"], [long, long + "y", long + "z", "ab"], ["abcdefg", "abcdefx", "qqqqqqq", "abxdefg"]]
    for u in range(60):
        for k in range(r.randrange(1, 9)):
            rows.append((f"u{u}", f"{u}-{k}", f"n{k}", "lu", r.choice(words[u % 5]), r.choice("cd"), f"s{k}", k))
            links.append((f"{u}-{k}", f"url{u}-{k}", [f"url{u}-{r.randrange(9)}", None] if r.random() < 0.2 else None))
    own = spark.createDataFrame(links, "list_id string, list_url string, sources array<string>")
    got = {x.url: x for x in network.best_evidence(projects.first_by_list(spark.createDataFrame(rows, CITED)), own).collect()}
    sources = {a: (b, c or []) for a, b, c in links}
    for u in range(60):
        mine, pairs = [x for x in rows if x[0] == f"u{u}"], []
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                (ua, sa), (ub, sb) = sources[a[1]], sources[b[1]]
                pairs.append(((a[2], b[2], a[5] == b[5]), ua in sb or ub in sa, 1.0 if a[4] == b[4] else SequenceMatcher(None, a[4], b[4]).ratio()))
        similarity, explicit, names = fold(pairs)
        x = got.get(f"u{u}")
        assert (names is None) == (x is None) and (x is None or (x.explicit, (x.list_a, x.list_b, x.category_match)) == (explicit, names))
        assert x is None or x.similarity == pytest.approx(similarity, abs=1e-9)
    # 18 million pairs of citations, three titles
    many = spark.range(6000).select(F.lit("u").alias("url"), F.col("id").cast("string").alias("list_id"), F.format_string("n%04d", "id").alias("list_name"), F.lit("lu").alias("list_url"), F.concat(F.lit("a title of some length, of kind "), F.col("id") % 3).alias("title"), F.lit("c").alias("category"), F.lit("s").alias("source_url"), F.col("id").alias("seq"))
    own = many.select("list_id", F.concat(F.lit("l"), "list_id").alias("list_url"), F.array().cast("array<string>").alias("sources"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    x = network.best_evidence(projects.first_by_list(many), own).first()
    late.cancel()
    assert (x.similarity, x.explicit, x.list_a, x.list_b) == (1.0, False, "n0000", "n0003")


def test_search(spark):
    df = spark.createDataFrame([("a", "Awesome Photo Gallery", ["self-hosting"]), ("b", "Photo thing", ["self-hosting"]), ("c", "Other", ["photos"])], "id string, title string, topics array<string>")
    ids = lambda q: [r.id for r in projects.search(df, q).collect()]
    assert set(ids("photo")) == {"a", "b", "c"} and ids("awesome photo gallery") == ["a"] and ids("") == [] and ids("nothing") == []
    assert ids("photo self-hosting") == ["a", "b"] and ids("PHOTO thing")[0] == "b"


def test_alternatives(spark):
    rows = [(f"u{i}", "1", "l", "lu", f"T{i}", "c", "s", i) for i in range(8)] + [("u0", "1", "l", "lu", "T0", "d", "s", 9), ("u1", "1", "l", "lu", "T1", "d", "s", 10)]
    got = alternatives.alternatives(spark.createDataFrame(rows, CITED)).collect()
    own = [r for r in got if r.category == "c" and r.url == "u0"]
    assert [r.alternative for r in sorted(own, key=lambda r: r["rank"])] == ["u1", "u2", "u3"] and own[0].total_alternatives == 7 and own[0].truncated
    assert all(r.url != r.alternative for r in got)
    small = [r for r in got if r.category == "d"]
    assert {(r.url, r.alternative, r.truncated) for r in small} == {("u0", "u1", False), ("u1", "u0", False)}
    lonely = alternatives.alternatives(spark.createDataFrame(rows[:1], CITED)).collect()
    assert [(r.alternative, r.total_alternatives, r.truncated) for r in lonely] == [(None, 0, False)]
    assert checks.check_alternatives(alternatives.alternatives(spark.createDataFrame(rows, CITED))).isEmpty()
    counts = {r.url: r.alternative_count for r in alternatives.alternative_counts(alternatives.alternatives(spark.createDataFrame(rows, CITED))).collect()}
    assert counts["u0"] == 3


LISTS = "id string, name string, scope string, description string, topics array<string>, github_topics array<string>, public boolean, state string, stars long, archived boolean, is_fork boolean, fresh_range string, fresh_days int, entry_count long"


def population(spark):
    rows = [(str(i), f"o/awesome-{i}", "", None, ["Tools"], [], True, "eligible", 100 + i, False, False, None, None, 5) for i in range(14)]
    rows.append(("14", "x/awesome-selfhosted", "", None, ["Tools"], [], True, "eligible", 300_000, False, False, None, None, 5))
    return spark.createDataFrame(rows, LISTS)


def test_discovery(spark):
    df = population(spark)
    rows = explore.discover(df, {}).collect()
    assert len(rows) == 15 and rows[0].id == "14" and rows[-1].stars == 100
    assert explore.discover(df, {"q": "SELFHOSTED"}).first().id == "14"
    assert explore.discover(df, {"freshness": "Within 30 days"}).count() == 0 and explore.discover(df, {"freshness": "Unknown"}).count() == 15
    assert explore.discover(df, {"state": "Needs review"}).count() == 0 and explore.discover(df, {"topic": "None"}).count() == 0
    assert explore.page_bounds(15, 9999) == (2, 2, 12, 15) and explore.page_bounds(0, 3) == (1, 1, 0, 0)
    assert [r.id for r in explore.page(explore.discover(df, {}), 2).collect()] == ["2", "1", "0"]
    bound = explore.bind({"q": "  a   b ", "page": "0", "min_stars": "x", "sort": "no", "bad": 1, "topic": True})
    assert (bound["q"], bound["page"], bound["min_stars"], bound["sort"]) == ("a b", 1, 100, "Most starred")
    assert explore.share(bound, "http://x/") == "http://x/?q=a+b"


def test_insights(spark):
    df = population(spark)
    assert [(r.label, r.n) for r in insights.histogram(df, "stars", classify.STAR_BUCKETS, False).collect()] == [("100–499", 14), ("50k+", 1)]
    unknown = df.withColumn("entry_count", F.when(F.col("id") != "1", F.col("entry_count"))).withColumn("state", F.when(F.col("id") == "0", "pending").otherwise(F.col("state")))
    assert [(r.label, r.n) for r in insights.histogram(unknown, "entry_count", classify.ENTRY_BUCKETS, True).collect()] == [("1–24", 14), ("Unknown", 1)]
    k = insights.dashboard(insights.eligible(unknown)).first()
    assert (k.population, k.entries_known, k.entries_unknown, k.median_stars) == (14, 13, 1, 108)
    assert insights.dashboard(df.limit(0)).first().median_stars == 0
    three = df.withColumn("state", F.when(F.col("id") == "3", "pending").otherwise(F.col("state")))
    assert [r.id for r in insights.compare(three, ["1", "1", "3", "2", "4", "5"]).collect()] == ["1", "2", "4"]
    assert [r.lists for r in insights.topic_counts(df).collect()] == [15]
    assert [(r.label, r.lists) for r in insights.freshness_counts(df).collect()] == [("Unknown", 15)]


def test_diff(spark):
    schema = "id string, name string, state string, stars long"
    before = spark.createDataFrame([("1", "a", "eligible", 1), ("2", "b", None, 2), ("3", "c", "pending", 3)], schema)
    after = spark.createDataFrame([("2", "b", None, 2), ("3", "c", "eligible", 3), ("4", "d", "pending", 4)], schema)
    d = insights.snapshot_diff(before, after, "id", ["state", "stars"])
    assert {r.id: r.change for r in d.collect()} == {"1": "removed", "3": "changed", "4": "added"}
    lines = list(insights.render_diff(d, "id", "id", ["state", "stars"]))
    assert "- 3 (state: pending -> eligible)" in lines and list(insights.render_diff(d.limit(0), "id", "id", [])) == ["No catalogue changes."]
    more = spark.range(5).select(F.col("id").cast("string").alias("id"), F.lit("added").alias("change"))
    assert list(insights.render_diff(more, "id", "id", [], shown=2)) == ["### Added (5)", "- 0", "- 1", "- and 3 more"]
    log = insights.prepended("# Changes\n\n## Old\n\n- x\n", "New", lines)
    assert log.startswith("# Changes\n\n## New\n\n###") and log.endswith("## Old\n\n- x\n") and insights.prepended("", "A", iter(["b"])) == "# Changelog\n\n## A\n\nb\n"


def test_activity(spark):
    rel = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("a", "2024-03-01T00:00:00Z"), ("a", "2024-06-01T00:00:00Z"), ("b", "2024-01-01T00:00:00Z"), ("c", None)], "id string, at string")
    got = {r.id: r for r in activity.release_cadence(rel, "id", "at").collect()}
    assert (got["a"].observed_count, got["a"].latest_at, got["a"].median_interval_days) == (3, "2024-06-01T00:00:00Z", 76.0)
    assert got["b"].median_interval_days is None and "c" not in got
    proj = spark.createDataFrame([("p", "O", "Tool"), ("q", "O", "Other")], "id string, owner string, repo string")
    pack = spark.createDataFrame([("npm", "tool", 5, "downloads", "git+https://github.com/o/tool.git"), ("npm", "tool2", 9, "downloads", "github:o/Tool"), ("pypi", "tool", 1, "downloads", "https://github.com/x/tool")], "registry string, package string, count long, metric string, repository string")
    u = activity.usage_records(proj, pack).collect()
    assert [(r.id, [(s.registry, s.package) for s in r.sources]) for r in u] == [("p", [("npm", "tool2")])]
    hits = spark.createDataFrame([("p1", "a", 2, False), ("p1", "b", 2, False), ("p2", "a", 3, False), ("p3", "a", 1, True), ("p4", "a", 1, False), ("p4", "a", 2, False)], "part string, id string, total long, bad boolean")
    assert {r.part: r.state for r in activity.reconcile(hits, "part", "id", "total", "bad").collect()} == {"p1": "reconciled", "p2": "unresolved", "p3": "unresolved", "p4": "unresolved"}
    assert activity.split_partition("2024-01-01", "2024-01-03", 100, None) == [("2024-01-01", "2024-01-02", 100, None), ("2024-01-03", "2024-01-03", 100, None)]
    assert activity.split_partition("2024-01-01", "2024-01-01", 5, 5) is None
    assert activity.split_partition("2024-01-01", "2024-01-01", 0, 9) == [("2024-01-01", "2024-01-01", 0, 4), ("2024-01-01", "2024-01-01", 5, 9)]


def test_samples_and_queues(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("id"), F.col("id").alias("list_count"), F.concat(F.lit("u"), "id").alias("url"))
    assert projects.stride_sample(df, 10).count() == 10
    both = projects.top_and_random(df, 5, 7, seed=3).collect()
    assert [r.kind for r in both].count("top") == 5 and len({r.id for r in both}) == 12
    assert sorted(r.id for r in projects.top_and_random(df, 5, 7, seed=3).collect()) == sorted(r.id for r in both)
    assert [r.list_count for r in projects.candidates(df, df.where("list_count > 98"), 2).collect()] == [98, 97]
    new = df.where("list_count < 2").withColumn("url", F.lit("new"))
    assert projects.upsert(df, new).where("url = 'new'").count() == 2 and projects.upsert(df, new).count() == 101
    q = projects.work_queue(df, df.where("list_count >= 50"), 20, by="list_count").collect()
    assert len(q) == 50 and {r.batch for r in q} == {0, 1, 2} and next(r.batch for r in q if r.list_count == 49) == 0
    old = spark.createDataFrame([("1", "x"), ("2", None)], "id string, d string")
    now = spark.createDataFrame([("1", "x"), ("2", None), ("3", "y"), ("4", None)], "id string, d string")
    assert sorted(r.id for r in projects.stale(now, old, "id", "d").collect()) == ["3", "4"]


def test_profile_and_records(spark):
    p = spark.createDataFrame([("a", 1), ("b", 2)], "id string, list_count long")
    live = spark.createDataFrame([("a", True)], "id string, archived boolean")
    r = {x.id: x for x in projects.profile(p, live, live, live).collect()}
    assert r["a"].liveness.archived is True and r["b"].liveness is None
    old = spark.createDataFrame([("u", "T1", "d1", "s2", 1, "c", 5), ("u", "T0", "d0", "s1", 2, "c", 1), ("u", "T0", "d0", "s1", 2, "c", 9)], "url string, title string, description string, source string, line long, category string, seq long")
    m = projects.merge_records(old).first()
    assert m.title == "T0" and [o.source for o in m.occurrences] == ["s1", "s2"]


def test_catalogue_search(spark):
    occ = "array<struct<source:string,line:long,title:string,description:string,category:string>>"
    df = spark.createDataFrame([("A", "x", "u1", [("s1", 1, "A1", "d1", "web"), ("s2", 2, "A2", "d2", "data")]), ("B", None, "u2", [("s2", 1, "B1", None, "web")])], f"title string, description string, url string, occurrences {occ}")
    assert [r.url for r in explore.catalogue_search(df, "data").collect()] == ["u1"]
    assert explore.catalogue_search(df, "", "s1").count() == 1 and explore.catalogue_search(df).count() == 2
    assert {r.title for r in explore.first_occurrence(df, "s2").collect()} == {"A2", "B1"}
    e = spark.createDataFrame([("Tool", "c", {"Language": "Rust"}), ("Box", "d", {})], "title string, category string, properties map<string,string>")
    assert explore.entries_where(e, "rust tool").count() == 1 and explore.entries_where(e, "", "d").count() == 1


def test_list_profiles(spark):
    from sparkloom.functions.markdown import parse_readmes
    from sparkloom.operators import lists

    text = "# Awesome things\n\nA curated list of Python tools.\n\n## Tools\n" + "".join(f"- [T{i}](https://example.org/{i})\n" for i in range(5))
    readmes = spark.createDataFrame([(i, "o/awesome-x", "a" * 40, "README.md", text) for i in ("1", "2")], "id string, name string, revision string, path string, markdown string")
    meta = spark.createDataFrame(
        [(i, "o/awesome-x", d, ["python"], p, s, "2026-01-01T00:00:00Z", "2026-01-31T00:00:00Z") for i, d, p, s in (("1", None, True, 500), ("2", "x", False, 500), ("3", "Plain", True, 500))],
        "id string, name string, description string, github_topics array<string>, public boolean, stars long, content_updated_at string, observed_at string",
    )
    got = {r.id: r for r in lists.list_profiles(meta, parse_readmes(readmes), readmes).collect()}
    assert (got["1"].state, got["1"].entry_count, got["1"].topics, got["1"].scope, got["1"].freshness.range) == ("eligible", 5, ["Software development"], lists.FALLBACK_SCOPE, "Within 30 days")
    assert (got["2"].state, got["2"].entry_count, got["2"].unique_links) == ("excluded", None, None) and (got["3"].state, got["3"].entry_count) == ("pending", None)
    details = spark.createDataFrame([("3", [("A",), ("B",)])], "repository_id string, entries array<struct<title:string>>")
    c = lists.candidate_fields(lists.list_profiles(meta, parse_readmes(readmes), readmes), details, 1).collect()
    assert [(r.id, r.sample) for r in c] == [("3", ["A"])]
    hits = spark.createDataFrame([("7", "b", "u", None, -1, 2, False, "t2"), ("7", "a", "u", None, 5, 2, False, "t1")], "id string, name string, url string, description string, stars long, forks long, archived boolean, observed_at string")
    assert [(r.name, r.stars) for r in lists.repository_rows(hits).collect()] == [("a", 5)]
    assert lists.search_query("awesome", "2024-01-01", "2024-02-01", 100, None) == "awesome stars:100..* created:2024-01-01..2024-02-01"


def test_queue_keeps_every_row_over_many_partitions(spark):
    n = 150_000
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("stars"), F.concat(F.lit("name "), "id").alias("name")).repartition(8)
    q = projects.work_queue(df, df.where("id % 10 = 0").select("id"), 50).toPandas().sort_values(["stars", "id"], ascending=[False, True])
    assert list(q.batch) == [i // 50 for i in range(n - n // 10)]
    few = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id long, stars long")
    assert {r.id: r.batch for r in projects.work_queue(few, few.limit(0), 1).collect()} == {3: 0, 2: 1, 1: 2}


def test_stride_sample_of_a_large_table(spark):
    df = spark.range(300_000).select(F.col("id"), F.concat(F.lit("name "), "id").alias("name")).repartition(8)
    assert [(r.id, r.name) for r in projects.stride_sample(df, 30).collect()] == [(i * 10_000, f"name {i * 10_000}") for i in range(30)]
