import hashlib
import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import classify, dates, digests, markdown, similarity, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


UNSAFE = [
    "", "ftp://example.org/", "javascript:alert(1)", "http://user:pw@example.org/", "http://localhost/", "http://a.local/", "http://b.internal/x", "http://127.0.0.1/", "http://10.0.0.1/", "http://[::1]/",
    "http://example/", "http://exa mple.org/", "http://example.org/%0a", "http://example.org\\x", "http://example.org/%5c", "http://1.2.3.999/", "//example.org/x", "http://-bad.org/",
]


@pytest.mark.parametrize("url", UNSAFE)
def test_unsafe_urls(url):
    assert urls.canonical_url(url) is None


def test_canonical_urls(spark):
    assert urls.canonical_url("HTTPS://Example.COM:443/Case?q=X#section") == "https://example.com/Case?q=X#section"
    assert urls.canonical_url("http://example.org:8080") == "http://example.org:8080/"
    assert urls.canonical_url("http://bücher.example.org/") == "http://xn--bcher-kva.example.org/"
    assert urls.canonical_url("http://example.org/" + "a" * 5000) is None
    df = spark.createDataFrame([(u,) for u in [*UNSAFE, None, "HTTP://Example.org"]], "u string")
    got = [r.c for r in urls.with_safe_url(df, "u", "c").collect()]
    assert got == [None] * (len(UNSAFE) + 1) + ["http://example.org/"]


def test_repositories(spark):
    for url, owner in (("https://github.com/a/b", "a"), ("https://github.com/a/b.c/", "a"), ("https://github.com/a", None), ("https://github.com/a/b/c", None), ("http://github.com/a/b", None)):
        assert one(spark, urls.repository_part(F.col("u"), 1), u=url) == owner
    for value, hit in (("git+https://github.com/O/R.git", True), ("github:o/r", True), ("git@github.com:o/r.git", True), ("https://github.com/o/other", False), ("nothing", False)):
        assert one(spark, urls.refers_to(F.col("v"), F.lit("o"), F.lit("r")), v=value) is hit


def test_topics(spark):
    cases = {"Machine Learning": "machine-learning", "ML": "machine-learning", "Artificial Intelligence": "machine-learning", "Self Hosted": "self-hosting", "Selfhosted": "self-hosting", "Weird Niche Category": "weird-niche-category", "the": "", "": "", "machine-learning": "machine-learning", "CI/CD": "devops"}
    df = spark.createDataFrame(list(cases.items()), "label string, tag string")
    assert df.where(text.normalize_topic(F.col("label")) != F.col("tag")).count() == 0
    assert one(spark, text.normalize_topic(F.lit(None).cast("string"))) == ""
    over = F.create_map(F.lit("weird niche category"), F.lit("cloud"), F.lit("ml"), F.lit("cloud"))
    assert one(spark, text.normalize_topic(F.col("x1"), over), x1="Weird Niche Category") == "cloud"
    assert one(spark, text.normalize_topic(F.col("x1"), over), x1="ML") == "machine-learning"
    assert one(spark, text.distinct_topics(F.col("a")), a=["ML", "AI", "Docker", ""]) == ["machine-learning", "containers"]


def test_titles(spark):
    df = spark.createDataFrame([("  Straße \t X ", "strasse x"), (None, ""), ("A  b", "a b")], "t string, want string")
    assert [r[0] for r in df.select(text.normalize_title("t")).collect()] == [r.want for r in df.collect()]
    assert one(spark, text.slug(F.col("t")), t="Café & Bar-s!") == "café--bar-s"
    pairs = [("Tool one", "tool  ONE"), ("abcdef", "abcxef"), ("a", "zzzzzzzzzz"), ("", "")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.title_similarity(F.col("a"), F.col("b"))).collect()]
    want = [SequenceMatcher(None, " ".join(a.casefold().split()), " ".join(b.casefold().split())).ratio() for a, b in pairs]
    assert got == pytest.approx(want)


def test_digests(spark):
    value = {"b": [1, None, "é"], "a": {"z": 1.5, "y": True}}
    df = spark.createDataFrame([(json.dumps(value),), ("{bad",), (None,)], "j string")
    assert [r[0] for r in df.select(digests.json_digest("j")).collect()] == [hashlib.sha256('{"a":{"y":true,"z":1.5},"b":[1,null,"é"]}'.encode()).hexdigest(), None, None]
    r = spark.createDataFrame([('{"digest": "x", "n": 1.0}',)], "j string").select(digests.record_digest("j")).first()[0]
    assert r == hashlib.sha256(b'{"n":1}').hexdigest()
    e = F.array(F.struct(F.lit("b").alias("path"), F.lit("2").alias("content")), F.struct(F.lit("a").alias("path"), F.lit("1").alias("content")))
    assert one(spark, digests.entries_digest(e)) == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()


def test_freshness(spark):
    f = dates.freshness(F.col("u"), F.lit("2026-07-01T00:00:00Z"))
    r = one(spark, f, u="2026-01-02T00:00:00Z")
    assert (r.days, r.range, r["index"]) == (180, "Within 180 days", 50.0)
    r = one(spark, f, u="2026-05-31T12:00:00Z")
    assert (r.days, r.range) == (30, "Within 90 days")
    assert one(spark, f, u="2027-01-01T00:00:00Z").days == 0
    assert one(spark, f, u="bad").range == one(spark, f, u=None).range == "Unknown"
    assert one(spark, dates.seconds_between(F.lit("2024-01-02"), F.lit("2024-01-01"))) is None
    assert one(spark, dates.whole_days(F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-01T12:00:00Z"))) == -1


@pytest.mark.parametrize(("last", "archived", "want"), [("2026-08-01T00:00:00Z", False, "active"), ("2026-03-01T00:00:00Z", False, "slowing"), ("2020-01-01T00:00:00Z", False, "stale"), ("2026-08-01T00:00:00Z", True, "archived"), (None, False, "unknown")])
def test_liveness(spark, last, archived, want):
    b = dates.liveness_bucket(F.lit(True), F.col("a"), F.lit(last).cast("string"), F.lit("2026-09-04T00:00:00Z"))
    assert one(spark, b, a=archived).bucket == want


def test_eligibility(spark):
    def state(public=True, stars=100, links=5, name="o/awesome-x", about="A curated list of tools", labels=(), readme=""):
        e = classify.eligibility(F.lit(public), F.lit(stars).cast("long"), F.lit(links).cast("long"), F.lit(name), F.lit(about).cast("string"), F.array(*map(F.lit, labels)).cast("array<string>"), F.lit(readme))
        return one(spark, e).state

    assert [state(stars=s) for s in (99, 100, 50000, None)] == ["excluded", "eligible", "eligible", "pending"]
    assert state(public=False) == "excluded"
    assert state(links=None) == "pending"
    assert state(links=2) == "pending"
    assert state(name="o/x", about="a fast framework") == "pending"
    assert state(name="o/x", about="a fast framework", links=1) == "excluded"
    assert state(name="o/x", about=None, readme="# X\nThis is a curated list of things\n## T") == "eligible"
    assert state(name="o/x", about=None, labels=["awesome-list"]) == "eligible"


def test_buckets(spark):
    for value, label in ((100, "100–499"), (499, "100–499"), (50_000, "50k+"), (99, "Unknown"), (None, "Unknown")):
        assert one(spark, classify.bucket(F.lit(value).cast("long"), classify.STAR_BUCKETS)) == label
    assert one(spark, classify.bucket(F.lit(0), classify.ENTRY_BUCKETS)) == "Unknown"
    assert one(spark, classify.topics_of(F.lit("nothing here"))) == ["Other topics"]


BASE = "# Awesome things\n\n## Tools\n\n" + "".join(f"- [Tool {i}](https://example.org/tool/{i})\n" for i in range(5))


def parse(markdown_text):
    sections, entries, error = markdown.read_one(markdown_text, "o/r", "a" * 40)
    assert error is None
    return sections, entries


def test_readme():
    sections, entries = parse(BASE + "\n### Subcategory\n\n- [X](https://example.org/x)\n")
    assert len(entries) == 6 and sections[-1]["path"] == ["Awesome things", "Tools", "Subcategory"] and entries[-1]["category"] == "subcategory"
    _, entries = parse("## T\n\n| Name | Language |\n|---|---|\n| [A](https://example.org/a) | Rust |\n")
    assert [e["properties"] for e in entries] == [{"Language": "Rust"}]
    assert parse("- ![b](https://img.shields.io/x.svg)\n- [j](javascript:alert(1))\n- [a](#anchor)\n")[1] == []
    assert len(parse(BASE + "\n## Contents\n- [q](https://example.org/q)\n## Installation\n- [z](https://example.org/z)\n")[1]) == 5
    sections, entries = parse("# L\n## Tools\n- [a](https://example.org/a)\n  - [b](https://example.org/b)\n## Tools\n- [c](https://example.org/c)\n")
    assert len(entries) == 3 and sections[-1]["id"] == "tools-1"
    assert parse("- [r][k]\n\n[k]: https://example.org/ref\n")[1][0]["url"] == "https://example.org/ref"
    assert parse("```\n- [no](https://example.org/no)\n```\n- [yes](docs/x.md)\n")[1][0]["url"].endswith("/docs/x.md")
    assert markdown.read_one("x", "o/..", "a" * 40)[2] == "invalid identity" and markdown.read_one("x" * (2 << 20) + "x", "o/r", "a" * 40)[2] == "too large" and markdown.read_one(None, "o/r", "a" * 40)[2] == "missing"


def test_readmes_as_rows(spark):
    df = spark.createDataFrame([("1", "o/r", "a" * 40, "README.md", BASE), ("2", "o/r", "bad", "README.md", BASE), ("3", "o/r", "a" * 40, None, None)], "id string, name string, revision string, path string, markdown string")
    got = {r.id: r for r in markdown.parse_readmes(df).collect()}
    assert (got["1"].entry_count, got["1"].unique_links, got["1"].category_count, got["1"].error) == (5, 5, 1, None)
    assert got["2"].error == "invalid identity" and got["3"].error == "missing" and got["3"].entry_count == 0
    links = spark.createDataFrame([("Generated from [x](https://example.org/d) source data [y](https://example.org/d)",), ("see [x](https://example.org/d)",), (None,)], "m string").select(markdown.source_links("m")).collect()
    assert [r[0] for r in links] == [["https://example.org/d"], [], []]


def test_markdown_pieces(spark):
    body = "### Repo URL\n\nhttps://x.org\n\n### Why\n\n_No response_\n"
    assert one(spark, markdown.form_fields(F.col("b")), b=body) == {"repo_url": "https://x.org", "why": ""}
    assert one(spark, markdown.form_fields(F.lit(None).cast("string"))) == {}
    t = "## A\nx\n### In\ny\n## B\n- Owner: me\n| h | i |\n|---|---|\n| 1 | 2 |\n"
    assert one(spark, markdown.section(F.col("t"), "A"), t=t) == "x\n### In\ny"
    assert one(spark, markdown.field(F.col("t"), "Owner"), t=t) == "me"
    assert one(spark, markdown.table_rows(F.col("t")), t=t) == [["1", "2"]]
    marked = "<!-- [P-ROLE-v1] -->\n```json\n{\"a\": 1}\n```\n<!-- [/P-ROLE-v1] -->\n<!-- [P-ROLE-v1] -->\n```json\n{bad\n```\n<!-- [/P-ROLE-v1] -->"
    got = markdown.envelopes(spark.createDataFrame([(marked,)], "t string"), "t", "ROLE", "P").collect()
    assert sorted(r.malformed for r in got) == [False, True]
    assert markdown.replace_section("## A\nold\n\n## B\nz", "A", "new") == "## A\n\nnew\n\n## B\nz"
    assert markdown.replace_section("x", "N", "v", create=True).endswith("## N\n\nv\n") and markdown.replace_section("x", "N", "v") == "x"
