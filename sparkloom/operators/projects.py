"""Projects: citations of a URL from lists, gathered; search records; citation evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.digests import project_id
from ..functions.text import all_terms_in, distinct_topics, terms_of
from ..session import kept


def occurrences(lists: DataFrame, details: DataFrame) -> DataFrame:
    """One row for each entry of an eligible list's detail: list_id, list_name, list_url, title, url, category, source_url
    and seq, the place of the entry when lists are in index order (stars from many to few, then name).

    lists: id, name, url, stars, state, detail; details: detail and entries array<struct<title, url, category,
    source_url>>. Only the small columns of lists meet the details.
    """
    order = F.struct((-F.col("stars")).alias("s"), F.lower("name").alias("n"), F.col("id").alias("i"))
    chosen = lists.where("state = 'eligible' AND detail IS NOT NULL").select(F.col("id").alias("list_id"), F.col("name").alias("list_name"), F.col("url").alias("list_url"), "detail", order.alias("_place"))
    rows = details.join(chosen, "detail").select("list_id", "list_name", "list_url", "_place", F.posexplode("entries").alias("_i", "e"))
    return rows.select("list_id", "list_name", "list_url", "e.title", "e.url", "e.category", "e.source_url", F.struct("_place", "_i").alias("seq"))


def projects(rows: DataFrame) -> DataFrame:
    """Occurrences by URL: id, url, title (of the first by seq), list_count, occurrence_count, occurrences (by list name
    and source), prefix.

    Rows without a url don't count. A URL's occurrences stay one array, as the artifact has them; where a URL may have
    very many, use project_counts, which holds no group.
    """
    one = F.struct(F.lower("list_name").alias("k"), F.col("source_url").alias("s"), "list_id", "list_name", "list_url", "title", "category", "source_url")
    grouped = rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("title", "seq").alias("title"), F.count_distinct("list_id").alias("list_count"), F.count("*").alias("occurrence_count"), F.sort_array(F.collect_list(one)).alias("o"))
    clean = F.transform("o", lambda x: x.dropFields("k", "s"))
    return grouped.select(project_id(F.col("url")).alias("id"), "url", "title", "list_count", "occurrence_count", clean.alias("occurrences"), F.substring(project_id(F.col("url")), 1, 2).alias("prefix"))


def project_counts(rows: DataFrame) -> DataFrame:
    """url, title, list_count, occurrence_count: partial aggregates only, whatever the size of a group."""
    return rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("title", "seq").alias("title"), F.count_distinct("list_id").alias("list_count"), F.count("*").alias("occurrence_count"))


def first_by_list(rows: DataFrame) -> DataFrame:
    """The first occurrence of each (url, list), by list name and source: what the network and the clusters compare."""
    first = F.min(F.struct(F.lower("list_name").alias("k"), F.col("source_url").alias("s"), "title", "list_name", "category"))
    return rows.where("url IS NOT NULL AND list_id IS NOT NULL").groupBy("url", "list_id").agg(first.alias("f")).select("url", "list_id", "f.list_name", "f.title", "f.category", F.struct("f.k", "f.s", "list_id").alias("place"))


def merge_records(records: DataFrame) -> DataFrame:
    """Older records (url, title, description, source, line, category, seq) by URL: first title and description, and the
    different occurrences by source and line."""
    one = F.struct("source", "line", "title", "description", "category")
    return records.groupBy("url").agg(F.min_by("title", "seq").alias("title"), F.min_by("description", "seq").alias("description"), F.sort_array(F.collect_set(one)).alias("occurrences")).withColumn("id", project_id(F.col("url")))


def search_records(found: DataFrame, independent: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """id, url, title, list_count, independent_list_count and topics of projects. independent: id and that count;
    overrides: tags by phrase, a small dictionary, for labels that no known phrase covers ("none" is no tag)."""
    labels = F.transform("occurrences", lambda o: o["category"])
    pairs = [F.lit(x) for phrase, tag in (overrides or {}).items() if tag != "none" for x in (phrase, tag)]
    topics = distinct_topics(labels, overrides=F.create_map(*pairs) if pairs else None)
    rows = found.join(independent, "id", "left")
    return rows.select("id", "url", "title", "list_count", F.coalesce("independent_list_count", F.lit(0).cast("long")).alias("independent_list_count"), topics.alias("topics"))


def search(records: DataFrame, query: str, limit: int = 50, title: str = "title", topics: str | None = "topics", key: str = "id") -> DataFrame:
    """Records that hold every term in title or topics, with their score, best first: 10 for the whole phrase in the
    title, for each term 3 in the title and 1 in the topics. Terms are substrings, and repeated terms count again;
    citation counts play no part. An empty query finds nothing."""
    terms = terms_of(query)
    name = F.lower(title)
    tags = F.lower(F.array_join(topics, " ")) if topics else F.lit("")
    score = F.when(F.contains(name, F.lit(" ".join(terms))), 10).otherwise(0)
    for t in terms:
        score = score + F.when(F.contains(name, F.lit(t)), 3).otherwise(0) + F.when(F.contains(tags, F.lit(t)), 1).otherwise(0)
    text = F.concat_ws(" ", name, tags)
    found = records.where(all_terms_in(text, terms) if terms else F.lit(False)).withColumn("score", score.cast("long"))
    return found.orderBy(F.desc("score"), F.lower(title), key).limit(limit)


def citations(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Occurrences of the projects that a page shows: its ids meet the projects, by a broadcast where they are as few as a
    page's are, else by a shuffle."""
    return found.join(shown.select("id").distinct(), "id", "left_semi").select("id", F.explode("occurrences").alias("o")).select("id", "o.*")


def profile(found: DataFrame, liveness: DataFrame, usage: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Projects with what other artifacts know of them, as structs; null where an artifact has no record."""
    out = found
    for name, other in (("liveness", liveness), ("usage", usage), ("alternatives", alternatives)):
        own = [c for c in other.columns if c != "id"]
        out = out.join(other.select("id", F.struct(*own).alias(name)), "id", "left")
    return out


def stride_sample(rows: DataFrame, count: int, key: str = "id", total: int | None = None) -> DataFrame:
    """Every (n // count)-th row by key, at most count. n is counted where it isn't given."""
    n = rows.count() if total is None else total
    stride, order = max(1, n // max(1, count)), F.asc_nulls_last(key)
    numbered = rows.withColumn("_n", F.row_number().over(W.orderBy(order)) - 1) if n <= 100_000 else _ranked(rows, order)
    return numbered.where(F.col("_n") % stride == 0).orderBy("_n").limit(count).drop("_n")


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Row numbers _n without a single task: range partitions, counts per partition, and offsets added. Numbered rows are
    written by checkpoint() first, as a second run of the plan may cut other partitions, and its counts would be theirs."""
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, place in it in the lower 33
    parts = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    parts = parts.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    sizes = parts.groupBy("_p").count()
    ahead = sizes.withColumn("_before", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    return parts.join(F.broadcast(ahead.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p").withColumn("_n", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def top_and_random(rows: DataFrame, top: int, random: int, seed: int, key: str = "id", by: str = "list_count", at_least: int = 2) -> DataFrame:
    """The `top` rows by citations and `random` of the others, chosen by a seeded hash; kind says which."""
    enough = rows.where(F.col(by) >= at_least)
    first = enough.orderBy(F.desc(by), key).limit(top)
    rest = enough.join(first.select(key), key, "left_anti").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(random)
    return first.withColumn("kind", F.lit("top")).unionByName(rest.withColumn("kind", F.lit("random")))


def candidates(rows: DataFrame, had: DataFrame, limit: int, key: str = "id", by: str = "list_count", tie: str = "url") -> DataFrame:
    """The next rows to observe: not had yet, most cited first."""
    return rows.join(had.select(key), key, "left_anti").orderBy(F.desc(by), tie).limit(limit)


def stale(rows: DataFrame, had: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose input digest isn't the one that a record was made from, or without a record."""
    old = had.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return rows.join(old, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.col(digest).eqNullSafe(F.col("_d"))).drop("_k", "_d")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Records of new, and those of old that new doesn't have."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def work_queue(rows: DataFrame, done: DataFrame, size: int, key: str = "id", by: str = "stars") -> DataFrame:
    """What isn't done, most starred first, with its batch number."""
    left = rows.join(done.select(key), key, "left_anti")
    return _ranked(left, F.desc_nulls_last(by), F.asc_nulls_last(key)).withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
