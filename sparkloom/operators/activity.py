"""Liveness and usage of projects: release cadence, registry records, discovery partitions, contributors."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import DAY, micros
from ..functions.urls import REFERENCE, refers_to


def release_cadence(releases: DataFrame, key: str, at: str, most: int | None = None) -> DataFrame:
    """key, observed_count, latest_at, median_interval_days of releases with a date; of the last `most` where given.

    Intervals are whole days between neighbours; the median of an even number is the mean of the middle two, and null
    with fewer than two releases.
    """
    dated = releases.where(F.col(at).isNotNull())
    w = W.partitionBy(key).orderBy(F.desc(at))
    if most:
        dated = dated.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    gaps = dated.withColumn("_gap", F.floor((micros(F.col(at)) - F.lead(micros(F.col(at))).over(w)) / F.lit(float(DAY))))
    return gaps.groupBy(key).agg(F.count("*").alias("observed_count"), F.max(at).alias("latest_at"), F.median("_gap").alias("median_interval_days"))


def usage_records(projects: DataFrame, packages: DataFrame) -> DataFrame:
    """Registry packages of projects: those whose metadata names the repository, one for each registry, the most used.

    projects: id, owner, repo; packages: registry, package, count, metric, repository. Candidates meet by the repository's
    name in lower case, then the whole reference is compared.
    """
    name = F.lower(F.regexp_extract("repository", REFERENCE, 2))
    rows = projects.withColumn("_n", F.lower("repo")).join(packages.withColumn("_n", name), "_n").where(refers_to(F.col("repository"), F.col("owner"), F.col("repo")))
    best = rows.groupBy("id", "registry").agg(F.max_by(F.struct("package", "count", "metric"), F.struct(F.col("count"), F.col("package"))).alias("b"))
    return best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("registry", "b.package", "b.count", "b.metric"))).alias("sources"))  # one row a registry


def top_contributors(commits: DataFrame, key: str, login: str, most: int = 10) -> DataFrame:
    """The logins with most commits, per key, and how many different ones there are."""
    counts = commits.where(F.col(login).isNotNull()).groupBy(key, login).agg(F.count("*").alias("contributions"))
    w = W.partitionBy(key)
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("contributions"), F.lower(login), login)))
    total = counts.groupBy(key).agg(F.count("*").alias("public_contributors"))
    return ranked.where(F.col("rank") <= most).join(total, key)


def reconcile(hits: DataFrame, partition: str, key: str, total: str, incomplete: str | None = None) -> DataFrame:
    """partition, received, unique_ids, totals, state: reconciled if one total was reported and so many ids came."""
    bad = F.bool_or(F.col(incomplete)) if incomplete else F.lit(False)
    rows = hits.groupBy(partition).agg(F.count("*").alias("received"), F.count_distinct(key).alias("unique_ids"), F.count_distinct(total).alias("totals"), F.max(total).alias("_t"), bad.alias("_bad"))
    fine = (F.col("totals") == 1) & (F.col("unique_ids") == F.col("_t")) & ~F.col("_bad")
    return rows.select(partition, "received", "unique_ids", "totals", F.when(F.coalesce(fine, F.lit(False)), "reconciled").otherwise("unresolved").alias("state"))


def merged_candidates(hits: DataFrame, key: str = "id", query: str = "query", seq: str = "seq", columns: tuple[str, ...] = ()) -> DataFrame:
    """The first observation of each id, and all queries that found it."""
    return hits.groupBy(key).agg(F.min_by(F.struct(*columns), seq).alias("first"), F.sort_array(F.collect_set(query)).alias("queries"))


def split_partition(start: str, end: str, low: int, high: int | None, most: int = 1_000_000) -> list[tuple[str, str, int, int | None]] | None:
    """Two halves of a search partition that found too much: by date, then by stars; None where it can't be split."""
    a, z = date.fromisoformat(start), date.fromisoformat(end)
    if a < z:
        mid = a + timedelta(days=(z - a).days // 2)
        return [(start, mid.isoformat(), low, high), ((mid + timedelta(days=1)).isoformat(), end, low, high)]
    top = most if high is None else high
    if low < top:
        mid = (low + top) // 2
        return [(start, end, low, mid), (start, end, mid + 1, high)]
    return None


def published_repository(proposals: DataFrame, lists: DataFrame) -> DataFrame:
    """proposals (url, parent_url) with list_id: the published list of the URL itself, or else of the repository that it was
    forked from. Closing slashes and letter case don't count."""
    plain = lambda c: F.lower(F.rtrim(F.col(c), F.lit("/")))
    known = lists.where("public AND state = 'eligible'").select(plain("url").alias("_u"), F.col("id").alias("_id"))
    own, parent = known.toDF("_a", "own_id"), known.toDF("_b", "parent_id")
    rows = proposals.join(own, plain("url") == F.col("_a"), "left").join(parent, plain("parent_url") == F.col("_b"), "left")
    return rows.select(*proposals.columns, F.coalesce("own_id", "parent_id").alias("list_id"))
