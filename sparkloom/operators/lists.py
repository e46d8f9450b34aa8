"""Lists: rows of the index from metadata and parsed READMEs, rows of search results, fields that a reviewer sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import eligibility, topics_of
from ..functions.dates import freshness
from ..functions.markdown import source_links

FALLBACK_SCOPE = "Explore the upstream list for its stated scope."


def repository_rows(hits: DataFrame) -> DataFrame:
    """Search hits as metadata of repositories: one row for each id, by the first observation; flags that are unknown stay
    unknown, numbers below zero become unknown."""
    whole = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    rows = hits.select("id", "name", "url", "description", F.lit(True).alias("public"), whole("stars"), whole("forks"), "archived", "observed_at")
    names = [c for c in rows.columns if c not in ("id", "observed_at")]
    return rows.groupBy("id").agg(F.min(F.struct("observed_at", *names)).alias("r")).select("id", "r.*")


def list_profiles(meta: DataFrame, parsed: DataFrame, readmes: DataFrame) -> DataFrame:
    """Rows of the index: meta (id, name, description, github_topics, public, stars, content_updated_at, observed_at and
    others) with state, reason, topics, scope, freshness, and the counts of the parsed README.

    parsed: as of markdown.parse_readmes; readmes: id, markdown. What isn't public keeps no content: its counts are null.
    """
    own = parsed.where("error IS NULL").select(F.col("id").alias("_id"), "entry_count", "unique_links", "category_count")
    rows = meta.drop("entry_count", "unique_links", "category_count").join(own, meta["id"] == F.col("_id"), "left")
    rows = rows.join(readmes.select(F.col("id").alias("_rid"), F.col("markdown").alias("_text")), rows["id"] == F.col("_rid"), "left")
    public = F.coalesce("public", F.lit(False))
    seen = lambda c: F.when(public, F.col(c))
    labels = F.coalesce("github_topics", F.array().cast("array<string>"))
    judged = eligibility(F.col("public"), F.col("stars"), seen("unique_links"), F.col("name"), F.col("description"), labels, F.when(public, F.substring("_text", 1, 100_000)))
    text = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), F.array_join(labels, " "))
    scope = F.substring(F.coalesce(F.nullif("description", F.lit("")), F.lit(FALLBACK_SCOPE)), 1, 500)
    kept = [c for c in meta.columns if c not in ("entry_count", "unique_links", "category_count", "state", "reason", "topics", "scope", "freshness")]
    return rows.select(
        *(F.col(c) for c in kept), judged["state"].alias("state"), judged["reason"].alias("reason"), topics_of(text).alias("topics"), scope.alias("scope"), freshness(F.col("content_updated_at"), F.col("observed_at")).alias("freshness"),
        seen("entry_count").alias("entry_count"), seen("unique_links").alias("unique_links"), seen("category_count").alias("category_count"), F.when(public, source_links("_text")).alias("source_data_links"),
    )


def candidate_fields(lists: DataFrame, details: DataFrame, most: int = 8) -> DataFrame:
    """What a reviewer of a pending list sees: id, name, description, sorted topics, counts and the first entries' titles."""
    sample = details.select(F.col("repository_id").alias("id"), F.transform(F.slice("entries", 1, most), lambda e: e["title"]).alias("sample"))
    rows = lists.where("state = 'pending'").join(sample, "id", "left")
    return rows.select("id", "name", "description", F.sort_array("topics").alias("topics"), "stars", "entry_count", "unique_links", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def search_query(base: str, start: str, end: str, low: int, high: int | None) -> str:
    """A search partition as a query string."""
    return f"{base} stars:{low}..{'*' if high is None else high} created:{start}..{end}"
