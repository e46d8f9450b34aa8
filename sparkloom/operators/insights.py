"""Figures over lists: dashboard, histograms, comparison, snapshot differences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import bucket, bucket_rank
from ..functions.dates import RANGE_ORDER


def eligible(lists: DataFrame) -> DataFrame:
    return lists.where("public AND state = 'eligible'")


def dashboard(lists: DataFrame, stars: str = "stars", entries: str = "entry_count", fresh: str = "fresh_range", days: str = "fresh_days") -> DataFrame:
    """One row: population, total_entries, entries_known, entries_unknown, median_stars, fresh_30, freshness_known,
    freshness_unknown. Unknown is never zero, but the total of nothing is."""
    known = F.count(entries)
    return lists.agg(
        F.count("*").alias("population"), F.coalesce(F.sum(entries), F.lit(0)).cast("long").alias("total_entries"), known.alias("entries_known"), (F.count("*") - known).alias("entries_unknown"),
        F.coalesce(F.bround(F.median(stars)), F.lit(0)).cast("long").alias("median_stars"), F.count_if(F.col(fresh) == RANGE_ORDER[0]).alias("fresh_30"),
        F.count(days).alias("freshness_known"), (F.count("*") - F.count(days)).alias("freshness_unknown"),
    )


def topic_counts(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("lists")).orderBy(F.desc("lists"), "topic")


def freshness_counts(lists: DataFrame, fresh: str = "fresh_range") -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, RANGE_ORDER)), F.col("label"))
    return lists.groupBy(F.coalesce(fresh, F.lit("Unknown")).alias("label")).agg(F.count("*").alias("lists")).withColumn("rank", rank).where("rank > 0").orderBy("rank").drop("rank")


def histogram(rows: DataFrame, value: str, buckets, unknown: bool) -> DataFrame:
    """label, rank, n for each bucket that has rows, in order; unknown keeps a row for values without a bucket."""
    out = rows.groupBy(bucket(F.col(value), buckets).alias("label")).agg(F.count("*").alias("n")).withColumn("rank", bucket_rank(F.col("label"), buckets).cast("long"))
    return (out if unknown else out.where("label <> 'Unknown'")).orderBy("rank")


def compare(lists: DataFrame, ids: list, key: str = "id", most: int = 4) -> DataFrame:
    """The lists asked for, in that order with its number: the first `most` different ids are taken before lists that
    aren't eligible go."""
    spark = lists.sparkSession
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(list(dict.fromkeys(ids))[:most])], f"`{key}` {dict(lists.dtypes)[key]}, place long")
    return eligible(lists).join(F.broadcast(wanted), key).orderBy("place")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and before/after of each tracked column, for rows that differ."""
    old, new = (df.select(key, F.lit(True).alias("_in"), *(F.col(c).alias(c) for c in tracked)) for df in (before, after))
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    differs: Column = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col("o._in").isNull(), "added").when(F.col("n._in").isNull(), "removed").when(differs, "changed")
    out = rows.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), change.alias("change"), *(x for c in tracked for x in (F.col(f"o.{c}").alias(f"{c}_before"), F.col(f"n.{c}").alias(f"{c}_after"))))
    return out.where(F.col("change").isNotNull())


def render_diff(diff: DataFrame, key: str, name: str, tracked: list[str], shown: int | None = None) -> Iterator[str]:
    """Lines of a change log. Changes are counted first and then read one partition at a time, so a log may be longer than
    the driver's memory; with `shown` so many of each kind are listed, and a line says how many more there are."""
    counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    if not counts:
        yield "No catalogue changes."
    for kind in ("added", "removed", "changed"):
        if kind not in counts:
            continue
        yield f"### {kind.capitalize()} ({counts[kind]})"
        rows = diff.where(F.col("change") == kind).orderBy(key)
        for r in (rows if shown is None else rows.limit(shown)).toLocalIterator():
            moved = [f"{c}: {r[f'{c}_before']} -> {r[f'{c}_after']}" for c in tracked if kind == "changed" and r[f"{c}_before"] != r[f"{c}_after"]]
            yield f"- {r[name]}" + (f" ({'; '.join(moved)})" if moved else "")
        if shown is not None and counts[kind] > shown:
            yield f"- and {counts[kind] - shown} more"


def prepended(old: str, title: str, lines: Iterator[str]) -> str:
    """A change log with a new entry above the older ones, below its first heading."""
    head, rest = (old.split("\n", 1) + [""])[:2] if old.startswith("# ") else ("# Changelog", old)
    return f"{head}\n\n## {title}\n\n" + "\n".join(lines) + "\n" + (f"\n{rest.lstrip()}" if rest.strip() else "")
