"""Alternatives: other projects under the same heading of the same list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def alternatives(rows: DataFrame, limit: int = 3, key: str = "url", heading: tuple[str, ...] = ("list_id", "category"), title: str = "title") -> DataFrame:
    """heading, key, alternative, rank, total_alternatives, truncated: for each project of a heading up to `limit` others.

    The first limit + 1 of each heading, by title and key, are chosen once; every member then drops itself from them and
    takes the first `limit` of what is left. So a heading of n members costs n rows, not n squared. title is that of
    the first row of a project in its heading, by seq.
    """
    members = rows.groupBy(*heading, key).agg(F.min_by(title, "seq").alias("_t")) if "seq" in rows.columns else rows.groupBy(*heading, key).agg(F.min(title).alias("_t"))
    totals = members.groupBy(*heading).agg(F.count("*").alias("_n"))
    # ranks up to a constant: Spark limits each partition before the shuffle
    rank = F.row_number().over(W.partitionBy(*heading).orderBy(F.lower("_t"), key))
    top = members.withColumn("_r", rank).where(F.col("_r") <= limit + 1).select(*heading, F.col(key).alias("alternative"), F.col("_t").alias("alternative_title"), "_r")
    # a heading's first rows are `limit` + 1 at most, so they may be one array
    best = top.groupBy(*heading).agg(F.sort_array(F.collect_list(F.struct("_r", "alternative", "alternative_title"))).alias("_top")).join(totals, list(heading))
    own = members.join(best, list(heading))
    kept = F.slice(F.filter("_top", lambda x: x["alternative"] != F.col(key)), 1, limit)
    out = own.select(*heading, key, (F.col("_n") - 1).alias("total_alternatives"), (F.col("_n") - 1 > F.size(kept)).alias("truncated"), F.posexplode_outer(kept).alias("_i", "_a"))
    return out.select(*heading, key, "_a.alternative", "_a.alternative_title", (F.col("_i") + 1).cast("long").alias("rank"), "total_alternatives", "truncated")


def alternative_counts(found: DataFrame, key: str = "url") -> DataFrame:
    """How many different alternatives a project has over all its headings."""
    return found.groupBy(key).agg(F.count_distinct("alternative").alias("alternative_count"))
