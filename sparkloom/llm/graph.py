"""Connected components by contraction: every vertex points at its smallest neighbour, edges move along, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each vertex of edges (a, b) the smallest id that it is connected with.

    Ids may be of any type that can be ordered; null ends and loops don't count, repeated edges count once. Each round
    halves the vertices at least, is written to the shared folder, and costs partial aggregates and equi-joins only.
    """
    edges = common.written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    left = edges.count()
    vertices = 2 * left
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"))
    while left:
        lowest = edges.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("to"))
        to_a, to_b = lowest.toDF("a", "_a"), lowest.toDF("b", "_b")
        old_labels, old_edges = labels, edges
        labels = common.written(labels.join(lowest, labels["component"] == lowest["of"], "left").select("id", F.coalesce("to", "component").alias("component")), "cc-labels", vertices)
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        edges = common.written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges", left)
        left = edges.count()
        common.discard(old_labels, old_edges)
    return labels
