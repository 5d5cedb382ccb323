"""Distributed union-find: connected components of an edge table by alternating star steps.

Each step is a few shuffles of the edges; the table is cut to the shared folder after every round, and
nothing but a yes or no reaches the driver. A node with very many neighbours is pre-aggregated (``min``)
before the shuffle and its edges meet the result in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges (a over b) are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    odd = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b: one orderable type).

    Self-edges and repeated edges are allowed; an edge with a null end is dropped."""
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_done(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        old, now = now, cut(small.distinct(), "edges")
        drop(old)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


def add_edges(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components (node, root) after more edges: only roots take part, so the graph shrinks from call to call."""
    if roots is None:
        return components(edges)
    met = label(label(edges, roots, "a", "x"), roots, "b", "y")
    joined = components(met.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return moved.union(joined.join(roots, "node", "left_anti").select("node", "root"))


def label(df: DataFrame, roots: DataFrame | None, column: str, name: str) -> DataFrame:
    """``df`` with the component of ``column`` so far (itself where it has no link)."""
    if roots is None:
        return df.withColumn(name, F.col(column))
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")
