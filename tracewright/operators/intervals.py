"""Interval operators on keyed rows: merge, length, intersection, subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """By, start, end of the union; intervals that touch are one. One shuffle by key."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def total_length(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return merge(df, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def intersection_length(a: DataFrame, b: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Length of the intersection of two interval sets per key, as a sweep: no pairs are formed.

    len(A and B) = len(A) + len(B) - len(A or B)."""
    tagged = a.select(*by, start, end).union(b.select(*by, start, end))
    one = total_length(a, by, start, end).withColumnRenamed("length", "_a")
    two = total_length(b, by, start, end).withColumnRenamed("length", "_b")
    both = total_length(tagged, by, start, end).withColumnRenamed("length", "_u")
    return both.join(one, by, "left").join(two, by, "left").select(*by, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)) - F.col("_u")).alias("overlap"))


def subtract(spans: DataFrame, cuts: DataFrame, by: list[str], least=0, start: str = "start", end: str = "end") -> DataFrame:
    """What is left of each span (spans of a key do not overlap) outside all cuts; pieces longer than ``least``.

    Sweep over the ends of spans and merged cuts: a piece runs between neighbours where a span and no cut is open."""
    ends = spans.select(*by, F.col(start).alias("_t"), F.lit(1).alias("_s"), F.lit(0).alias("_c")).union(spans.select(*by, F.col(end), F.lit(-1), F.lit(0)))
    merged = merge(cuts.select(*by, start, end), by, start, end)
    ends = ends.union(merged.select(*by, F.col(start), F.lit(0), F.lit(1))).union(merged.select(*by, F.col(end), F.lit(0), F.lit(-1)))
    at = ends.groupBy(*by, "_t").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"), F.max(F.abs("_s")).alias("_edge"))
    w = Window.partitionBy(*by).orderBy("_t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select(*by, F.col("_t").alias(start), F.lead("_t").over(w).alias(end), F.sum("_s").over(run).alias("_s"), F.sum("_c").over(run).alias("_c"))
    return swept.where((F.col("_s") > 0) & (F.col("_c") == 0) & (F.col(end) - F.col(start) > least)).drop("_s", "_c")


def first_overlap(left: DataFrame, right: DataFrame, by: list[str], slack, column: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each left interval with ``column`` of the first right one (by start, then ``column``) that it meets, null if there is none;
    right ends count ``slack`` longer.

    One sorted pass, no pairs: from late ends to early ones the first right interval that still ends after the left one's start is
    carried along. It starts before all others of its sort, so if it starts too late, none meets the left one."""
    l = left.withColumn("_row", F.struct(*left.columns)).select(*by, (F.col(start) - slack).alias("_t"), F.lit(1).alias("_side"), "_row", F.lit(None).alias("_right"))
    r = right.select(*by, F.col(end).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(F.col(start).alias("s"), F.col(column).alias("v")).alias("_right"))
    w = Window.partitionBy(*by).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = l.unionByName(r).withColumn("_first", F.min("_right").over(w)).where("_row is not null")
    return met.select("_row.*", F.when(F.col("_first.s") <= F.col(f"_row.{end}"), F.col("_first.v")).alias(column))
