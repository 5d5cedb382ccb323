"""As-of joins within a key by one sorted pass over the union of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, value: Column, right_first: bool) -> DataFrame:
    l = left.withColumn("_row", F.struct(*left.columns)).select(*by, F.col(left_t).alias("_t"), F.lit(1 if right_first else 0).alias("_side"), "_row", F.lit(None).alias("_value"))
    r = right.select(*by, F.col(right_t).alias("_t"), F.lit(0 if right_first else 1).alias("_side"), F.lit(None).alias("_row"), value.alias("_value"))
    return l.unionByName(r)


def backward(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, columns: list[str], *, tie: str | None = None, equal: bool = True) -> DataFrame:
    """Each left row with the latest right row at or before it (before it, if not ``equal``); null if there is none.

    Ties on the right end with the greatest ``tie``. Both sides shuffle once, by key."""
    value = F.struct(F.col(right_t).alias("_at"), *columns, *([F.col(tie).alias("_tie")] if tie else []))
    w = Window.partitionBy(*by).orderBy("_t", "_side", F.col("_value._tie") if tie else F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)
    out = _stacked(left, right, by, left_t, right_t, value, equal).withColumn("_hit", F.last("_value", ignorenulls=True).over(w)).where("_row is not null")
    return out.select("_row.*", F.col("_hit._at").alias("matched_t"), *[F.col(f"_hit.{c}").alias(c) for c in columns])


def forward(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, columns: list[str], *, tie: str | None = None, else_last: bool = False) -> DataFrame:
    """Each left row with the earliest right row at or after it; ``else_last``: with the key's last one if there is none."""
    value = F.struct(F.col(right_t).alias("_at"), *([F.col(tie).alias("_tie")] if tie else []), *columns)
    order = ["_t", "_side", F.col("_value._tie") if tie else F.lit(0)]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    hit = F.first("_value", ignorenulls=True).over(w)
    if else_last:
        hit = F.coalesce(hit, F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = _stacked(left, right, by, left_t, right_t, value, False).withColumn("_hit", hit).where("_row is not null")
    return out.select("_row.*", F.col("_hit._at").alias("matched_t"), *[F.col(f"_hit.{c}").alias(c) for c in columns])


def first_per_key(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the columns of the first row by ``order`` (end it with a unique column); map-side combined."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def last_per_key(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the columns of the last row."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def within_rows(df: DataFrame, by: list[str], order: list[str], value: Column, n: int) -> Column:
    """The nearest non-null value in the ``n`` rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1))
