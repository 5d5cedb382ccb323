"""Places and ranks in orders of any size.

A place in a total order needs no task that sees all rows: the rows are dealt by ranges of the order, sorted and written once, with each
row's place in its range, and the ranges' counts, a row a partition, are taken from what was written. A single rank needs no sort at all: a
histogram says which bucket holds it, and only that bucket's rows are looked at again. Groups of up to ``WINDOW`` rows take
a window, which one task can sort; that changes the plan, not the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Rows of a group that one window may number, and buckets of a histogram.
WINDOW, BUCKETS = 1_000_000, 64
#: Bits of ``monotonically_increasing_id`` below the partition.
_PLACE = 33


def _largest(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` (a row a group), null groups included."""
    other = right.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return left.join(other, same, how).drop(*[f"_by_{c}" for c in by])


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """L1, L2: each row's place (from 1) in a total order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(ranged, "ranges").withColumn("_p", F.shiftright("_id", _PLACE))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << _PLACE) - 1) + 1).drop("_p", "_id", "_before")


def placed_within(df: DataFrame, by: list[str], order: list[str], name: str = "place", total: str | None = None) -> DataFrame:
    """Each row's place (from 1) in its group and, if named, the group's rows; the order is total within a group."""
    if _largest(df, by) <= WINDOW:
        w = Window.partitionBy(*by)
        out = df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out
    rows = placed(df, [*by, *order], "_overall")
    firsts = rows.groupBy(*by).agg(F.min("_overall").alias("_first"), F.count(F.lit(1)).alias(total or "_total"))
    out = _joined(rows, firsts, by).withColumn(name, F.col("_overall") - F.col("_first") + 1)
    return out.drop("_overall", "_first", *([] if total else ["_total"]))


def with_previous(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in the group, null at its first row."""
    if _largest(df, by) <= WINDOW:
        return df.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))
    rows = placed(df, [*by, *order], "_overall")
    # a row meets the one before by its place, which no two rows share
    before = rows.select((F.col("_overall") + 1).alias("_overall"), F.struct(*by).alias("_group"), F.col(column).alias("_value"))
    out = rows.join(before, "_overall", "left")
    return out.withColumn(name, F.when(F.col("_group").eqNullSafe(F.struct(*by)), F.col("_value"))).drop("_overall", "_group", "_value")


def nth(df: DataFrame, by: list[str], value: str, place: Column) -> DataFrame:
    """by, value, rest: each group's number at ``place`` (from 0; a column over the group's count ``n``) and how many of its equals
    come before that place. Nulls do not take part; groups of nulls alone are absent.

    Each turn splits the groups still large at quantiles, which they estimate for themselves, and keeps the rows of the bucket that holds the
    place; numbers equal to a quantile are a bucket of their own, so turns end whatever the ties."""
    now = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    want = now.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, place.cast("bigint").alias("_want"))
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    while True:
        state = now.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", shares, 1000).alias("_cuts"))
        state = kept(state.withColumn("_open", (F.col("_n") > WINDOW) & (F.col("_lo") < F.col("_hi"))), "ranks")
        if state.where("_open").isEmpty():
            break
        cut = F.array_distinct("_cuts")
        below = F.size(F.filter(cut, lambda c: c < F.col("_v"))) + F.size(F.filter(cut, lambda c: c <= F.col("_v")))
        rows = _joined(now, state.select(*by, "_cuts", "_open"), by).withColumn("_b", F.when(F.col("_open"), below).otherwise(0)).select(*by, "_v", "_b")
        counts = _joined(rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")), want, by)  # at most 2 * BUCKETS rows a group
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b"))
        chosen = kept(counts.withColumn("_upto", upto).where("_upto > _want and _upto - _c <= _want").select(*by, "_b", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_want")), "ranks")
        now = kept(_joined(rows, chosen.select(*by, F.col("_b").alias("_own")), by).where("_b = _own").select(*by, "_v"), "ranks")
        want = chosen.drop("_b")
    ended = _joined(state.select(*by, "_lo", "_hi"), want, by)
    equal = ended.where("_lo = _hi").select(*by, F.col("_lo").alias(value), F.col("_want").alias("rest"))
    w = Window.partitionBy(*by).orderBy("_v")
    few = _joined(now, ended.where("_lo < _hi").select(*by, "_want"), by).withColumns({"_r": F.row_number().over(w), "_first": F.rank().over(w)})
    return equal.union(few.where("_r = _want + 1").select(*by, F.col("_v").alias(value), (F.col("_want") + 1 - F.col("_first")).alias("rest")))


def upper_median(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Each group's row at place n // 2 (from 0) by (value, tie), both numbers; rows without a value do not take part."""
    real = df.where(F.col(value).isNotNull())
    if _largest(real, by) <= WINDOW:
        w = Window.partitionBy(*by)
        rows = real.withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count(F.lit(1)).over(w))
        return rows.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")
    found = kept(nth(real, by, value, F.floor(F.col("n") / 2)), "ranks")
    equal = _joined(real, found.withColumnRenamed(value, "_value"), by).where(F.col(value) == F.col("_value"))
    # among equals the place is what is left; it is carried as the same number by every row of the group
    place = found.select(*by, "rest")
    ties = _nth_at(equal.select(*by, F.col(tie).alias("_tie")), by, "_tie", place)
    met = _joined(equal.drop("rest"), ties.select(*by, F.col("_tie").alias("_at")), by).where(F.col(tie).eqNullSafe(F.col("_at")))
    return met.groupBy(*by).agg(F.first(F.struct(*df.columns)).alias("_row")).select("_row.*")


def _nth_at(df: DataFrame, by: list[str], value: str, places: DataFrame) -> DataFrame:
    """``nth`` at a place given by group (by, rest)."""
    rows = _joined(df, places.withColumnRenamed("rest", "_place"), by)
    # the place is made part of the group, so that it can be read where the group's rows are counted
    return nth(rows, [*by, "_place"], value, F.col("_place")).drop("_place", "rest")


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median (double): the mean of the middle two, nulls left out."""
    real = df.where(F.col(value).isNotNull())
    if _largest(real, by) <= WINDOW:
        return real.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), 0.5).alias("median"))
    low, high = (nth(real, by, value, F.floor((F.col("n") - d) / 2)).select(*by, F.col(value).cast("double").alias(name)) for d, name in ((1, "_low"), (0, "_high")))
    return _joined(low, high, by).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def empirical_cdf(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """(i + 1) / n in value order; ties keep their own steps."""
    return placed_within(df, by, [value, tie], "_place", "_total").withColumn("cdf", F.col("_place") / F.col("_total")).drop("_place", "_total")
