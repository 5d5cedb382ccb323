"""Run metrics and rollups with null-versus-zero rules (A1-A45, W1, W2, L*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b)


def sample_std(c: Column | str) -> Column:
    """Sample standard deviation, 0 for a single value, null for none."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def prediction_quality(hits: Column, misses: Column, made: Column) -> list[Column]:
    """A2: precision, coverage, honest."""
    return [ratio(hits, hits + misses).alias("precision"), ratio(hits + misses, made).alias("coverage"), ratio(hits, made).alias("honest")]


def stall_and_benefit(started: Column, completed: Column, consumed: Column, estimate: Column) -> dict[str, Column]:
    """A3: per resource, by the analyzer's clock: overlap, stall, est_benefit, unused_load."""
    used = consumed.isNotNull() & started.isNotNull()
    stall = F.when(used & completed.isNotNull(), F.greatest(F.lit(0), completed - consumed)).otherwise(F.lit(0))
    return {
        "overlap": F.when(used, F.greatest(F.lit(0), F.least(F.coalesce(completed, consumed), consumed) - started)).otherwise(F.lit(0)),
        "stall": stall,
        "est_benefit": F.when(used & estimate.isNotNull(), F.greatest(F.lit(0), estimate - stall)).otherwise(F.lit(0)),
        "unused_load": F.when(consumed.isNull() & completed.isNotNull(), completed - started).otherwise(F.lit(0)),
    }


def task_timing(started: Column, ended: Column, needed: Column, cancelled: Column, wasted: Column) -> dict[str, Column]:
    """A4: per task: overlap, slack (needed after the end) and late (before it); 0 where cancelled, and for the
    last two where wasted. Hazard 13: nothing where a time is missing."""
    known = started.isNotNull() & ended.isNotNull() & needed.isNotNull() & ~cancelled
    return {
        "overlap": F.when(known, F.greatest(F.lit(0), F.least(ended, needed) - started)).otherwise(F.lit(0)),
        "slack": F.when(known & ~wasted, F.greatest(F.lit(0), needed - ended)).otherwise(F.lit(0)),
        "late": F.when(known & ~wasted, F.greatest(F.lit(0), ended - needed)).otherwise(F.lit(0)),
    }


def rollup_vs_baseline(df: DataFrame, over: list[str], config: str, baseline, value: str) -> DataFrame:
    """N, mean, std, share of and speedup against the baseline's mean, per (over, config)."""
    stats = df.groupBy(*over, config).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sample_std(value).alias("std"))
    base = stats.where(F.col(config) == baseline).select(*over, F.col("mean").alias("_base"))
    return stats.join(base, over, "left").withColumn("normalised", ratio(F.col("mean"), F.col("_base"))).withColumn("speedup", ratio(F.col("_base"), F.col("mean"))).drop("_base")


def calibration(df: DataFrame, confidence: str, hit: str, edges=(0.0, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Bucket floor, midpoint, hit rate and n; the last bucket ends at 1; empty buckets are absent."""
    out = None
    c = F.col(confidence)
    for low, high in reversed(list(zip(edges, [*edges[1:], 1.01], strict=True))):
        own = F.struct(F.lit(low).alias("low"), F.lit(round((low + min(high, 1.0)) / 2, 6)).alias("mid"))
        out = F.when((c >= low) & (c < high), own) if out is None else F.when((c >= low) & (c < high), own).otherwise(out)
    rows = df.withColumn("_b", out).where("_b is not null")
    return rows.groupBy(F.col("_b.low").alias("low"), F.col("_b.mid").alias("mid")).agg(F.avg(F.col(hit).cast("int")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def idle_stats(df: DataFrame, by: list[str], t: str, ord_: str, utils: list[str], mems: list[str]) -> DataFrame:
    """Idle time (all utilisations exactly 0), span, mean utilisation, peak total memory; a sample's time is that since
    the one before, so the first has none and does not count."""
    w = Window.partitionBy(*by).orderBy(ord_)
    rows = df.withColumn("_d", F.col(t) - F.lag(t).over(w)).where("_d is not null").withColumn("_d", F.greatest(F.lit(0), "_d"))
    all_idle = F.lit(True)
    for u in utils:
        all_idle = all_idle & (F.col(u) == 0)
    util = sum((F.col(u) for u in utils), F.lit(0)) / len(utils)
    mem = sum((F.col(m) for m in mems), F.lit(0))
    out = rows.groupBy(*by).agg(F.sum(F.when(all_idle, F.col("_d")).otherwise(0)).alias("idle"), F.sum("_d").alias("span"), F.avg(util).alias("mean_util"), F.max(mem).alias("peak_mem"))
    return out.withColumn("idle_fraction", ratio(F.col("idle"), F.col("span")))


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Three points, zeros beyond the edges, always divided by 3; series under three points stay."""
    w = Window.partitionBy(*by)
    smooth = F.sum(value).over(w.orderBy(*order).rowsBetween(-1, 1)) / 3
    return df.withColumn("smooth", F.when(F.count(F.lit(1)).over(w) < 3, F.col(value).cast("double")).otherwise(smooth))


def joined_sources(c: Column | str) -> Column:
    """Sorted distinct sources joined by +, without unknown; unknown if none is left."""
    names = F.array_join(F.array_sort(F.array_remove(F.collect_set(c), "unknown")), "+")
    return F.when(names == "", "unknown").otherwise(names)


def first_in_allocation(runs: DataFrame, job: str, start: str, run: str, ord_: str) -> DataFrame:
    """The first run of each job by start text (ties: first seen); blank jobs and starts do not count."""
    real = runs.where((F.coalesce(F.col(job), F.lit("")) != "") & (F.coalesce(F.col(start), F.lit("")) != ""))
    return real.groupBy(job).agg(F.min_by(run, F.struct(start, ord_)).alias(run))


def mixed_groups(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The groups with more than one value, and how many."""
    return df.groupBy(*by).agg(F.countDistinct(value).alias("kinds")).where("kinds > 1")


def source_verdict(hit_ratio: Column, net_bytes: Column, elapsed: Column) -> Column:
    """page_cache, nfs, mixed or unknown by votes. The cache-hit ratio has three votes at its ends, one for each side in
    between and one for unknown where it is not known; the network's received bytes have two for the network or, where next to
    nothing came in a load of over ten seconds, one for the cache."""
    high, low, much, little = 0.90, 0.15, 1.0, 0.01
    gb, none = net_bytes / 1e9, F.lit(0)
    cache = F.when(hit_ratio >= high, 3).when(hit_ratio > low, 1).otherwise(none) + F.when((gb < little) & (elapsed > 10), 1).otherwise(none)
    nfs = F.when(hit_ratio >= high, none).when(hit_ratio <= low, 3).when(hit_ratio.isNotNull(), 1).otherwise(none) + F.when(gb > much, 2).otherwise(none)
    unknown = F.when(hit_ratio.isNull(), 1).otherwise(none)
    return F.when((cache > nfs) & (cache > unknown), "page_cache").when((nfs > cache) & (nfs > unknown), "nfs").when((nfs > 0) & (cache > 0), "mixed").otherwise("unknown")


def fill_missing(left: DataFrame, right: DataFrame, key: str, columns: list[str], present: str = "keys") -> DataFrame:
    """Right values fill in only what the left row does not have at all: ``present`` lists the keys it has, so a
    present null stays null."""
    r = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = left.join(r, key, "left")
    return out.select(key, *[F.when(F.array_contains(present, c), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns])
