"""Task lifecycles from events: starts, completions, cancellations and consumptions met by key.

Events: by columns, ``ord`` (unique within a run), ``t``, ``kind``, ``task``, ``resource`` and, where they apply,
``elapsed``, ``status``. A key's last event of each kind wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tasks(events: DataFrame, by: list[str], started: str, completed: str, cancelled: str, consumed: str, *, stubs: bool = False) -> DataFrame:
    """J1 (J2 with ``stubs``): one row a task with started_t, completed_t, cancelled_t, consumed_t and the last start's resource.

    Without stubs, what happens before the (last) start does not count, and a task needs a start. One
    shuffle, combined on the map side."""
    kinds = {"started": started, "completed": completed, "cancelled": cancelled, "consumed": consumed}
    last = [F.max_by(F.struct("ord", "t", "resource"), F.when(F.col("kind") == k, F.col("ord"))).alias(name) for name, k in kinds.items()]
    out = events.where(F.col("kind").isin(*kinds.values())).groupBy(*by, "task").agg(*last)
    out = out.select(*by, "task", *[F.when(F.col(c).isNotNull(), F.col(c)).alias(c) for c in kinds])
    after = lambda c: F.col(c) if stubs else F.when(F.col(f"{c}.ord") > F.col("started.ord"), F.col(c))
    if not stubs:
        out = out.where("started is not null")
    times = [after(c).getField("t").alias(f"{c}_t") for c in ("completed", "cancelled", "consumed")]
    return out.select(*by, "task", F.col("started.resource").alias("resource"), F.col("started.t").alias("started_t"), *times)


def resource_timings(events: DataFrame, by: list[str], started: str, completed: str, consumed: str) -> DataFrame:
    """Per resource the last start, the last completion of what was then its current task, the last consumption.

    A restart keeps the older completion, so completed_t may lie before started_t."""
    w = Window.partitionBy(*by, "resource").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    current = F.last(F.when(F.col("kind") == started, F.col("task")), ignorenulls=True).over(w)
    rows = events.where(F.col("kind").isin(started, completed, consumed)).withColumn("_current", current)
    pick = lambda cond: F.max_by("t", F.when(cond, F.col("ord")))
    return rows.groupBy(*by, "resource").agg(
        F.max_by("task", F.when(F.col("kind") == started, F.col("ord"))).alias("task"),
        pick(F.col("kind") == started).alias("started_t"),
        pick((F.col("kind") == completed) & (F.col("task") == F.col("_current"))).alias("completed_t"),
        pick(F.col("kind") == consumed).alias("consumed_t"),
    ).where("started_t is not null")


def completion_time(started, elapsed, event_t):
    """Hazard 2: start + elapsed where both are truthy, else the event's own time."""
    return F.when((F.coalesce(started, F.lit(0)) != 0) & (elapsed > 0), started + elapsed).otherwise(event_t)


def gate_exposure(rows: DataFrame, by: list[str], group: str, exposure: str) -> DataFrame:
    """Exposure per key: the greatest of each gate group, plus all that has no group."""
    lone = F.coalesce(F.col(group), F.lit("")) == ""
    # ungrouped rows add up; a gate's rows stall one interval, so their greatest counts
    per = rows.groupBy(*by, F.when(~lone, F.col(group)).alias("_g")).agg(F.max(exposure).alias("_max"), F.sum(exposure).alias("_sum"))
    return per.groupBy(*by).agg(F.sum(F.when(F.col("_g").isNull(), F.col("_sum")).otherwise(F.col("_max"))).alias("exposure"))


def taxonomy(rows: DataFrame, by: list[str], cell: list[str], group: str, exposure: str, cls: str, ordinal: str) -> DataFrame:
    """Exposure by cell and class, one class a gate: the first of the greatest exposure.

    A class that led its gate for a while and then lost it keeps a cell of 0; rows without a gate count
    for themselves."""
    gated = rows.where((F.coalesce(F.col(group), F.lit("")) != "") & (F.col(cls) != ""))
    w = Window.partitionBy(*by, group).orderBy(ordinal)
    lead = F.max(exposure).over(w.rowsBetween(Window.unboundedPreceding, -1))
    led = gated.withColumn("_lead", lead).where(F.col("_lead").isNull() | (F.col(exposure) > F.col("_lead")))
    last = F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc(ordinal)))
    won = led.withColumn("_s", F.when(last == 1, F.col(exposure)).otherwise(F.col(exposure) * 0))
    lone = rows.where((F.coalesce(F.col(group), F.lit("")) == "") & (F.col(cls) != "")).withColumn("_s", F.col(exposure))
    return won.select(*cell, cls, "_s").unionByName(lone.select(*cell, cls, "_s")).groupBy(*cell, cls).agg(F.sum("_s").alias("seconds"))
