"""Registry, predictors and rankings as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a registry that may be broadcast.
SMALL = 100_000


def maybe_broadcast(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, broadcast if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merge_registries(sources: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """U4: union by name; of equal keys the row of the earliest source stays."""
    stacked = None
    for rank, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(rank))
        stacked = s if stacked is None else stacked.unionByName(s, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c not in (*keys, "_rank")]
    return stacked.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_rank").alias("_r")).select(*keys, "_r.*")


def _told(calls: DataFrame, rows: DataFrame, tool: str, by: Sequence[str]) -> DataFrame:
    """The rows for each call's tool. Where they are broadcast, calls are dealt by ``by`` (if given) before they multiply, so that whatever looks
    at all rows of ``by`` afterwards finds them together. The partitions are as many as Spark's other shuffles have, and stay so: merged to the size
    of the calls they would be too large for the rows.

    Rows that are few are fetched by the count itself (``SMALL`` + 1 at most), so that what they are made of is not shuffled a second time."""
    spark, few = calls.sparkSession, rows.limit(SMALL + 1).toArrow()
    if few.num_rows > SMALL:
        return calls.join(rows, tool)
    if by:
        calls = calls.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    return calls.join(F.broadcast(spark.createDataFrame(few, rows.schema)), tool)


def rule_predict(calls: DataFrame, registry: DataFrame, tool: str = "tool", by: Sequence[str] = ()) -> DataFrame:
    """The registry's rows for each call's tool, with the call's horizon (least offset) and confidence (greatest).

    Both hang on the tool alone, so they are worked out in the registry and calls move once at most. by: see ``_told``."""
    of_tool = registry.groupBy(tool).agg(F.min("off").alias("horizon"), F.max("confidence").alias("best"))
    return _told(calls, registry.join(of_tool, tool), tool, by)


def nearest_targets(table: DataFrame, registry: DataFrame, tool: str = "tool", top: int = 3, least: float = 0.3) -> DataFrame:
    """For each tool of the table, of offsets 1 and 2 the first for which a likely target has registry rows; those rows."""
    likely = table.where((F.col("rank") <= top) & (F.col("prob") >= least) & F.col("off").isin(1, 2)).select(F.col("source").alias(tool), F.col("target").alias("next_tool"), "off", "prob")
    met = likely.join(registry.withColumnRenamed(tool, "next_tool"), "next_tool")
    return met.withColumn("_least", F.min("off").over(Window.partitionBy(tool))).where("off = _least").drop("_least")


def table_predict(calls: DataFrame, table: DataFrame, registry: DataFrame, tool: str = "tool", top: int = 3, least: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``nearest_targets`` for each call's tool: all of it hangs on the tool alone and is worked out in the table. by: see ``_told``."""
    return _told(calls, nearest_targets(table, registry, tool, top, least), tool, by)


def starts_with(left: DataFrame, text: str, right: DataFrame, prefix: str) -> DataFrame:
    """The pairs whose ``text`` equals or starts with ``prefix``. The distinct lengths of the prefixes (few: names are short)
    are looked up first; each left row asks with its first characters at each length, so the join has whole prefixes as keys."""
    lengths = [r[0] for r in right.select(F.length(prefix)).where(F.col(prefix).isNotNull()).distinct().collect()]
    if not lengths:
        return left.join(right, F.lit(False))
    asked = left.withColumn("_key", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, sorted(lengths))), lambda n: F.when(F.length(text) >= n, F.substring(F.col(text), F.lit(1), n))))))
    return asked.join(right, F.col("_key") == F.col(prefix)).drop("_key")


def infer_workflow(history: DataFrame, current: DataFrame, by: list[str], classes: dict[str, str], default: str, current_first: bool = True) -> DataFrame:
    """By, workflow: the class of the first name (by, ord, name) that has one; the names of the current calls before or, in the
    other variant, after those of the history. Runs whose names have no class get the default."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    ranks = (1, 0) if current_first else (0, 1)
    rows = reduce(DataFrame.unionByName, [d.select(*by, F.struct(F.lit(r).alias("rank"), "ord").alias("_at"), F.try_element_at(table, F.col("name")).alias("_cls")) for d, r in zip((history, current), ranks, strict=True)])
    return rows.groupBy(*by).agg(F.coalesce(F.min_by("_cls", F.when(F.col("_cls").isNotNull(), F.col("_at"))), F.lit(default)).alias("workflow"))


def triggered(events: DataFrame, by: list[str], order: list[str], rules: Sequence[tuple[str, Column, float, bool]]) -> DataFrame:
    """Predictions that an adapter makes itself: for each rule (name, trigger, estimated load, once a run) a row at each of its
    triggers, or at the first: confidence 1, no consumer."""
    named = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("rule"), F.lit(name).alias("name"), F.lit(load).alias("estimated_load_s"), F.lit(once).alias("once"))) for k, (name, c, load, once) in enumerate(rules)]))
    rows = events.withColumn("_r", F.explode(named)).select(*by, *order, "_r.*")
    first = F.row_number().over(Window.partitionBy(*by, "rule").orderBy(*order))
    return rows.withColumn("_n", first).where("not once or _n = 1").select(*by, *order, "name", "estimated_load_s", F.lit(1.0).alias("confidence"), F.lit("").alias("consumer_tool"))


def learned_predict(by_plan: DataFrame, by_table: DataFrame, by_rule: DataFrame, key: list[str]) -> DataFrame:
    """The rows of the first signal that has any for a step: plan, table, rule. Signals that are dealt by ``key`` alike do not move again."""
    stacked = None
    for rank, s in enumerate((by_plan, by_table, by_rule)):
        s = s.withColumn("signal", F.lit(rank))
        stacked = s if stacked is None else stacked.unionByName(s, allowMissingColumns=True)
    return stacked.withColumn("_first", F.min("signal").over(Window.partitionBy(*key))).where("signal = _first").drop("_first")


def order_key(c: Column, names: Sequence[str]) -> Column:
    """L1, L2: place in a fixed order; unknown ones come last."""
    out = F.lit(len(names))
    for k, n in reversed(list(enumerate(names))):
        out = F.when(c == n, k).otherwise(out)
    return out


def sensitivity(df: DataFrame, condition: str, wall: str, reference: str) -> DataFrame:
    """L4: delta to the reference condition's first wall time, greatest first (ties: label descending); walls of 0 or
    null do not take part. The input has one row a condition."""
    real = df.where(F.coalesce(F.col(wall), F.lit(0)) != 0)
    ref = real.where(F.col(condition) == reference).select(F.col(wall).alias("_ref")).limit(1)
    rows = real.where(F.col(condition) != reference).join(F.broadcast(ref))
    return rows.select(condition, (F.col(wall) - F.col("_ref")).alias("delta")).orderBy(F.desc("delta"), F.desc(condition))
