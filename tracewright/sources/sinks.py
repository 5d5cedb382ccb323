"""Writers of traces, tables and reports (K1-K8) on Spark's file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import placed
from ..operators.sets import stacked


def append_events(events: DataFrame, path: str) -> None:
    """K1: one JSON line an event; a batch is added whole or not at all, by Spark's commit protocol."""
    events.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """K2: timing records; each part file has its header."""
    df.write.mode("append").option("header", True).csv(path)


def union_rows(*frames: DataFrame) -> DataFrame:
    """The union of rows and of columns, columns in order of first sight."""
    return stacked(*frames)


def write_table(df: DataFrame, path: str) -> None:
    """K3: replaces what is there, also by nothing (an empty table leaves a header only)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_csv(df: DataFrame, columns: list[str], order: list, path: str) -> None:
    """K4: fixed columns in order; report tables have a row a run."""
    df.select(*columns).repartition(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """K5: one JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def transitions_json(table: DataFrame) -> DataFrame:
    """K6: one JSON text with source -> offset -> targets by falling probability. The table has a row a kept transition."""
    entry = F.struct("rank", "target", F.col("prob").alias("probability"), F.col("cnt").alias("count"), F.col("off").alias("offset"))
    lists = table.groupBy("source", "off").agg(F.array_sort(F.collect_list(entry)).alias("targets"))
    by_source = lists.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("off").cast("string"), "targets")))).alias("by"))
    return by_source.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("source", "by"))).alias("tool_transitions"))).alias("json"))


def validation_report(trials: DataFrame, workload: str = "workload", config: str = "config", status: str = "status", gpu: str = "gpu", few: int = 10) -> DataFrame:
    """Per (workload, config) included and excluded trials, and flags for few trials and mixed hardware."""
    out = trials.groupBy(workload, config).agg(F.count_if(F.col(status) == "completed").alias("included"), F.count_if(F.coalesce(F.col(status), F.lit("?")) != "completed").alias("excluded"), F.countDistinct(F.when(F.col(status) == "completed", F.col(gpu))).alias("_gpus"))
    return out.select(workload, config, "included", "excluded", (F.col("included") < few).alias("few"), (F.col("_gpus") > 1).alias("mixed_hardware"))


def taxonomy_rows(cells: DataFrame, rows: DataFrame, by: list[str], run: str = "run_id") -> DataFrame:
    """K8: by, stall_class, exposed_stall_s, n_trials, stall_s_per_trial from the cells of ``lifecycle.taxonomy`` (by, cls, seconds) and all
    rows they were made of, with or without a class."""
    trials = rows.groupBy(*by).agg(F.countDistinct(run).alias("n_trials"))
    per = F.round(F.col("seconds") / F.greatest(F.col("n_trials"), F.lit(1)), 2)
    return cells.join(trials, by).select(*by, F.col("cls").alias("stall_class"), F.round("seconds", 2).alias("exposed_stall_s"), "n_trials", per.alias("stall_s_per_trial"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """K9: rows of a report with their place."""
    return placed(df, order)
