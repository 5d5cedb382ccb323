"""The driver's tables as traces, and the register of queries with their SQL.

A user of ``events`` is a run, an event its step; view, click, error and purchase stand for start, completion,
cancellation and consumption of the task k of resource k % 10, signup for a prediction with an estimate. Times are
microseconds and values cents, both integers, so sums do not depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The trace in SQL; queries append to it.
E = """WITH e AS (
  SELECT user_id AS run_id, event_id AS ord, epoch_us(ts) AS t, event_type AS kind,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)
"""
#: With task and resource.
ET = E[: E.rindex(")")] + "), r AS (SELECT *, k AS task, k % 10 AS resource FROM e)\n"

BY, ORD = ["run_id"], ["t", "ord"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ord, t, kind, k, cents, task, resource."""
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), ts.alias("t"), F.col("event_type").alias("kind"), k.alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), k.alias("task"), (k % 10).alias("resource"))


def long(c, name: str | None = None):
    out = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return out.alias(name or (c if isinstance(c, str) else None)) if name or isinstance(c, str) else out


def rounded(c, name: str):
    """Compared to six places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)
