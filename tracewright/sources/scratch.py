"""Where queries write tables that they read back: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders handed out by this process and not cleared yet.
_HELD: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only in local mode with none set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    _HELD.append(f"{found.rstrip('/')}/tracewright-{name}-{uuid.uuid4().hex}")
    return _HELD[-1]


def clear(spark: SparkSession) -> int:
    """Delete what was written here; returned frames read it lazily, so call this once their rows are taken. How many folders there were."""
    n = len(_HELD)
    while _HELD:
        at = spark._jvm.org.apache.hadoop.fs.Path(_HELD.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what is counted and what is used are the same rows, and lineage ends at durable files."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
