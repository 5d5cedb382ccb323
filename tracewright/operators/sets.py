"""Rows of several shapes in one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def stacked(*frames: DataFrame) -> DataFrame:
    """The union of rows and of columns, columns in order of first sight."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
