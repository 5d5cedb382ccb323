"""Queries over the driver's tables with the SQL they are held against."""

from . import metric_queries, more_queries, sequence_queries, state_queries, trace_queries  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
