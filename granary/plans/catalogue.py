"""Imports every module that registers queries."""

from granary.plans import check_sql  # noqa: F401
from granary.plans import (  # noqa: F401
    aggregation_queries, join_queries, model_queries, projection_queries, scan_queries, series_queries,
)
from granary.plans.registry import QUERIES  # noqa: F401
