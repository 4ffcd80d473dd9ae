"""Runnable catalog: every operator on the given tables."""

from . import (
    alignment_queries,
    boosting_queries,
    cleaning_queries,
    describe_queries,
    exceptions_queries,
    features_queries,
    metrics_queries,
    models_queries,
    returns_queries,
    sources_queries,
)
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
