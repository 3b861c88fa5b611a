"""Imports every query module so that the registry is complete."""

from catalog import (  # noqa: F401
    correlation_queries,
    detection_queries,
    model_queries,
    parsing_queries,
    stream_queries,
    table_queries,
    triage_queries,
)
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
