"""Queries over the given tables, one or more per operator."""

from zonewright.queries import file_queries, host_queries, model_queries, score_queries, table_queries, text_queries  # noqa: F401
from zonewright.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
