"""Registered queries over the given tables, and the same in SQL."""

from . import agg_queries, join_queries, text_queries, window_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
