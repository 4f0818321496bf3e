"""Queries that apply the library to the given tables, and the same in SQL."""

from . import structure_queries  # noqa: F401, I001
from . import activity_queries, io_queries, quality_queries, search_queries, text_queries, translate_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
