"""Registered queries over the given tables, with equivalent SQL."""

from . import check_queries, data_queries, result_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
