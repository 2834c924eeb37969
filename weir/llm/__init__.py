"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from . import text_queries, token_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
