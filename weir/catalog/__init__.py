"""All named queries."""

from . import (  # noqa: F401
    aggregate_queries,
    join_queries,
    pattern_queries,
    project_queries,
    sequence_queries,
    source_queries,
    stream_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
