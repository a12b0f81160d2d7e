"""All queries of the library and their DuckDB equivalents."""

from . import geometry_queries, packaging_queries, polygon_joins, polygon_queries, relational_queries, scalar_queries, topology_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
