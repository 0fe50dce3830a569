"""Queries over the test tables, each with the SQL of the same result."""

from sheaf.queries import algebra, language, scalars, sets, temporal  # noqa: F401
from sheaf.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
