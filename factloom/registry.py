"""Queries of the library by name, and the SQL that DuckDB runs for the same rows."""

from factloom.plans import agent_queries as _more  # noqa: F401 - adds its queries
from factloom.plans import reuse_queries as _reuse  # noqa: F401 - adds its queries
from factloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
