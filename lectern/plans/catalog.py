"""All queries over the driver's tables, and their SQL."""

from lectern.plans import store_queries, text_queries, vector_queries  # noqa: F401
from lectern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
