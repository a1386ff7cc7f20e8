"""Named queries over the provided tables, each with SQL text for comparison."""

from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
