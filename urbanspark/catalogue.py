"""Registered queries and their SQL."""

from .plans import layers, more, roundtrips  # noqa: F401  (they register their queries)
from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
