"""Queries of the graph engine over the benchmark tables, each with its SQL."""

from . import construction, discovery, questions, scalars, traversal  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES
from .traversal import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
