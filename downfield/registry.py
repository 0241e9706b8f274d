"""Queries of the play operators over the given tables, and their SQL."""

from __future__ import annotations

from downfield.plans import games, identity, leaders, lists, models, sources, views  # noqa: F401
from downfield.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
