"""All queries of the library, by name."""

from __future__ import annotations

from .plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
