"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
