"""Registered queries over the driver tables."""

from .file_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
