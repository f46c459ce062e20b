"""The queries of the library and their SQL."""

from __future__ import annotations

from .queries import QUERIES, flagship
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
