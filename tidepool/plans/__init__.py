"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from .analogues import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
