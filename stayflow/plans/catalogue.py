"""All queries of the library by name, with the SQL they are checked against."""

from __future__ import annotations

from . import allocation, estimation, features, lifetime, monitoring, retention, storage, trees

_PARTS = (features, retention, allocation, estimation, trees, lifetime, monitoring, storage)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
