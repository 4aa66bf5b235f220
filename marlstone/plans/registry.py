"""The registered queries: name, function of (spark, sf_dir), and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from .bindings import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register
