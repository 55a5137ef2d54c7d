"""Registry of the library's queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("tabular", "series", "text", "preferences", "objectives", "policy", "evaluation", "models", "flows", "draws", "files")


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = fn
        if sql:
            _SQL[key] = sql
        return fn

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
