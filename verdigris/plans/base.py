"""Registration helper of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from verdigris.session import table  # noqa: F401  (re-exported for the plan modules)


def registrar(queries: dict, sqls: dict) -> Callable:
    """A decorator that registers a query under its function's name, with its SQL if there is one."""

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return query
