"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers f(views) as a query of (spark, sf_dir); sql is its twin over the named views."""

    def register(f):
        def run(spark, sf_dir):
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql.strip(), *views.split()) if views else sql.strip()
        return f

    return register
