"""Every query of the library under one name, with its SQL twin where one exists."""

from collections.abc import Callable

from assayer.plans.views_sql import with_views
from assayer.sources.tables import Domain

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict | None = None):
    """Register fn(domain) -> DataFrame under a name."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql:
            ORACLES[name] = with_views(sql, extra)
        return fn
    return add
