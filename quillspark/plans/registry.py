"""Query registry: name -> Spark callable ``(spark, sf_dir) -> DataFrame`` and optional oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import every catalog module (each registers its queries) and return the registry."""
    from . import catalog, catalog_cases, catalog_prep, catalog_runs  # noqa: F401
    return QUERIES, ORACLE
