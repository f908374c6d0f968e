"""Registry of named queries: the Spark function and its SQL check side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views) -> DataFrame`` under ``name`` with an optional SQL check."""

    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = Query(name, fn, sql)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    import tapeline.plans  # noqa: F401  (registers everything on import)

    return dict(_QUERIES)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeline.sources.views import Views

    return all_queries()[name].build(Views(spark, sf_dir))
