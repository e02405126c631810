"""Named queries over the driver tables, with an SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from marketloom.plans.twins import TWINS
from marketloom.sources.tables import Market
from marketloom.sources.views import with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Market], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a ``Market``; ``sql`` is a template over views."""

    def add(run: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, with_views(sql, TWINS) if sql else None)
        return run

    return add


def load() -> dict[str, Query]:
    """All queries; the modules register on import."""
    from marketloom.plans import (  # noqa: F401
        queries_ingest,
        queries_jobs,
        queries_market,
        queries_model,
        queries_scalar,
        queries_series,
        queries_sinks,
        queries_streams,
        queries_tagger,
    )

    return QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q.run(Market(spark, sf_dir))

    return {name: bind(q) for name, q in load().items()}


def twins() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql}
