"""Where modules register their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: make a function the query ``name``, with its oracle SQL if any."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def load() -> None:
    """Import all modules that register queries."""
    import sextant.plans.catalog  # noqa: F401


def _shipped(f: Query) -> Query:
    """The query, after the package was sent to the executors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    load()
    return {name: _shipped(f) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_oracles)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["context_topk"](spark, sf_dir)
