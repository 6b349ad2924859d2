"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from examloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query and, where SQL can say it, the SQL of the same result."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _import_all() -> None:
    from examloom.plans import modules

    modules.load_all()


def queries() -> dict[str, Query]:
    _import_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _import_all()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["train_build_funnel"](spark, sf_dir)
