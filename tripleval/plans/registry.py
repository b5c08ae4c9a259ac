"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator key,
and the DuckDB oracle SQL for the keys that SQL can express.

Every query reads the given tables (through ``sources.fixtures``) and runs the
operator over the whole derived table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluate as ev
from ..session import ship_package
from .oracle import sql

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _Q[key] = run
        if oracle is not None:
            _SQL[key] = oracle
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


_LOADED = False


def _load_all() -> None:
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    from . import (queries_core, queries_explore, queries_files, queries_runs, queries_spectral,  # noqa: F401
                   queries_train)


# ------------------------------------------------------------------ shared pipeline pieces
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.examples(spark, sf_dir)


def evaluation(spark: SparkSession, sf_dir: str) -> ev.Evaluation:
    return ev.evaluate_models(examples(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return evaluation(spark, sf_dir).metrics


FLAGSHIP_SQL = sql("SELECT * FROM metrics", "metrics")

__all__ = ["register", "queries", "oracle_sql", "examples", "evaluation", "flagship", "FLAGSHIP_SQL"]
