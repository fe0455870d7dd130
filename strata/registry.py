"""All queries over the relational tables, by name, each with the SQL that it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Modules that register queries when they are imported.
_MODULES = ("corpus", "evaluation", "pages", "relational", "rules", "sequences")


def query(sql: str | None = None):
    """Registers a function (session, folder of the tables) under its name; without SQL, tests hold it against other results."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Registers all queries."""
    for name in _MODULES:
        importlib.import_module(f"strata.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["acceptance_gate"](spark, sf_dir)
