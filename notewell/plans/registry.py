"""Registered queries: operators on the driver's tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewell.plans.dialect import DUCK, SPARK, Dialect, SqlOperator
from notewell.sources.adapters import relation, relation_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Relations derived from adapted ones, as SQL of both engines over ``@name`` inputs.
DERIVED: dict[str, SqlOperator] = {}


def input_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in DERIVED:
        operator = DERIVED[name]
        return operator(**{k: input_frame(spark, sf_dir, k) for k in operator.inputs})
    return relation(spark, sf_dir, name)


def input_sql(name: str) -> str:
    if name in DERIVED:
        operator = DERIVED[name]
        return operator.oracle(**{k: input_sql(k) for k in operator.inputs})
    return relation_sql(name)


def register(key: str, operator: SqlOperator, **inputs: str) -> None:
    """A query that runs ``operator`` on relations, by default those named as its inputs."""
    names = {k: inputs.get(k, k) for k in operator.inputs}
    QUERIES[key] = lambda spark, sf_dir: operator(**{k: input_frame(spark, sf_dir, v) for k, v in names.items()})
    ORACLES[key] = operator.oracle(**{k: input_sql(v) for k, v in names.items()})


def query(oracle: str | None = None):
    """Register a DataFrame query under its function's name, with its DuckDB SQL if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return add


__all__ = ["DERIVED", "DUCK", "ORACLES", "QUERIES", "SPARK", "Dialect", "input_frame", "input_sql", "query", "register"]
