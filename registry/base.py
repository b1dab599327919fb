"""The query table that the section modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.study import Study, study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(key: str, build: Callable[[Study], DataFrame], sql: str | None = None) -> None:
    """Register a query built from the study, with its SQL counterpart where SQL can express it."""
    if key in QUERIES:
        raise ValueError(f"query {key} is registered twice")
    QUERIES[key] = lambda spark, sf_dir: build(study(spark, sf_dir))
    if sql is not None:
        ORACLES[key] = sql


def r(column: Column | str, digits: int = 6) -> Column:
    """Doubles are compared at a fixed number of digits."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})
