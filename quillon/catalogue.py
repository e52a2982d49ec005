"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import Tables, checks, cleaning, extras, relational, scalars

PARTS = (relational.R, scalars.R, checks.R, cleaning.R, extras.R)


def _runner(make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(make) for part in PARTS for name, (make, _) in part.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.found.items() if sql}
