"""Queries over the driver's tables, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of a folder by name, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}

    def add(self, name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.found:
            raise ValueError(f"query {name} is registered twice")
        self.found[name] = make, sql
