"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.workers import reach_workers

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """Lazily read tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        reach_workers(spark)
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    """Enter a function of ``Tables`` under its own name, beside the DuckDB text with the same result."""

    def enter(run: Callable[[Tables], DataFrame]):
        CATALOG[run.__name__] = (lambda spark, folder: run(Tables(spark, folder)), sql)
        return run

    return enter
