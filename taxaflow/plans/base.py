"""Registration of queries beside their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects ``QUERIES`` and ``ORACLES`` of one module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, sql: str | None = None):
        """Register a function under its own name; ``sql`` is the DuckDB twin."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
