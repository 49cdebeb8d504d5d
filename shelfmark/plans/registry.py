"""Registered queries: name -> Spark callable, and name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale factor; columns are pruned by the plans that use them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A projection written in SQL that both engines understand."""
        for table in TABLES:
            if f"FROM {table}" in text:
                view = f"given_{table}"
                getattr(self, table).createOrReplaceTempView(view)
                text = text.replace(f"FROM {table}", f"FROM {view}")
        return self.spark.sql(text)


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` with its SQL, if there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def with_(**ctes: str) -> str:
    """A WITH clause."""
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in ctes.items()) + " "
