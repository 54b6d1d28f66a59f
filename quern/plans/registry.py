"""All queries of the library, by name, and their SQL.

A query is a function of (spark, folder of tables); its SQL gives the same rows
on the same tables in another engine and is the correctness check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import analytics_queries, causal_queries, delivery_queries, document_queries, graph_queries, governance_queries, knowledge_queries, logic_queries, retrieval_queries, search_queries, streaming_queries, text_queries  # noqa: E402, F401
