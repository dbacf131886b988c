"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sparkdraft.session import importable


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register


class Tables:
    """The input tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        importable(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def spread(self, df: DataFrame, *key: str) -> DataFrame:
        """``df`` in as many partitions as ``sparkdraft.input.partitions`` says, where that is set.

        For inputs of a few large row groups, which Spark cannot split, ahead of work
        that is hard on each row.  Whoever runs the queries knows their files; the
        setting is absent by default, and no plan depends on the size of the data.
        """
        wanted = self.spark.conf.get("sparkdraft.input.partitions", None)
        return df if wanted is None else df.repartition(int(wanted), *key)

    @property
    def spread_documents(self) -> DataFrame:
        return self.spread(self.documents, "doc_id")

    @property
    def spread_conversations(self) -> DataFrame:
        return self.spread(self.conversations, "conv_id", "turn")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
