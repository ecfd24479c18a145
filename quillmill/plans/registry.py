"""Where queries are registered, with their SQL, and how they read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tables of texts, whose rows cost much more than reading them.
TEXTS = {"documents", "notes", "url_extracts"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer pieces than there are cores are spread, so that one small file doesn't end in one task."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores // 2 else rows


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def distinct_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes once each, with a number by id in their batch."""
    return table(spark, folder, "notes").select("id", "title", "content", "source", "batch").distinct()


NOTES = "(SELECT DISTINCT id, title, content, source, batch FROM notes)"
