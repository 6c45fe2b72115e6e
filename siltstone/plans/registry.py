"""The queries that the library registers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import corpus_queries, search_queries

ALL = {**search_queries.QUERIES, **corpus_queries.QUERIES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.entry(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
