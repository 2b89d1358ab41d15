"""Parameterised reads in SQL text, from Spark tables or from a database."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_sql(spark: SparkSession, query: str, params: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run ``query`` with named ``:parameters``; ``{name}`` stands for the frame of that name."""
    return spark.sql(query, args=params or {}, **frames)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel ranges; filters and columns are pushed to it."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
