"""Hazard-area CSV with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import normalise_missing

AREA_COLUMNS = ("eaareaname", "county", "description", "label", "riverorsea", "fwdcode")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the file by header name, missing cells as null."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in header)
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return normalise_missing(rows)
