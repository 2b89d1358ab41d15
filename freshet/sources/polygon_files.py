"""Landed GeoJSON documents, one file per hazard area, named by the area code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CODE_PATTERN = r"([^/]+?)(?:\.(?:geo)?json)?$"


def read_polygon_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(fwdcode, polygon_json)``: the whole text of each file and the code from its name."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), CODE_PATTERN, 1).alias("fwdcode"),
        F.col("value").alias("polygon_json"),
    )
