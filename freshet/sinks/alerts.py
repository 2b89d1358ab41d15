"""Alert history: an append-only table by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .day_table import DayTable

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("floodalert_id", T.LongType()),
        T.StructField("alert_date", T.DateType()),
        T.StructField("area", T.StringType()),
        T.StructField("fwdcode", T.StringType()),
        T.StructField("alert_area", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)


def alert_table(spark: SparkSession, path: str) -> DayTable:
    """The history table, with a ``created`` timestamp on every row."""
    return DayTable(
        spark, path, ALERT_SCHEMA, ["floodalert_id"], day="alert_date", moment=None, created_column="created"
    )


def find_alerts(
    alerts: DataFrame,
    first: dt.date | None = None,
    last: dt.date | None = None,
    fwdcode: str | None = None,
    area: str | None = None,
) -> DataFrame:
    """Alerts of a range of days, an area code or an area."""
    found = alerts
    if first is not None:
        found = found.where(F.col("alert_date") >= F.lit(first))
    if last is not None:
        found = found.where(F.col("alert_date") <= F.lit(last))
    if fwdcode is not None:
        found = found.where(F.col("fwdcode") == fwdcode)
    if area is not None:
        found = found.where(F.col("area") == area)
    return found
