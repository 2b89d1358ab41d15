"""Which days a readings table covers, and which days a load has to process."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.constants import FIRST_DAY, LOOP_LAG_DAYS, TRAILING_DAYS
from ..functions.dates import calendar, chunks, days_between
from .joins import lookup


def high_water_mark(readings: DataFrame, moment: str = "r_datetime") -> DataFrame:
    """One row ``max_datetime``."""
    return readings.agg(F.max(moment).alias("max_datetime"))


def date_bounds(readings: DataFrame, moment: str = "r_datetime") -> DataFrame:
    """One row ``min_date, max_date``."""
    return readings.agg(
        F.to_date(F.min(moment)).alias("min_date"), F.to_date(F.max(moment)).alias("max_date")
    )


def days_present(readings: DataFrame, column: str = "r_date") -> DataFrame:
    """The distinct days of the table, as ``r_date``."""
    return readings.select(F.to_date(column).alias("r_date")).where(F.col("r_date").isNotNull()).distinct()


def distinct_day_count(readings: DataFrame, column: str = "r_date") -> DataFrame:
    """One row ``days_present``."""
    return days_present(readings, column).agg(F.count("*").alias("days_present"))


def coverage_summary(readings: DataFrame, column: str = "r_date") -> DataFrame:
    """One row with the bounds and the number of days in range, present and missing."""
    return (
        days_present(readings, column)
        .agg(
            F.min("r_date").alias("min_date"),
            F.max("r_date").alias("max_date"),
            F.count("*").alias("days_present"),
        )
        .withColumn("days_in_range", days_between(F.col("min_date"), F.col("max_date")).cast("long"))
        .withColumn("days_missing", F.col("days_in_range") - F.col("days_present"))
    )


def calendar_days(bounds: DataFrame, start: str = "min_date", end: str = "max_date") -> DataFrame:
    """One row ``r_date`` per day of the bounds row."""
    return bounds.select(F.explode(calendar(F.col(start), F.col(end))).alias("r_date"))


def missing_days(
    readings: DataFrame,
    column: str = "r_date",
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """Days without rows between the first and last day present, clamped to ``first`` and ``last``."""
    present = days_present(readings, column)
    bounds = present.agg(F.min("r_date").alias("min_date"), F.max("r_date").alias("max_date"))
    wanted = calendar_days(clamped(bounds, first, last))
    return wanted.join(present, "r_date", "left_anti")


def missing_days_by_difference(readings: DataFrame, column: str = "r_date") -> DataFrame:
    """:func:`missing_days` as a set difference."""
    present = days_present(readings, column)
    bounds = present.agg(F.min("r_date").alias("min_date"), F.max("r_date").alias("max_date"))
    return calendar_days(bounds).subtract(present)


def clamped(
    ranges: DataFrame,
    first: dt.date | Column | None = None,
    last: dt.date | Column | None = None,
    start: str = "min_date",
    end: str = "max_date",
) -> DataFrame:
    """Ranges cut to the later start and the earlier end; an absent limit changes nothing."""
    return ranges.withColumns(
        {
            # greatest and least skip nulls
            start: F.greatest(F.col(start), F.lit(first).cast("date")),
            end: F.least(F.col(end), F.lit(last).cast("date")),
        }
    )


def date_chunks(ranges: DataFrame, days: int, start: str = "min_date", end: str = "max_date") -> DataFrame:
    """Every range cut into ``chunk_start, chunk_end`` pieces of at most ``days`` days."""
    kept = [name for name in ranges.columns if name not in (start, end)]
    return ranges.select(*kept, F.inline(chunks(F.col(start), F.col(end), days)))


def _work(ranges: DataFrame) -> DataFrame:
    return ranges.where(F.col("start_date") <= F.col("end_date"))


def incremental_range(
    readings: DataFrame,
    today: dt.date,
    upto: int = LOOP_LAG_DAYS,
    first_day: str = FIRST_DAY,
    moment: str = "r_datetime",
) -> DataFrame:
    """``start_date, end_date`` of the days after the last one stored, up to ``upto`` days ago.

    An empty table starts at ``first_day``. No row if there is nothing to load.
    """
    return _work(
        date_bounds(readings, moment).select(
            F.coalesce(F.date_add("max_date", 1), F.lit(first_day).cast("date")).alias("start_date"),
            F.date_sub(F.lit(today), upto).alias("end_date"),
        )
    )


def forced_range(spark: SparkSession, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """``start_date, end_date`` as asked for; a missing end means the start day alone."""
    return _work(
        spark.range(1).select(F.lit(start).alias("start_date"), F.lit(end or start).alias("end_date"))
    )


def trailing_range(
    readings: DataFrame, today: dt.date, days: int = TRAILING_DAYS, moment: str = "r_datetime"
) -> DataFrame:
    """``start_date, end_date`` from ``days`` before the last day stored to yesterday."""
    return _work(
        date_bounds(readings, moment).select(
            F.date_sub("max_date", days).alias("start_date"),
            F.date_sub(F.lit(today), 1).alias("end_date"),
        )
    )


def range_days(ranges: DataFrame) -> DataFrame:
    """The days of a load range as ``r_date``."""
    return calendar_days(ranges, "start_date", "end_date")


def with_days(readings: DataFrame, days: DataFrame, column: str = "r_date") -> DataFrame:
    """Readings of the listed days."""
    return lookup(readings, days.select(F.col("r_date").alias(column)), [column], "left_semi")


def without_days(readings: DataFrame, days: DataFrame, column: str = "r_date") -> DataFrame:
    """Readings of the days not listed."""
    return lookup(readings, days.select(F.col("r_date").alias(column)), [column], "left_anti")
