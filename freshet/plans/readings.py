"""Loading daily reading files into the readings table.

Date arguments are dates or texts YYYY-MM-DD; other text is an error before anything is read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.constants import LOOP_LAG_DAYS, TRAILING_DAYS
from ..functions.dates import required_date, validated_date
from ..operators.changes import one_row_per_key
from ..operators.coverage import (
    days_present,
    forced_range,
    incremental_range,
    missing_days,
    range_days,
    trailing_range,
)
from ..operators.readings import READING_KEY, TRACKED, quarantined, shape_readings, usable, with_station_label
from ..operators.summaries import day_report
from ..session import staged
from ..sinks.day_statistics import DayStatistics
from ..sinks.day_table import DayTable
from ..sources.reading_files import list_reading_files, scan_readings, unusable_days

TEXT, DAY, MOMENT = T.StringType(), T.DateType(), T.TimestampType()

READINGS_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("source", TEXT), ("r_datetime", MOMENT), ("r_month", DAY), ("r_date", DAY),
            ("source_date", DAY), ("measure", TEXT), ("notation", TEXT), ("station_id", TEXT),
            ("parameter_name", TEXT), ("parameter", TEXT), ("qualifier", TEXT), ("value_type", TEXT),
            ("period_name", TEXT), ("period", T.IntegerType()), ("unit_name", TEXT),
            ("observation_type", TEXT), ("datumtype", TEXT), ("label", TEXT),
            ("stationreference", TEXT), ("value", T.DecimalType(15, 3)),
            ("value_status", T.IntegerType()), ("completeness", TEXT), ("quality", TEXT),
            ("qcode", TEXT), ("valid", TEXT), ("invalid", TEXT), ("missing", TEXT), ("updated", MOMENT),
        )
    ]
)


def readings_table(spark: SparkSession, path: str) -> DayTable:
    """The readings table at ``path``."""
    return DayTable(
        spark, path, READINGS_SCHEMA, READING_KEY, TRACKED, updated_column="updated", created_column="created"
    )


def batch_order() -> list:
    """Which of several rows with one key counts: newest file first, then a total order of the contents."""
    return [
        F.col("source").desc(),
        *[F.col(name).desc_nulls_last() for name in ("value", *TRACKED, "period", "measure", "source_date")],
    ]


@dataclass
class LoadResult:
    """What one load did."""

    report: DataFrame
    quarantine: DataFrame
    #: days with a file but no rows
    unusable: DataFrame


def load_days(
    table: DayTable,
    base: str,
    days: DataFrame,
    stations: DataFrame,
    replace: bool = False,
    statistics: DayStatistics | None = None,
) -> LoadResult:
    """Load the landed files of ``days``; days without a usable file are passed over.

    ``replace`` drops the stored rows of a day first. Otherwise absent days are
    appended and stored ones upserted. ``statistics`` of the days that change are made anew.
    """
    # a list of days, bounded by the length of the load range
    wanted = [row.r_date for row in days.collect()]
    files = list_reading_files(table.spark, base, wanted).where(F.col("day").isin(wanted))
    shaped = staged(shape_readings(scan_readings(table.spark, base, wanted)), "shaped")
    unusable = unusable_days(files, shaped)
    rows = with_station_label(usable(shaped), stations)
    if statistics:
        statistics.invalidate([row.r_date for row in days_present(usable(shaped)).collect()])
    if not replace:
        actions = table.append_or_upsert(rows, batch_order())
        if statistics:
            statistics.catch_up(table)
        return LoadResult(day_report(shaped, actions), quarantined(shaped), unusable)

    # a file can hold a few readings of other days; those days are not dropped for them
    inside = F.col("r_date").isin(wanted)
    single = one_row_per_key(rows.where(inside), READING_KEY, batch_order())
    replaced = table.replace_days(single)
    strays = table.append_or_upsert(rows.where(~inside), batch_order())
    if statistics:
        statistics.catch_up(table)
    report = (
        day_report(shaped, strays)
        .join(replaced.drop("rows_rejected"), "r_date", "left")
        .na.fill(0, ["rows_deleted", "rows_loaded"])
    )
    return LoadResult(report, quarantined(shaped), unusable)


def load_new_days(
    table: DayTable, base: str, stations: DataFrame, today: dt.date | str, upto: int = LOOP_LAG_DAYS,
    statistics: DayStatistics | None = None,
) -> LoadResult:
    """Load the days after the last one stored."""
    return load_days(table, base, range_days(incremental_range(table.days(), required_date(today), upto, moment="r_date")), stations, statistics=statistics)


def load_forced_days(
    table: DayTable, base: str, stations: DataFrame, start: dt.date | str, end: dt.date | str | None = None,
    statistics: DayStatistics | None = None,
) -> LoadResult:
    """Load the days asked for, on top of what is stored."""
    wanted = range_days(forced_range(table.spark, required_date(start), validated_date(end)))
    return load_days(table, base, wanted, stations, statistics=statistics)


def reload_trailing_days(
    table: DayTable, base: str, stations: DataFrame, today: dt.date | str, days: int = TRAILING_DAYS,
    statistics: DayStatistics | None = None,
) -> LoadResult:
    """Replace the last days, to take in late corrections."""
    wanted = range_days(trailing_range(table.days(), required_date(today), days, moment="r_date"))
    return load_days(table, base, wanted, stations, replace=True, statistics=statistics)


def fill_gaps(
    table: DayTable,
    base: str,
    stations: DataFrame,
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
    statistics: DayStatistics | None = None,
) -> LoadResult:
    """Load the days missing between the first and last day stored."""
    wanted = missing_days(table.days(), "r_date", validated_date(first), validated_date(last))
    return load_days(table, base, wanted, stations, statistics=statistics)
