"""Statistics of each stored day, kept with the writes, so that coverage reports read no readings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.constants import VALUE_STATUSES
from ..operators.summaries import day_statistics
from .day_table import DayTable

LONG, MOMENT = T.LongType(), T.TimestampType()

STATISTICS_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("r_date", T.DateType()), ("n_rows", LONG), ("n_values", LONG), ("n_measures", LONG),
            ("first_moment", MOMENT), ("last_moment", MOMENT),
            *[(f"status_{code}", LONG) for code in VALUE_STATUSES],
            ("measure_sketch", T.BinaryType()),
        )
    ]
)


class DayStatistics:
    """One row per day of a readings table, made from the day's stored rows.

    A writer calls :meth:`invalidate` before it changes days and :meth:`catch_up` after.
    If it dies in between, those days have no statistics rather than old ones, and the
    next :meth:`catch_up` makes them. Only days without statistics are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = DayTable(spark, path, STATISTICS_SCHEMA, ["r_date"], moment=None)

    def read(self) -> DataFrame:
        """The statistics, one row per day. Coverage operators take them as they take readings."""
        return self.table.read()

    def outdated(self, readings: DayTable) -> list[dt.date]:
        """The stored days that have no statistics, from folder names alone."""
        return sorted(set(readings.stored_days()) - set(self.table.stored_days()))

    def invalidate(self, days: Sequence[dt.date]) -> None:
        """Forget the statistics of days that are about to change."""
        self.table.drop_days(days)

    def catch_up(self, readings: DayTable) -> list[dt.date]:
        """Make the statistics that are missing, drop those of days no longer stored. Returns the days made."""
        self.table.drop_days(sorted(set(self.table.stored_days()) - set(readings.stored_days())))
        days = self.outdated(readings)
        if days:
            self.table.append(day_statistics(readings.read().where(F.col(readings.day).isin(days))))
        return days
